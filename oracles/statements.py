"""The DuckDB statement for every registered query."""

from __future__ import annotations

from mdloom.functions import fixed
from mdloom.plans import corpus as c
from oracles import markdown as o

NL = o.NL


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- shared relations ---------------------------------------------------------------------------------
_DOCS = f"""
select doc_id, {c._NAME} as name, concat('doc', doc_id) as title, {c.SEEDED_MARKDOWN} as md from documents
union all
select -doc_id - 1, {c._NAME}, concat('doc', doc_id), {c.EXTRA_MARKDOWN} from documents"""
DOCS: o.Ctes = [("docs", _DOCS)]
NORMAL: o.Ctes = DOCS + [("n", f"select doc_id, name, title, {o.normalized('md')} as md from docs")]
BODIES: o.Ctes = NORMAL + o.front("f", "n")  # f_out: doc_id, front, body, has_title, md (= body)
LINES: o.Ctes = BODIES + o.lines("l", "f_out")
SCANNED: o.Ctes = DOCS + o.scan("g", "docs")

_PATH, _LENGTH = c.FILE_COLUMNS["path"], c.FILE_COLUMNS["length"]
_LISTED = f"""select doc_id, {_PATH} as path, {_LENGTH} as length, substr({c.SIGNATURE_HEX} || hex(text), 1, 32) as head,
  timestamp '2023-11-14 22:13:20' + to_seconds(doc_id * 60) as modified from documents"""
_NAMED = "select *, regexp_extract(path, '([^/]+)$', 1) as name from listed"
_PARTS = "select *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) as suffix from named"
FILES: o.Ctes = [("listed", _LISTED), ("named", _NAMED), ("files", _PARTS)]


def media(h: str) -> str:
    return f"""(regexp_matches({h}, '^(?:{"|".join(fixed.MEDIA_PREFIXES_HEX)})')
      or ({h} like '{fixed.RIFF_HEX}%' and substr({h}, 17, 8) in {_in(fixed.RIFF_KINDS_HEX)})
      or ({h} like '{fixed.FORM_HEX}%' and substr({h}, 17, 8) in {_in(fixed.FORM_KINDS_HEX)})
      or ({h} not like 'FFFE%' and regexp_matches({h}, '^FF[EF]')) or substr({h}, 9, 8) = '{fixed.FTYP_HEX}')"""


_REASON = f"""case when suffix in {_in(fixed.BLOCKED_MEDIA_SUFFIXES)} then 'blocked_media'
  when suffix not in {_in(fixed.SUPPORTED_SUFFIXES)} then case when {media('head')} then 'blocked_media' else 'unsupported_type' end
  when path not like 'file:/corpus/in/%' then 'outside_root'
  when length > {fixed.MAX_INPUT_BYTES} then 'too_large'
  when {media('head')} then 'blocked_media' end"""
VERDICTS: o.Ctes = FILES + [("verdicts", f"select *, {_REASON} as reason from files")]


def _families() -> str:
    return "case " + " ".join(f"when suffix in {_in(s)} then '{f}'" for f, s in fixed.FORMAT_SUFFIXES.items()) + " else 'no_converter' end"


_MEMBER = ", ".join(f"{sql} as {name}" for name, sql in c.MANIFEST_COLUMNS.items())
_LINE_MEMBER = ", ".join(f"{sql} as {name}" for name, sql in c.LINE_MEMBER_COLUMNS.items())
_MEMBERS = f"""select {_MEMBER}, substr({c.MEDIA_MARK_HEX} || hex(text), 1, 32) as head from documents
  union all select {_LINE_MEMBER}, substr(hex({c.LINE_HEAD}), 1, 32) from lineitem"""
_MEMBER_PARTS = """select *, regexp_extract(entry_name, '([^/]+)$', 1) as name,
  lower(regexp_extract(regexp_extract(entry_name, '([^/]+)$', 1), '^.+(\\.[^.]+)$', 1)) as suffix from members"""
_MEMBER_REASON = f"""case when is_dir then null when suffix in {_in(fixed.ZIP_SUFFIXES)} then 'nested_archive'
  when suffix in {_in(fixed.BLOCKED_MEDIA_SUFFIXES)} then 'blocked_media'
  when name not in {_in(fixed.ARCHIVE_PLUMBING_NAMES)} and suffix not in {_in(fixed.SUPPORTED_SUFFIXES)} and suffix <> '.rels' then 'unsupported_member'
  when unreadable then 'unreadable_member' when {media('head')} then 'blocked_media' when is_zip then 'nested_archive' end"""
MEMBERS: o.Ctes = [
    ("members", _MEMBERS),
    ("parts", _MEMBER_PARTS),
    ("judged", f"select *, {_MEMBER_REASON} as reason from parts"),
    ("totals", "select path, count(*) as entries, cast(sum(file_size) as bigint) as expanded, cast(sum(compress_size) as bigint) as compressed from members group by path"),
    ("firsts", "select path, arg_min(reason, entry_no) as reason from judged where reason is not null group by path"),
]
_ARCHIVE = ", ".join(f"{sql} as {name}" for name, sql in c.ARCHIVE_COLUMNS.items())
_HELD = " union all ".join(
    f"select r, path, {k} as k, {name} as entry_name, {content.format(text='text')} as content from archives where packed and ({has})" for k, (name, has, content) in enumerate(c.ARCHIVE_MEMBERS)
)
_BASE = "regexp_extract(entry_name, '([^/]+)$', 1)"
_CONVERTED = "|".join(s[1:] for f in ("text", "html", "csv") for s in fixed.FORMAT_SUFFIXES[f])
ARCHIVES: o.Ctes = [
    ("archives", f"select row_number() over () as r, {_ARCHIVE}, doc_id, coalesce(text, '') as text from documents"),
    ("held", f"select *, row_number() over (partition by r order by k) - 1 as entry_no, ends_with(entry_name, '/') as is_dir, length(content) // 2 as size from ({_HELD})"),
    ("bundled", f"""select r, path, entry_no, entry_name, case when regexp_matches(entry_name, '\\.({_CONVERTED})$') then content end as content
      from held where not is_dir and regexp_matches(path, '\\.(zip|epub)$')"""),
]
_TOO_MANY = f"entries > {fixed.MAX_ARCHIVE_ENTRIES}"
_SIZES = f"""when expanded > {fixed.MAX_EXPANDED_BYTES} then 'expands_too_far'
  when compressed > 0 and expanded::double / compressed > {fixed.MAX_COMPRESSION_RATIO} then 'unsafe_ratio'"""


# --- HTML -----------------------------------------------------------------------------------------------
def _replace_all(x: str, steps) -> str:
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, '{pattern}', {replacement}, 'g')"
    return x


def entities(x: str) -> str:
    for name, text in [*fixed.NAMED_ENTITIES.items(), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')"
    return x


def _gap(text: str) -> str:
    return f"{NL} || {NL} || {text} || {NL} || {NL}"


_BEFORE = [
    ("(?s)<!--.*?-->", "''"),
    *[(f"(?is)<{t}\\b.*?</{t}>", "''") for t in ("head", "script", "style", "noscript", "template")],
    ("[ \\t\\n\\f\\r]+", "' '"),
    *[(f"(?i)<h{n}\\b[^>]*>(.*?)</h{n}>", _gap(f"'{'#' * n} \\1'")) for n in range(1, 7)],
    ("(?i)<li\\b[^>]*>", f"{NL} || '- '"),
    ("(?i)</?(?:ul|ol)\\b[^>]*>", f"{NL} || {NL}"),
    ("(?i)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "'[\\2](\\1)'"),
    ("(?i)<(?:b|strong)>([^<]*)</(?:b|strong)>", "'**\\1**'"),
    ("(?i)<(?:i|em)>([^<]*)</(?:i|em)>", "'*\\1*'"),
    ("(?i)<code>([^<]*)</code>", "'`\\1`'"),
    ("(?i)<br */?>", NL),
    ("(?i)</?(?:p|div|article|section|nav|header|footer|main|blockquote)\\b[^>]*>", f"{NL} || {NL}"),
    ("<[^>]+>", "''"),
]
_AFTER = [("[ \\t]*\\n[ \\t]*", NL), ("\\n{3,}", f"{NL} || {NL}"), ("^\\s+|\\s+$", "''")]
HTML_MARKDOWN = _replace_all(entities(_replace_all("html", _BEFORE)), _AFTER)
_TITLE_TEXT = _replace_all(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"), [("[ \\t\\n\\f\\r]+", "' '"), ("^ +| +$", "''")])
_STEM = "regexp_replace(regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]+)/?$', 1), '(.)\\.[^.]*$', '\\1')"
HTML_TITLE = f"coalesce(nullif({_TITLE_TEXT}, ''), {_STEM})"
PAGES: o.Ctes = [("docs", f"select page_id as doc_id, concat('page', page_id, '.html') as name, {HTML_TITLE} as title, {HTML_MARKDOWN} as md from pages")]


# --- the repair loop ---------------------------------------------------------------------------------------
def repaired(src: str = "docs", max_attempts: int = 5) -> o.Ctes:
    """``done``: doc_id, md, attempts, runs, is_clean, findings. Every attempt is run for every document that is not clean."""
    ctes: o.Ctes = [("open0", f"select * from {src} where not ({o.blank('md')})")] + o.prepare("p0", "open0", src)
    state = "p0"
    parts = [f"select doc_id, '' as md, 0 as attempts, 0 as runs, true as is_clean, 0 as findings from {src} where {o.blank('md')}"]
    still = []  # from which attempt on a text stays as it is
    for k in range(1, max_attempts + 1):
        ctes += o.fix(f"x{k}", state) + o.prepare(f"p{k}", f"x{k}", src) + o.scan(f"s{k}", f"p{k}")
        ctes.append((f"q{k}", f"select * from p{k} where doc_id in (select doc_id from s{k})"))
        parts.append(f"select doc_id, md, {k}, {k}, true, 0 from p{k} where doc_id not in (select doc_id from s{k})")
        if k > 1:
            still.append(f"select p.doc_id, {k} as k from p{k} p join {state} b on b.doc_id = p.doc_id and b.md = p.md")
        state = f"q{k}"
    ctes.append(("still", f"select doc_id, min(k) as k from ({' union all '.join(still)}) group by doc_id"))
    ctes.append(("counts", f"select doc_id, cast(count(*) as integer) as n from s{max_attempts} group by doc_id"))
    parts.append(
        f"""select q.doc_id, q.md, {max_attempts}, coalesce(t.k, {max_attempts}), false, c.n
        from {state} q join counts c on c.doc_id = q.doc_id left join still t on t.doc_id = q.doc_id"""
    )
    return ctes + [("done", "\nunion all\n".join(parts))]

_MIXED = f"""
select page_id + {c.PAGE_IDS} as doc_id, concat('page', page_id, '.html') as name, {HTML_TITLE} as title, {HTML_MARKDOWN} as md, cast(null as varchar) as reason, false as lost from pages
union all
select doc_id, name, concat('doc', doc_id), case when reason is null and doc_id % 5 <> 1 then {c.SEEDED_MARKDOWN} else '' end, reason, doc_id % 5 = 1
from documents join (select doc_id as id, name, reason from verdicts) on id = doc_id"""


# --- reports -------------------------------------------------------------------------------------------------
_TEXT = "name || ':' || line_no || ':' || col || ': ' || rule || ' ' || message"


def capped(findings: str, limit: int) -> o.Ctes:
    """``reports``: doc_id, report."""
    return [
        ("t", f"select doc_id, line_no, col, rule, text, coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no, col, rule, text rows between unbounded preceding and 1 preceding), 0) as before from {findings}"),
        ("cut", f"select *, left(text, cast({limit} - before as bigint)) as part from t where before < {limit}"),
        ("reports", f"select doc_id, string_agg(part, {NL} order by before) || case when sum(length(part) + 1) >= {limit} then {NL} || '{fixed.TRUNCATION_LINE}' else '' end as report from cut group by doc_id"),
    ]


TEXTS: o.Ctes = SCANNED + [("texts", f"select g.*, d.name, {_TEXT} as text from g join docs d on d.doc_id = g.doc_id")]


# --- intake ----------------------------------------------------------------------------------------------------
_GAP_SECONDS = 6 * 3600
_DEBOUNCE = f"""
with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= to_seconds({_GAP_SECONDS}) then 0 else 1 end as fresh from events),
b as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as burst from e)
select user_id, min(ts) as started, max(ts) as ended, count(*) as events, arg_max(event_type, (ts, event_id)) as state from b group by user_id, burst"""
_LEDGER = f"""
with log as (select concat('p', user_id) as path, ts, event_id as seq, {c.EVENT_KIND} as kind from events),
r as (select *, max(case when kind = 'event' then (ts, seq) end) over (partition by path) as reset_at from log),
p as (select path, count(*) filter (kind in ('os_error', 'changed') and (reset_at is null or (ts, seq) > reset_at)) as attempts,
  arg_max(kind, (ts, seq)) as kind, max(ts) as ts from r group by path),
ledger as (select path, attempts, case kind when 'event' then 'pending' when 'changed' then 'requeued'
    when 'os_error' then case when attempts < {fixed.MAX_ATTEMPTS} then 'retry' else 'failed' end
    when 'value_error' then 'rejected' when 'lint_error' then 'quarantined' else 'done' end as status, ts from p)
select path, attempts, status, case when status in ('pending', 'requeued') then ts + to_seconds({fixed.DEBOUNCE_SECONDS})
  when status = 'retry' then ts + to_seconds({fixed.RETRY_SECONDS}) end as next_due from ledger"""

# --- publication -----------------------------------------------------------------------------------------------
SEEDED: o.Ctes = [("docs", _DOCS.split("union all")[0])]
_ROUTED = SEEDED + VERDICTS + o.scan("g", "docs", ("MD033", "MD013")) + [
    (
        "routed",
        """select doc_id, case when reason is not null then 'rejected' when doc_id % 5 = 1 then case when 1 + doc_id % 7 < 5 then 'retry' else 'failed' end
        when doc_id in (select doc_id from g) then 'quarantined' else 'published' end as outcome from verdicts""",
    )
]


def _flag(name: str, sql: str) -> str:
    return o.statement(FILES, f"select path, {sql} as {name} from files")


def _pass(ctes: o.Ctes, out: str = "r_out") -> str:
    return o.statement(BODIES + ctes, f"select doc_id, md as markdown from {out}")


def _lines(expression: str, where: str = "open") -> str:
    return o.statement(LINES, f"select doc_id, cast(line_no as integer) as line_no, {expression} as line from l_ln where {where}")


_CLASSES = f"""{o.m('line', o.ATX)} as is_heading, {o.m('line', o.ITEM)} as is_list_item,
  line like '%  ' or line like '%\\' as is_hard_break, {o.m('line', o.DEFINITION)} as is_reference_definition,
  {o.m('line', o.INDENT)} as is_indented, not {o.m('line', o.INDENT)} and {o.m('line', o.TABLE)} as is_table_line, {o.blank('line')} as is_blank"""
_FINDING = "doc_id, line_no, col, rule, message"

STATEMENTS: dict[str, str] = {
    "file_parts": """with a as (select page_id, regexp_extract(url, '([^/]+)$', 1) as name from pages),
        b as (select *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) as ending from a)
        select page_id, name, left(name, length(name) - length(ending)) as stem, lower(ending) as suffix from b""",
    "drop_hidden": o.statement(FILES, "select path, name from files where name not like '.%' and name not like '~$%'"),
    "route_format": o.statement(FILES, f"select path, {_families()} as format from files"),
    "decode_text": "select doc_id, text from documents",
    "docs_from_pages": f"select page_id as doc_id, concat('page', page_id, '.html') as name, {HTML_TITLE} as title, 'html' as format, html as body from pages",
    "docs_from_documents": "select doc_id, concat('doc', doc_id, '.txt') as name, concat('doc', doc_id) as title, 'text' as format, text as body from documents",
    "is_blocked_media_suffix": _flag("blocked", f"suffix in {_in(fixed.BLOCKED_MEDIA_SUFFIXES)}"),
    "is_supported_suffix": _flag("supported", f"suffix in {_in(fixed.SUPPORTED_SUFFIXES)}"),
    "has_media_signature": _flag("media", media("head")),
    "within_input_limit": _flag("fits", f"length <= {fixed.MAX_INPUT_BYTES}"),
    "inside_root": _flag("inside", "path like 'file:/corpus/in/%'"),
    "within_output_limit": "select doc_id, strlen(text) <= 20000 as fits from documents",
    "admission_verdict": o.statement(VERDICTS, "select path, reason from verdicts"),
    "reject_report": o.statement(VERDICTS, "select reason, count(*) as n from verdicts where reason is not null group by reason"),
    "archive_members": o.statement(ARCHIVES, """select path, true as is_zip_file, entry_no, entry_name, is_dir, cast(size as bigint) as file_size, cast(size as bigint) as compress_size,
        case when not is_dir then substr(content, 1, 32) end as head, content like '504B0506%' as is_zip, false as unreadable from held
        union all select path, false, null, null, null, null, null, null, null, null from archives where not packed"""),
    "archive_type_mismatch": o.statement(ARCHIVES, f"""select path, packed as is_zip_file, case when zipped and not packed then 'damaged_archive' when packed and not zipped then 'archive_in_disguise' end as reason
        from (select *, lower(regexp_extract(path, '(\\.[^.]+)$', 1)) in {_in(fixed.ZIP_SUFFIXES)} as zipped from archives)"""),
    "expand_bundle": o.statement(ARCHIVES, f"""select path, entry_no, entry_name, content, case when content is null then 'no_converter' end as reason, path || '!' || entry_name as name,
        lower(regexp_extract({_BASE}, '^.+(\\.[^.]+)$', 1)) as suffix from bundled"""),
    "join_bundle": o.statement(ARCHIVES + [("said", f"""select *, case when content is not null and content not like '504B%' then {o.normalized("decode(unhex(content))")} end as md from bundled""")],
        f"select path, case when bool_and(md is not null) then string_agg('## ' || entry_name || {NL} || {NL} || md, {NL} || {NL} order by entry_no) end as markdown from said group by path"),
    "member_verdict": o.statement(MEMBERS, "select path, reason from firsts"),
    "archive_totals": o.statement(MEMBERS, f"select *, case when {_TOO_MANY} then 'too_many_entries' {_SIZES} end as reason from totals"),
    "archive_verdict": o.statement(MEMBERS, f"select t.path, case when {_TOO_MANY} then 'too_many_entries' when f.reason is not null then f.reason {_SIZES} end as reason from totals t left join firsts f on f.path = t.path"),
    "html_to_markdown": f"select page_id, {HTML_MARKDOWN} as markdown from pages",
    "html_title": f"select page_id, {HTML_TITLE} as title from pages",
    "text_to_markdown": "select doc_id, text as markdown from documents",
    "table_to_markdown": f"""select r_name, '| n_nationkey | n_name |' || {NL} || '| --- | --- |' || {NL} || '|' as head from region""",
    "decode_entities": f"select page_id, {entities('html')} as text from pages",
    "converted_size_guard": f"select page_id, strlen({HTML_MARKDOWN}) <= 4000 as fits from pages",
    "normalize_newlines": o.statement(NORMAL, "select doc_id, md as markdown from n"),
    "split_front_matter": o.statement(BODIES, "select doc_id, front as front_matter, body from f_out"),
    "front_matter_has_title": o.statement(BODIES, "select doc_id, has_title from f_out"),
    "explode_lines": o.statement(LINES, "select doc_id, cast(line_no as integer) as line_no, line from l_raw"),
    "mark_fences": o.statement(LINES, "select doc_id, cast(line_no as integer) as line_no, line, bnd as is_boundary, inside as in_fence from l_ln"),
    "classify_lines": o.statement(LINES, f"select doc_id, cast(line_no as integer) as line_no, line, {_CLASSES} from l_raw"),
    "trim_plain_line": _lines(o.trim_plain("line")),
    "assemble_lines": o.statement(BODIES, f"select doc_id, {o.drop_tail('body')} as body from f_out"),
    "setext_to_atx": _pass(o.setext("r", "f_out")),
    "demote_repeated_h1": _pass(o.demote("r", "f_out", "f_out")),
    "autolink_bare_urls": _lines(o.autolinked("line")),
    "autolink_reference_definitions": _lines(o.autolinked("line"), f"regexp_matches(line, '^\\s*\\[.*?\\]:')"),
    "escape_reversed_links": _lines(o.unreversed("line")),
    "clean_heading_punctuation": _lines(o.heading_cleaned("line")),
    "separate_blocks": _pass(o.separate("r", "f_out")),
    "table_blocks": o.statement(BODIES + o.table_rows("r", "f_out"), "select doc_id, cast(block_id as integer) as block_id, cast(row_no as integer) as row_no, line from r_rows"),
    "table_is_consistent": o.statement(BODIES + o.table_rows("r", "f_out"), "select doc_id, cast(block_id as integer) as block_id, ok from r_ok"),
    "repair_tables": _pass(o.tables("r", "f_out")),
    "collapse_blank_lines": _pass(o.collapse("r", "f_out")),
    "wrap_paragraphs": _pass(o.wrap("r", "f_out")),
    "ensure_document_heading": o.statement(BODIES, f"select f.doc_id, {o.headed('f.body', 'n.title')} as markdown from f_out f join n on n.doc_id = f.doc_id"),
    "reattach_front_matter": o.statement(BODIES, f"select doc_id, {o.reattached('front', 'body')} as markdown from f_out"),
    "mechanical_fix": o.statement(NORMAL + o.fix("r", "n"), "select doc_id, md as markdown from r"),
    "prepare_documents": o.statement(DOCS + o.prepare("r", "docs", "docs"), "select doc_id, md as markdown from r"),
    "repair_until_clean": o.statement(DOCS + repaired(), "select doc_id, md as markdown, attempts, runs, is_clean from done"),
    **{rule: o.statement(DOCS + o.scan("g", "docs", (rule,)), f"select {_FINDING} from g") for rule in o.RULES},
    "run_rules": o.statement(SCANNED, f"select {_FINDING} from g"),
    "format_diagnostics": o.statement(TEXTS, "select doc_id, text from texts"),
    "cap_report": o.statement(TEXTS + [("long_texts", "select * replace (repeat(text, 60) as text) from texts")] + capped("long_texts", 65536), "select doc_id, report from reports"),
    "is_clean": o.statement(DOCS + o.scan("g", "docs", ("MD013", "MD033", "pragma")), "select doc_id from docs where doc_id not in (select doc_id from g)"),
    "rule_summary": o.statement(SCANNED, "select rule, count(*) as findings, count(distinct doc_id) as docs from g group by rule"),
    "output_name": o.statement(DOCS, "select doc_id, name || '.md' as output from docs"),
    "route_outcome": o.statement(_ROUTED, "select doc_id, outcome from routed"),
    "run_report": o.statement(_ROUTED, "select outcome, count(*) as n from routed group by outcome"),
    "merge_latest_valid": o.statement(
        SEEDED + o.scan("g", "docs", ("MD033", "table_columns")) + [("fresh", "select name, md from docs where doc_id not in (select doc_id from g)")],
        "select name, md as markdown from fresh union all select name, 'old ' || name from docs where doc_id % 3 > 0 and name not in (select name from fresh)",
    ),
    "quarantine_rows": o.statement(
        TEXTS + capped("texts", fixed.MAX_REPORT_CHARACTERS),
        f"select d.name, left(d.md, {fixed.MAX_QUARANTINE_CHARACTERS}) as markdown, r.report from reports r join docs d on d.doc_id = r.doc_id",
    ),
    "empty_document": o.statement(DOCS, "select doc_id, case when doc_id % 4 = 0 then '' else md end as markdown from docs"),
    "changed_files": o.statement(
        FILES,
        "select path, length, modified as \"modificationTime\" from files where length % 7 = 0 or length % 3 = 0",
    ),
    "debounce": _DEBOUNCE,
    "retry_ledger": _LEDGER,
    "due_jobs": f"select * from ({_LEDGER}) where next_due <= timestamp '2024-01-30'",
    "process_pages": o.statement(
        PAGES + repaired(),
        """select d.doc_id, p.name, d.md as markdown, d.attempts, case when d.is_clean then 'published' else 'quarantined' end as outcome, d.findings
           from done d join docs p on p.doc_id = d.doc_id""",
    ),
    "process_corpus": o.statement(
        VERDICTS + [("docs", _MIXED)] + repaired(),
        """select d.doc_id, p.name, d.md as markdown, d.attempts, d.runs, d.findings, case when p.reason is not null then 'rejected'
             when p.lost then case when 1 + p.doc_id % 7 < 5 then 'retry' else 'failed' end
             when d.is_clean then 'published' else 'quarantined' end as outcome
           from done d join docs p on p.doc_id = d.doc_id""",
    ),
}


def _numbered(rows: str, group: str, order: str, max_bytes: int) -> str:
    """``rows`` with a size each, numbered by the half of ``max_bytes`` in which they start."""
    before = f"sum(size) over (partition by {group} order by {order} rows between unbounded preceding and 1 preceding)"
    return f"""select * exclude (half), dense_rank() over (partition by {group} order by half) - 1 as part_no
        from (select *, coalesce({before}, 0) // {max_bytes // 2} as half from ({rows}))"""


def _grouped_table(source: str, group: str, order: str, columns: tuple[str, ...], max_bytes: int) -> str:
    head = "| " + " | ".join(columns) + " |"
    rule = "|" + " --- |" * len(columns)
    cells = " || ' | ' || ".join(f"replace(cast({col} as varchar), '|', chr(92) || '|')" for col in columns)
    rows = f"select {group}, {order} as k, '| ' || {cells} || ' |' as line, strlen(line) + 1 as size from {source}"
    return f"""select {group}, part_no, '{head}' || {NL} || '{rule}' || {NL} || string_agg(line, {NL} order by k) as markdown
        from ({_numbered(rows, group, "k", max_bytes - len(head) - 1 - len(rule))}) group by {group}, part_no"""


STATEMENTS["table_to_markdown"] = _grouped_table("nation join region on n_regionkey = r_regionkey", "r_name", "n_nationkey", ("n_nationkey", "n_name"), fixed.MAX_MARKDOWN_BYTES)
STATEMENTS["orders_to_markdown"] = _grouped_table("orders", "o_orderpriority", "o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus"), 64 * 1024)
_CSV_ROWS = """
  select strftime(o_orderdate, '%Y-%m') as month, o_orderkey, 3 + cast(o_orderkey % 4 as integer) as n,
    list_slice([cast(o_orderkey as varchar), replace(o_orderpriority, '-', '"' || chr(92) || '|'), o_orderstatus, 'x', 'a,b', ''], 1, n) as cells,
    strlen(array_to_string(list_slice([cast(o_orderkey as varchar), '"' || replace(o_orderpriority, '-', '""|') || '"', o_orderstatus, 'x', '"a,b"', ''], 1, n), ',')) + 1 as size
  from orders"""
STATEMENTS["csv_to_markdown"] = f"""
with r as ({_numbered(_CSV_ROWS, "month", "o_orderkey", 8 * 1024)}),
w as (select month, part_no, greatest(4, max(n)) as width from r group by month, part_no),
l as (select month, part_no, width, o_orderkey, '| ' || array_to_string(list_resize(cells, width, ''), ' | ') || ' |' as line from r join w using (month, part_no))
select month, part_no, '| ' || array_to_string(list_resize(['a', 'b', 'c', 'd'], any_value(width), ''), ' | ') || ' |' || {NL} || '|' || repeat(' --- |', any_value(width)) || {NL}
  || string_agg(line, {NL} order by o_orderkey) as markdown from l group by month, part_no"""
