"""DuckDB counterparts of the document passes: line tables, windows and a recursive fence walk.

Every function returns a list of CTEs (name, body); ``statement`` strings them together. ``src`` is
always a relation with doc_id and md.
"""

from __future__ import annotations

NL = "chr(10)"
WS = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ATX = r"^ {0,3}#{1,6}(?:[ \t]|$)"
H1 = r"^ {0,3}#(?:[ \t]|$)"
ITEM = r"^[ \t]*(?:[-+*]|\d+[.)])(?:[ \t]|$)"
DEFINITION = rf"^ {{0,3}}\[[^\]]+\]:[{WS}]+[^{WS}]"
INDENT = r"^(?: {4}|\t)"
TABLE = rf"^[{WS}]*\|"
SEPARATOR = rf"^ {{0,3}}\|?(?:[{WS}]*:?-{{3,}}:?[{WS}]*\|)+[{WS}]*$"
QUOTES = r""""(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''"""

Ctes = list[tuple[str, str]]


def statement(ctes: Ctes, query: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as materialized (\n{b}\n)" for n, b in ctes) + "\n" + query


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


def strip(x: str) -> str:
    return rstrip(lstrip(x))


def blank(x: str) -> str:
    return f"not regexp_matches({x}, '[^{WS}]')"


def trim_plain(x: str) -> str:
    return f"case when {m(x, INDENT)} or {x} like '%  ' then {x} else {rstrip(x)} end"


def drop_tail(x: str) -> str:
    return f"case when {blank(x)} then '' else regexp_replace({x}, '\\n[{WS}]*$', '') end"


def normalized(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\r\\n?', {NL}, 'g'), '^\\x{{feff}}+', '')"


def lines(p: str, src: str) -> Ctes:
    """{p}_ln: doc_id, line_no, line, bnd, inside, open; {p}_has the raw lines in {p}_raw."""
    fence = r"^ {0,3}(`{3,}|~{3,})(.*)$"
    return [
        (f"{p}_raw", f"select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_no from (select doc_id, string_split(md, {NL}) as l from {src})"),
        (
            f"{p}_cand",
            f"""select doc_id, line_no, regexp_extract(line, '{fence}', 1) as mark, regexp_extract(line, '{fence}', 2) as info,
            row_number() over (partition by doc_id order by line_no) as k from {p}_raw where {m('line', fence)}""",
        ),
        (
            f"{p}_walk",
            f"""select doc_id, cast(0 as bigint) as k, cast(0 as bigint) as line_no, '' as ch, cast(0 as bigint) as n, false as bnd
            from (select distinct doc_id from {p}_cand)
            union all
            select c.doc_id, c.k, c.line_no,
              case when w.ch = '' then case when c.mark[1] = '`' and contains(c.info, '`') then '' else c.mark[1] end
                   when c.mark[1] = w.ch and length(c.mark) >= w.n and {blank('c.info')} then '' else w.ch end,
              case when w.ch = '' then length(c.mark) else w.n end,
              case when w.ch = '' then not (c.mark[1] = '`' and contains(c.info, '`'))
                   else c.mark[1] = w.ch and length(c.mark) >= w.n and {blank('c.info')} end
            from {p}_walk w join {p}_cand c on c.doc_id = w.doc_id and c.k = w.k + 1""",
        ),
        (
            f"{p}_ln",
            f"""select *, not bnd and not inside as open from (
              select r.doc_id, r.line_no, r.line, coalesce(w.bnd, false) as bnd,
                not coalesce(w.bnd, false) and coalesce(last_value(w.ch ignore nulls) over
                  (partition by r.doc_id order by r.line_no rows between unbounded preceding and 1 preceding), '') <> '' as inside
              from {p}_raw r left join {p}_walk w on w.doc_id = r.doc_id and w.line_no = r.line_no and w.k > 0)""",
        ),
    ]


def assemble(rel: str, text: str = "line", order: str = "line_no") -> str:
    return f"string_agg({text}, {NL} order by {order})"


WIN = "over (partition by doc_id order by line_no)"


def setext(p: str, src: str) -> Ctes:
    pair = (
        f"open and not ({blank('line')}) and not {m('line', ATX)} and not {m('line', ITEM)} and not {m('line', INDENT)}"
        f" and coalesce(regexp_matches(lead(line) {WIN}, '^ {{0,3}}(?:=+|-+)$'), false)"
    )
    return lines(p, src) + [
        (f"{p}_pair", f"select *, {pair} as pair, lead(line) {WIN} as under from {p}_ln"),
        (f"{p}_run", f"select *, sum(case when pair then 0 else 1 end) {WIN} as g from {p}_pair"),
        (f"{p}_head", f"select *, pair and (row_number() over (partition by doc_id, g, pair order by line_no)) % 2 = 1 as head from {p}_run"),
        (
            f"{p}_out",
            f"""select doc_id, {assemble('')} as md from (
              select doc_id, line_no, coalesce(lag(head) {WIN}, false) as eaten,
                case when head then case when contains(under, '=') then '# ' else '## ' end || {strip('line')}
                     when open then {trim_plain('line')} else line end as line
              from {p}_head) where not eaten group by doc_id""".replace("string_agg(,", "string_agg(line,"),
        ),
    ]


def line_pass(p: str, src: str, expression: str) -> Ctes:
    return lines(p, src) + [
        (f"{p}_out", f"select doc_id, {assemble('')} as md from (select doc_id, line_no, {expression} as line from {p}_ln) group by doc_id".replace("string_agg(,", "string_agg(line,"))
    ]


def demote(p: str, src: str, has_title: str) -> Ctes:
    """``has_title``: relation with doc_id and has_title."""
    h1 = f"(open and {m('line', H1)})"
    text = rstrip(f"'## ' || regexp_replace(line, '^ {{0,3}}#[ \\t]*', '')")
    return lines(p, src) + [
        (
            f"{p}_out",
            f"""select doc_id, string_agg(line, {NL} order by line_no) as md from (
              select l.doc_id, l.line_no,
                case when {h1} and (t.has_title or sum(case when {h1} then 1 else 0 end)
                    over (partition by l.doc_id order by l.line_no) > 1) then {text} else line end as line
              from {p}_ln l join {has_title} t on t.doc_id = l.doc_id) group by doc_id""",
        )
    ]


def autolinked(x: str) -> str:
    """Enough for labels nested around one text, with balanced code and quotes."""
    protected = rf"`[^`]*`|<[^>]*>|!?\[+[^\[\]]*\]+\([^)]*\)|!?\[[^\]]*\]\([^)]*\)|{QUOTES}|[(\[<](?:https?://|www\.)"
    url = rf"(?:https?://|www\.)[^{WS}<>]*[^{WS}<>.,;:!?''\")]"
    marked = f"regexp_replace({x}, '({protected})|({url})', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    marked = f"replace({marked}, chr(1) || chr(2), '')"
    linked = f"replace(replace(replace({marked}, chr(1) || 'www.', '<https://www.'), chr(1), '<'), chr(2), '>')"
    head = rf"^(.*?\]:[{WS}]*)"
    definition = f"regexp_replace(regexp_replace({x}, '{head}(www\\.[^{WS}]*)', '\\1<https://\\2>'), '{head}(https?://[^{WS}]*)', '\\1<\\2>')"
    return (
        f"case when not contains({x}, 'http') and not contains({x}, 'www.') then {x}"
        f" when regexp_matches({x}, '^[{WS}]*\\[.*?\\]:') then {definition} else {linked} end"
    )


def unreversed(x: str) -> str:
    marked = f"regexp_replace({x}, '(`+[^`]*`+|{QUOTES})|(\\)\\[)', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    return f"case when contains({x}, ')[') then replace(replace({marked}, chr(1) || ')[' || chr(2), ')&#91;'), chr(1) || chr(2), '') else {x} end"


def heading_cleaned(x: str) -> str:
    content = f"regexp_replace({rstrip(f'regexp_extract({x}, chr(94) || ' + chr(39) + ' {0,3}#{1,6}(?:[ \\t]+(.*))?$' + chr(39) + ', 1)')}, '[.,;:!?]+$', '')"
    marks = f"regexp_extract({x}, '^ {{0,3}}(#{{1,6}})', 1)"
    return f"case when {m(x, ATX)} then {rstrip(f'{marks} || chr(32) || {content}')} else {x} end"


def separate(p: str, src: str) -> Ctes:
    item = f"open and not {m('line', INDENT)} and {m('line', ITEM)}"
    return lines(p, src) + [
        (f"{p}_cls", f"select *, {item} as item, open and {m('line', ATX)} as heading, {blank('line')} as blank from {p}_ln"),
        (f"{p}_grp", f"select *, sum(case when heading or bnd or blank then 1 else 0 end) {WIN} as g from {p}_cls"),
        (
            f"{p}_gap",
            f"""select *, coalesce((not lag(blank) {WIN}) and (heading or (item and
                  sum(case when item then 1 else 0 end) over (partition by doc_id, g order by line_no) = 1)), false)
                or coalesce(lag(heading) {WIN} and not blank, false) as gap from {p}_grp""",
        ),
        (
            f"{p}_all",
            f"""select doc_id, string_agg(case when gap then {NL} else '' end
               || case when open then {trim_plain('line')} else line end, {NL} order by line_no) as md from {p}_gap group by doc_id""",
        ),
        (f"{p}_out", f"select doc_id, {drop_tail('md')} as md from {p}_all"),
    ]


def pipes(x: str) -> str:
    return f"length(regexp_replace(regexp_replace({x}, '\\\\.', '', 'g'), '[^|]', '', 'g'))"


def wrapped(x: str, width: int = 120) -> str:
    pattern = rf"([^ ](?:.{{0,{width - 2}}}[^ ])?|[^ ]{{{width + 1},}})(?: +|$)"
    return f"rtrim(regexp_replace({x}, '{pattern}', '\\1' || {NL}, 'g'), {NL})"


def table_rows(p: str, src: str) -> Ctes:
    table = f"open and not {m('line', INDENT)} and {m('line', TABLE)}"
    return lines(p, src) + [
        (f"{p}_t", f"select *, {table} as tab, {blank('line')} as blank from {p}_ln"),
        (f"{p}_i", f"select *, tab and not coalesce(lag(tab) {WIN}, false) as first, tab and not coalesce(lead(tab) {WIN}, false) as last, lag(blank) {WIN} as pblank from {p}_t"),
        (f"{p}_b", f"select *, sum(case when first then 1 else 0 end) {WIN} as block_id from {p}_i"),
        (f"{p}_rows", f"select doc_id, block_id, row_number() over (partition by doc_id, block_id order by line_no) as row_no, line from {p}_b where tab"),
        (
            f"{p}_ok",
            f"""select doc_id, block_id, coalesce(count(*) >= 2 and bool_or(row_no = 2 and {m(rstrip('line'), SEPARATOR)})
              and max(case when row_no = 1 then {pipes('line')} end) > 1 and min({pipes('line')}) = max({pipes('line')}), false) as ok
              from {p}_rows group by doc_id, block_id""",
        ),
    ]


def tables(p: str, src: str) -> Ctes:
    return table_rows(p, src) + [
        (
            f"{p}_all",
            f"""select b.doc_id, string_agg(case when not b.tab then b.line else
                case when b.first and not coalesce(b.pblank, true) then {NL} else '' end
                || case when b.first and not k.ok then '```text' || {NL} else '' end
                || case when k.ok then {rstrip('b.line')} else {wrapped(rstrip('b.line'))} end
                || case when b.last and not k.ok then {NL} || '```' else '' end
                || case when b.last then {NL} else '' end end, {NL} order by b.line_no) as md
              from {p}_b b left join {p}_ok k on b.tab and k.doc_id = b.doc_id and k.block_id = b.block_id group by b.doc_id""",
        ),
        (f"{p}_out", f"select doc_id, {drop_tail('md')} as md from {p}_all"),
    ]


def collapse(p: str, src: str) -> Ctes:
    return lines(p, src) + [
        (f"{p}_bl", f"select *, open and {blank('line')} as blank from {p}_ln"),
        (f"{p}_dup", f"select *, blank and coalesce(lag(blank) {WIN}, false) as dup from {p}_bl"),
        (f"{p}_out", f"select doc_id, {drop_tail('md')} as md from (select doc_id, string_agg(line, {NL} order by line_no) as md from {p}_dup where not dup group by doc_id)"),
    ]


def wrap(p: str, src: str) -> Ctes:
    plain = (
        f"open and not ({blank('line')}) and not {m('line', INDENT)} and not {m('line', ATX)} and not {m('line', ITEM)}"
        f" and not {m('line', DEFINITION)} and not {m('line', f'^[{WS}]*[|>]')}"
    )
    keeps = f"(line like '%  ' or line like '%\\' or contains(line, '](') or {m('line', f'^[{WS}]*\\[.*?\\]:')})"
    return lines(p, src) + [
        (f"{p}_pl", f"select *, {plain} as plain from {p}_ln"),
        (f"{p}_st", f"select *, case when plain and coalesce(lag(plain) {WIN}, false) then 0 else 1 end as start from {p}_pl"),
        (f"{p}_g", f"select *, sum(start) {WIN} as g from {p}_st"),
        (
            f"{p}_par",
            f"""select doc_id, g, case when bool_or(not plain) or bool_or({keeps}) then string_agg(line, {NL} order by line_no)
               else {wrapped(f"string_agg({strip('line')}, ' ' order by line_no)")} end as line from {p}_g group by doc_id, g""",
        ),
        (f"{p}_out", f"select doc_id, string_agg(line, {NL} order by g) as md from {p}_par group by doc_id"),
    ]


def headed(md: str, title: str) -> str:
    bare = f"regexp_replace({strip(f'translate({title}, chr(92) || ' + chr(39) + '`*_{}[]()<>#' + chr(39) + ', ' + chr(39) * 2 + ')')}, '[.!?,;:]+$', '')"
    first = f"regexp_matches({md}, '^(?:[{WS}]*\\n)? {{0,3}}#(?:[ \\t\\n]|$)')"
    return (
        f"case when {blank(md)} then '' when {first} then {rstrip(md)} || {NL}"
        f" else '# ' || coalesce(nullif({bare}, ''), 'Document') || {NL} || {NL} || {lstrip(md)} end"
    )


def front(p: str, src: str) -> Ctes:
    """{p}_out: doc_id, front, body, has_title."""
    mark = strip("lines[1]")
    close = f"list_position(list_transform(lines[2:], lambda x: {strip('x')}), {mark})"
    return [
        (f"{p}_l", f"select doc_id, md, string_split(md, {NL}) as lines from {src}"),
        (f"{p}_c", f"select *, case when {mark} in ('---', '+++') then coalesce({close}, 0) else 0 end as n from {p}_l"),
        (f"{p}_s", f"select doc_id, case when n > 0 then array_to_string(lines[1:n + 1], {NL}) else '' end as front, case when n > 0 then coalesce(array_to_string(lines[n + 2:], {NL}), '') else md end as body from {p}_c"),
        (f"{p}_out", f"select *, regexp_matches(front, '(?im)^title\\s*:') as has_title, body as md from {p}_s"),
    ]


def reattached(front_col: str, body: str) -> str:
    return f"case when {front_col} = '' then {body} else {rstrip(front_col)} || {NL} || {NL} || {strip(body)} || {NL} end"


def prepare(p: str, src: str, titles: str) -> Ctes:
    """{p}: doc_id, md. ``titles``: relation with doc_id and title."""
    ctes: Ctes = [(f"{p}_n", f"select doc_id, {normalized('md')} as md from {src}")]
    ctes += front(f"{p}_f", f"{p}_n")
    ctes += setext(f"{p}_1", f"{p}_f_out")
    ctes += demote(f"{p}_2", f"{p}_1_out", f"{p}_f_out")
    ctes += line_pass(f"{p}_3", f"{p}_2_out", f"case when open then {autolinked('line')} else line end")
    ctes += line_pass(f"{p}_4", f"{p}_3_out", f"case when open then {unreversed('line')} else line end")
    ctes += line_pass(f"{p}_5", f"{p}_4_out", f"case when open then {heading_cleaned('line')} else line end")
    ctes += separate(f"{p}_6", f"{p}_5_out")
    ctes += tables(f"{p}_7", f"{p}_6_out")
    ctes += collapse(f"{p}_8", f"{p}_7_out")
    ctes += wrap(f"{p}_9", f"{p}_8_out")
    ctes.append(
        (
            p,
            f"""select b.doc_id, {reattached('f.front', f"case when f.has_title then b.md else {headed('b.md', 't.title')} end")} as md
            from {p}_9_out b join {p}_f_out f on f.doc_id = b.doc_id join {titles} t on t.doc_id = b.doc_id""",
        )
    )
    return ctes


def fix(p: str, src: str) -> Ctes:
    """{p}: doc_id, md."""
    marks = "regexp_replace(line, '^( {0,3}#{1,6})[ \\t]+([^ \\t])', '\\1 \\2')"
    line = f"case when open then case when line like '% ' and line not like '%  ' then {rstrip(marks)} else {marks} end else line end"
    return (
        front(f"{p}_f", src)
        + line_pass(f"{p}_l", f"{p}_f_out", line)
        + [
            (
                p,
                f"""select l.doc_id, case when {blank('f.front || l.md')} then '' else
                  case when f.front = '' then '' else f.front || {NL} end || rtrim(l.md, {NL}) || {NL} end as md
                from {p}_l_out l join {p}_f_out f on f.doc_id = l.doc_id""",
            )
        ]
    )


def annotated(p: str, src: str) -> Ctes:
    """{p}_x: the lines of each non-blank document with everything the rules look at."""
    item = f"open and not {m('line', INDENT)} and {m('line', ITEM)}"
    ctes: Ctes = [(f"{p}_n", f"select doc_id, {normalized('md')} as md from {src} where not ({blank('md')})")]
    ctes += front(f"{p}_f", f"{p}_n")
    ctes.append(
        (
            f"{p}_body",
            f"""select f.doc_id, f.has_title, case when f.front = '' then 0 else length(f.front) - length(replace(f.front, {NL}, '')) + 1 end as shift,
            case when f.body like '%' || {NL} then left(f.body, length(f.body) - 1) else f.body end as md,
            n.md like '%' || {NL} and n.md not like '%' || {NL} || {NL} as ends_well from {p}_f_out f join {p}_n n on n.doc_id = f.doc_id""",
        )
    )
    ctes += table_rows(f"{p}_t", f"{p}_body")
    ctes += [
        (f"{p}_c", f"select *, {item} as item, open and {m('line', ATX)} as heading, open and {m('line', H1)} as h1 from {p}_t_b"),
        (f"{p}_g", f"select *, sum(case when heading or bnd or blank then 1 else 0 end) {WIN} as g from {p}_c"),
        (
            f"{p}_x",
            f"""select c.*, b.has_title, b.shift, b.ends_well, coalesce(k.ok, true) as table_ok,
              c.item and sum(case when c.item then 1 else 0 end) over (partition by c.doc_id, c.g order by c.line_no) = 1 as opens_list,
              sum(case when c.h1 then 1 else 0 end) over (partition by c.doc_id order by c.line_no) as h1_so_far,
              sum(case when not c.blank then 1 else 0 end) over (partition by c.doc_id order by c.line_no) as filled_so_far,
              lag(c.blank) over w as before_blank, lead(c.blank) over w as after_blank, lag(c.open and c.blank) over w as before_open_blank,
              lead(c.tab) over w as after_tab, lead(c.line) over w as after_line, lead(c.open) over w as after_open
            from {p}_g c join {p}_body b on b.doc_id = c.doc_id
            left join {p}_t_ok k on c.tab and k.doc_id = c.doc_id and k.block_id = c.block_id
            window w as (partition by c.doc_id order by c.line_no)""",
        ),
    ]
    return ctes


_STRIPPED = "regexp_replace(line, '`[^`]*`|<https?://[^<>]*>', ' ', 'g')"
_TAG = f"regexp_extract({_STRIPPED}, '<[a-zA-Z/!][^<>]*>')"
_GOOD = r"^<!-- *pyml (?:(?:disable|enable|disable-next-line) +[^ ]+|disable-num-lines +[0-9]+ +[^ ]+) *-->[ \t]*$"

# rule -> (message, condition, column)
RULES: dict[str, tuple[str, str, str]] = {
    "MD013": ("Line length", "length(line) > 120 and regexp_matches(substr(line, 121), '[ \\t]')", "121"),
    "MD033": ("Inline HTML", f"open and not {m('line', INDENT)} and not {m('line', '^<!-- *pyml ')} and {_TAG} <> ''", f"greatest(1, instr(line, {_TAG}))"),
    "pragma": ("Malformed pragma", f"open and {m('line', '^<!-- *pyml ')} and not {m('line', _GOOD)}", "1"),
    "heading_spacing": ("Heading marks need exactly one blank", "heading and not regexp_matches(line, '^#{1,6}(?: [^ \\t].*)?$')", "1"),
    "heading_punctuation": ("Heading ends with punctuation", f"heading and regexp_matches(line, '[.,;:!?][{WS}]*$')", "1"),
    "setext_heading": (
        "Underlined heading",
        f"open and not blank and not heading and not {m('line', INDENT)} and not {m('line', ITEM)} and coalesce(after_open and regexp_matches(after_line, '^ {{0,3}}(?:=+|-+)$'), false)",
        "1",
    ),
    "repeated_h1": ("More than one top heading", "h1 and (has_title or h1_so_far > 1)", "1"),
    "first_line_h1": ("Document must start with a top heading", "not blank and filled_so_far = 1 and not has_title and not h1", "1"),
    "bare_url": ("Bare URL", f"open and {autolinked('line')} <> line", "1"),
    "reversed_link": ("Reversed link", f"open and {unreversed('line')} <> line", "1"),
    "heading_blank_lines": ("Heading needs blank lines around it", "heading and (coalesce(not before_blank, false) or coalesce(not after_blank, false))", "1"),
    "list_blank_lines": ("List needs a blank line before it", "opens_list and coalesce(not before_blank, false)", "1"),
    "table_blank_lines": ("Table needs blank lines around it", "tab and ((first and coalesce(not before_blank, false)) or coalesce(not after_tab and not after_blank, false))", "1"),
    "multiple_blank_lines": ("Several blank lines", "open and blank and coalesce(before_open_blank, false)", "1"),
    "table_columns": ("Inconsistent table", "first and not table_ok", "1"),
    "trailing_space": ("Trailing blanks", f"open and {trim_plain('line')} <> line", f"length({trim_plain('line')}) + 1"),
    "final_newline": ("One line feed must end the document", "not ends_well and line_no = max(line_no) over (partition by doc_id)", "1"),
}


def scan(p: str, src: str, rules: tuple[str, ...] = tuple(RULES)) -> Ctes:
    """{p}: doc_id, line_no, col, rule, message."""
    parts = [
        f"select doc_id, cast(line_no + shift as integer) as line_no, cast({column} as integer) as col, '{rule}' as rule, '{message}' as message from (select *, {condition} as hit from {p}_x) where hit"
        for rule, (message, condition, column) in ((r, RULES[r]) for r in rules)
    ]
    return annotated(p, src) + [(p, "\nunion all\n".join(parts))]
