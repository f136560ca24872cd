"""The registered queries that SQL can express, as DuckDB SQL over the given tables."""

from __future__ import annotations

from mdloom.llm.license_list import HOLDERS, RULES, names, sentences, spdx_names
from mdloom.llm.licenses import GAP, NOTICE, SKIPPED, SPDX, STARTERS, STATED, VERBS

_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"


def _pairs(pairs) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in pair) + ")" for pair in pairs)


def _folded(sentence: str) -> str:
    """SQL for ``fold``."""
    one = rf"regexp_replace(replace({sentence}, 'licenc', 'licens'), '(?:version |v\. |v)([0-9])', '\1', 'g')"
    return rf"rtrim(regexp_replace({one} || ' ', '([0-9])(?:\.0)+ ', '\1 ', 'g'), ' ')"


def _licenses() -> str:
    """The lists are those of ``license_list``; cuts, windows, look-ups, gaps and rules are SQL of its own."""
    known = sentences()
    firsts = {s.split(" ")[0] for s in known} | {"the", "it", "they", *STARTERS} | {v.split(" ")[0] for v in VERBS}
    rules = ", ".join(f"({n}, {_quoted(name)}, {_quoted(',' + ',,'.join(ids) + ',')})" for n, (name, ids) in enumerate(RULES, 1))
    wide = lambda words: " " + words.replace(" ", "  ") + " "
    spdx = "|".join(wide(x).replace(".", r"\.") for x in sorted(spdx_names(), key=len, reverse=True))
    return rf"""
with recursive known(sentence, id) as (values {_pairs(known.items())}), names(name, license) as (values {_pairs(names().items())}),
spdx(name, license) as (values {_pairs(spdx_names().items())}), firsts(word) as (values {_pairs((w,) for w in sorted(firsts))}),
holders(n, before, after, id) as (values {", ".join(f"({n}, " + ", ".join(map(_quoted, h)) + ")" for n, h in enumerate(HOLDERS))}),
rules(n, license, pattern) as (values {rules}),
plain as (
  select row_number() over () as r, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    'https?://(?:www\.)?([^\x00-\x20<>()\[\]"'']+)', chr(30) || '\1' || chr(30), 'g'), '[^a-z0-9.!?;\n\x1e]+', ' ', 'g') as t from documents
), marked as (
  select r, array_to_string(list_transform(string_split(t, chr(10)), lambda line:
    regexp_replace(regexp_replace(line, '^ ?((dnl|rem)( |$)|[.!?;]+)', '') || ' ', '[.!?;]+([ \x1e])', chr(2) || '\1', 'g')), chr(10)) as t from plain
), parts as (
  select r, unnest(regexp_extract_all(t, '[^\x02\x03\x1e\n]*[\x02\x03\x1e\n]')) as part, generate_subscripts(regexp_extract_all(t, '[^\x02\x03\x1e\n]*[\x02\x03\x1e\n]'), 1) as k
  from (select r, regexp_replace(t, '\n(?: *\n)+', chr(3), 'g') || chr(3) as t from marked)
), cleaned as (
  select r, k, trim(regexp_replace(part[:-2], '[!?;]+', '', 'g'), ' ') as piece, case part[-1] when chr(3) then 2 when chr(2) then 1 else 0 end as level,
    coalesce(count(*) filter (where part[-1] in (chr(3), chr(10))) over (partition by r order by k rows between unbounded preceding and 1 preceding), 0) as line from parts
), grouped as (select *, count(*) filter (where piece <> '') over (partition by r order by k) as i from cleaned),
pieces as (select r, i, max(piece) as piece, max(level) as level, min(line) as line from grouped where i > 0 group by r, i),
placed as (select *, coalesce(sum(cast(level = 2 as int)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) as par from pieces),
windows as (
  select r, i, i as j, piece as s, level from placed where {_folded("string_split(piece, ' ')[1]")} in (select word from firsts)
  union all
  select w.r, w.i, p.i, w.s || ' ' || p.piece, p.level from windows w join placed p on p.r = w.r and p.i = w.j + 1 where w.level = 0 and length(w.s) <= {max(map(len, known)) + 100}
), folded as (select r, i, j, {_folded("s")} as s from windows),
looked as (
  select r, i, j, coalesce(a.id, b.id, 'name:' || n.license) as id from folded f left join known a on a.sentence = f.s
  left join known b on starts_with(f.s, 'the ') and b.sentence = f.s[5:] left join names n on n.name = regexp_extract(f.s, {_quoted("^(?:" + STATED + ")$")}, 1)
), listed as (
  select r, i, list_transform(regexp_extract_all(' ' || replace({_folded(f"piece[{len(SPDX) + 1}:]")}, ' ', '  ') || ' ', {_quoted(spdx)}), lambda x: trim(replace(x, '  ', ' '), ' ')) as found
  from placed where starts_with(piece, {_quoted(SPDX)})
), spoken as (
  select r, i, string_agg('spdx:' || license, ',,' order by o) as id
  from (select r, i, unnest(found) as name, generate_subscripts(found, 1) as o from listed) join spdx using (name) group by r, i
), held_pars as (select r, par, n, before, after, id from (select r, par, string_agg(piece, ' ' order by i) as t from placed group by r, par) join holders on contains(t, before) and contains(t, after)),
spans as (
  select a.r, a.i, b.i as j, h.n, any_value(h.id) as id, any_value(h.before) as before, any_value(h.after) as after, string_agg(c.piece, ' ' order by c.i) as s
  from held_pars h join placed a using (r, par) join placed b using (r, par) join placed c using (r, par) where a.i <= c.i and c.i <= b.i group by a.r, a.i, b.i, h.n
), held as (select r, i, n, min(j) as j, any_value(id) as id from spans where starts_with(s, before) and ends_with(s, after) group by r, i, n),
hits as (
  select r, i, j, id from (
    select r, i, i as j, id, 0 as kind, 0 as n from spoken
    union all select r, i, j, id, 1, -j from looked where id is not null
    union all select r, i, j, id, 2, n from held
  ) qualify row_number() over (partition by r, i order by kind, n) = 1
), foreign_pieces as (
  select r, i from placed where not regexp_full_match(piece, {_quoted(SKIPPED)}) qualify not bool_or(regexp_full_match(piece, {_quoted(NOTICE)})) over (partition by r, line order by i)
),
walk as (
  select r, i, j, id as seq from hits qualify row_number() over (partition by r order by i) = 1
  union all
  select * from (
    select w.r, h.i, h.j, w.seq || ',,' || case when exists (select 1 from foreign_pieces f where f.r = w.r and f.i > w.j and f.i < h.i) then '{GAP},,' else '' end || h.id
    from walk w join hits h on h.r = w.r and h.i > w.j qualify row_number() over (partition by w.r order by h.i) = 1
  )
), found as (select r, ',' || arg_max(seq, i) || ',' as seq from walk group by r),
ruled as (
  select r, seq, cast([] as varchar[]) as got, 0 as n from found
  union all
  select r, replace(seq, pattern, '#'), case when contains(seq, pattern) then list_append(got, license) else got end, rules.n from ruled join rules on rules.n = ruled.n + 1
), named as (
  select r, got || list_transform(list_filter(string_split(replace(seq, '#', ','), ','), lambda x: contains(x, ':')), lambda x: x[instr(x, ':') + 1:]) as l from ruled where n = {len(RULES)}
)
select doc_id, coalesce(replace(trim(seq, ','), ',,', ','), '') as sentence_ids, coalesce(array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ','), '') as licenses
from plain left join found using (r) left join named using (r)
"""


_NEAR = rf"""
with recursive base as (
  select doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from base
), sizes as (select doc_id, cast(len(s) as bigint) as n from sets),
items as (select doc_id, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
), edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as v, doc_id as c from sets union select e.b, r.c from reach r join edges e on e.a = r.v),
least as (select v, min(c) as component_id from reach group by v)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join least on v = doc_id
"""

_MARKED = r"""'<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)"""

_CHAT = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_MARKED})) as bigint) as formatted_chars
from rows group by conv_id
"""

_REPEATS = rf"""
with base as (select doc_id, {_WORDS.format(text="text")} as w from documents),
starts as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from base where len(w) >= 20),
windows as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as g from starts),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as k from windows) where k > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as place from later),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from base),
kept as (select doc_id, string_agg(word, ' ' order by place) as t, count(*) as n from words anti join gone using (doc_id, place) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from base left join kept using (doc_id)
"""

_TOP_K = """
with vectors as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
  from vectors q join vectors c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
), ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""

_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LEXICAL = rf"""
with docs as (select row_number() over () as r, doc_id, {_TERMS.format(text="text")} as t from documents where text is not null),
totals as (select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from docs where len(t) > 0),
items as (select distinct item_id, unnest({_TERMS.format(text="text")}) as term from benchmark),
words as (select r, unnest(t) as term from docs),
times as (select r, term, count(*) as tf from words semi join items using (term) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from times, totals group by term
), lengths as (select r, doc_id, 100 - 90 + ((90 * cast(len(t) as bigint) * n_docs) // n_terms) as m from docs, totals),
scored as (
  select item_id, r, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from items join times using (term) join weights using (term) join lengths using (r) group by item_id, r
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 10
"""

SQL = {"op3_licenses": _licenses(), "op4_near_duplicates": _NEAR, "op5_chat": _CHAT, "op8_substring_dedup": _REPEATS, "op11_exact_top_k": _TOP_K, "op12_lexical_search": _LEXICAL}
