"""HTML to Markdown as one chain of native expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.fixed import NAMED_ENTITIES
from mdloom.functions.text import extract_all, let

BLOCK_TAGS = "p|div|article|section|nav|header|footer|main|blockquote"



def _value(name: str) -> str:
    """An attribute in double quotes, single quotes or bare: one of three groups holds its value."""
    return rf"""\b{name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++))"""


# Each element's content stops at the next tag of its kind, so that an element that is never closed
# costs one line of text and not a scan to the end of the page for every such tag.
DROPPED = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<head\b[^<>]*+>(?:(?!<body\b|</?head>).)*+</head>", ""),
    *((rf"(?is)<{tag}\b[^<>]*+>(?:(?!</{tag}>).)*+(?:</{tag}>|\z)", "") for tag in ("script", "style", "noscript", "template")),
)
INLINE = (
    (r"[ \t\n\f\r]+", " "),
    *((rf"(?i)<h{n}\b[^<>]*+>((?:(?!</?h[1-6]\b).)*+)</h{n}>", f"\n\n{'#' * n} $1\n\n") for n in range(1, 7)),
    (r"(?i)<li\b[^<>]*+>", "\n- "),
    (r"(?i)</?(?:ul|ol)\b[^<>]*+>", "\n\n"),
    (rf"(?i)<a\s[^<>]*?{_value('href')}[^<>]*+>((?:(?!</?a\b).)*+)</a>", "[$4]($1$2$3)"),
    (rf"(?i)<img\b(?=[^<>]*?{_value('alt')})(?=[^<>]*?{_value('src')})[^<>]*+>", "![$1$2$3]($4$5$6)"),
    (rf"(?i)<img\b(?=[^<>]*?{_value('src')})[^<>]*+>", "![]($1$2$3)"),
    (r"(?i)<(?:b|strong)(?:\s[^<>]*+)?>([^<]*+)</(?:b|strong)>", "**$1**"),
    (r"(?i)<(?:i|em)(?:\s[^<>]*+)?>([^<]*+)</(?:i|em)>", "*$1*"),
    (r"(?i)<code(?:\s[^<>]*+)?>([^<]*+)</code>", "`$1`"),
)
ENDING = (
    (r"(?i)<br */?>", "\n"),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^<>]*+>", "\n\n"),
    (r"<[a-zA-Z/!?][^<>]*+>", ""),
    (r"<[a-zA-Z/!?][^<>]*+>", ""),  # what a tag inside a tag has left
)
TIDY = (
    (r"[ \t]*+\n[ \t]*+", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"\A\s++|(?<!\s)\s++\z", ""),
)


def _chain(text: Column, steps) -> Column:
    return reduce(lambda value, step: F.regexp_replace(value, step[0], step[1]), steps, text)


def character(code: Column) -> Column:
    """A code point as text; values that are no character become U+FFFD."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def _numeric_reference(token: Column) -> Column:
    digits = F.regexp_extract(token, r"&#[xX]?0*+([0-9a-fA-F]*)", 1)
    # More than eight significant digits are beyond every code point in both bases.
    short = F.when(F.length(digits).between(1, 8), digits).otherwise(F.lit("0"))
    radix16 = F.conv(short, 16, 10).cast("bigint")
    radix10 = F.conv(short, 10, 10).cast("bigint")
    return character(F.when(token.rlike(r"\A&#[xX]"), radix16).otherwise(radix10))


def decode_named(text: Column) -> Column:
    """Named references; ``&lt;`` and ``&gt;`` stay, ``&amp;`` comes last."""
    steps = lambda value, names: reduce(lambda v, step: F.replace(v, F.lit(step[0]), F.lit(step[1])), names, value)
    reference = r"&(?!(?:amp|lt|gt);)[a-zA-Z][a-zA-Z0-9]*+;"
    # One literal that Spark folds into a map: two thousand literals would take seconds to build.
    names = "\x1e".join(f"&{name}\x1f{value}" for name, value in html5.items() if name.endswith(";") and name not in ("amp;", "lt;", "gt;"))
    known = F.str_to_map(F.lit(names), F.lit("\x1e"), F.lit("\x1f"))

    def rest(common: Column) -> Column:
        tokens = F.transform(extract_all(common, rf"{reference}|(?:[^&]|&(?!(?!(?:amp|lt|gt);)[a-zA-Z][a-zA-Z0-9]*+;))++"), lambda t: F.when(t.rlike(rf"\A{reference}\z"), F.coalesce(F.element_at(known, t), t)).otherwise(t))
        return F.when(common.rlike(reference), F.array_join(tokens, "")).otherwise(common)

    return let(text, lambda t: F.when(t.contains("&"), steps(let(steps(t, NAMED_ENTITIES.items()), rest), [("&amp;", "&")])).otherwise(t))


def decode_numeric(text: Column) -> Column:
    """Decimal and hexadecimal references; those of ``<`` and ``>`` stay encoded by name."""
    reference = r"&#(?:[0-9]++|[xX][0-9a-fA-F]++);"

    def decoded(token: Column) -> Column:
        return let(
            _numeric_reference(token),
            lambda c: F.when(c == "<", F.lit("&lt;")).when(c == ">", F.lit("&gt;")).when(c == "&", F.lit("&amp;")).otherwise(c),
        )

    def tokens(text: Column) -> Column:
        return F.transform(
            extract_all(text, rf"{reference}|(?:[^&]|&(?!#(?:[0-9]++|[xX][0-9a-fA-F]++);))++"),
            lambda t: F.when(t.rlike(rf"\A{reference}"), decoded(t)).otherwise(t),
        )

    return let(text, lambda whole: F.when(whole.contains("&#"), F.array_join(tokens(whole), "")).otherwise(whole))


def decode_entities(text: Column) -> Column:
    return decode_named(decode_numeric(text))


def _table(html: Column) -> Column:
    """Rows as pipe rows, with the separator after the first."""

    def cells(row: Column) -> Column:
        found = extract_all(row, r"(?i)<t[hd]\b[^<>]*+>((?:(?!</?t[hdr]\b).)*+)", 1)
        return F.transform(
            found,
            lambda c: F.regexp_replace(F.replace(F.regexp_replace(c, r"<[a-zA-Z/!?][^<>]*+>", ""), F.lit("|"), F.lit("\\|")), r"\A +| +\z", ""),
        )

    def as_row(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    def lines(rows: Column) -> Column:
        separator = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
        head = F.array(as_row(rows[0]), separator)
        return F.array_join(F.concat(head, F.transform(F.slice(rows, 2, F.size(rows)), as_row)), "\n")

    rows = F.transform(extract_all(html, r"(?i)<tr\b[^<>]*+>(?:(?!</?tr\b).)*+"), cells)
    # A caption, and text that stands outside every cell, goes before the table.
    outside = F.regexp_replace(F.regexp_replace(html, r"(?i)<t[hd]\b[^<>]*+>(?:(?!</?t[hdr]\b).)*+", ""), r"<[a-zA-Z/!?][^<>]*+>", " ")
    stray = F.regexp_replace(F.regexp_replace(outside, r"[ \n]+", " "), r"\A | \z", "")
    before = F.when(stray == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), stray))
    return let(rows, lambda r: F.concat(before, F.when(F.size(r) == 0, F.lit("\n\n")).otherwise(F.concat(F.lit("\n\n"), lines(r), F.lit("\n\n")))))


def _flow(html: Column) -> Column:
    """Everything but ``<pre>``."""
    table = r"(?i)<table\b[^<>]*+>(?:(?!</?table\b).)*+</table>"
    inline = _chain(html, INLINE)
    with_tables = let(inline, lambda text: F.when(text.rlike(r"(?i)<table\b"), F.array_join(_table_pieces(text, table), "")).otherwise(text))
    return _chain(decode_entities(_chain(with_tables, ENDING)), TIDY)


def _table_pieces(text: Column, table: str) -> Column:
    return F.transform(
        extract_all(text, rf"{table}|(?:[^<]|(?!{table})<)++"),
        lambda t: F.when(t.rlike(r"(?i)\A<table\b"), _table(t)).otherwise(t),
    )


def _preformatted(html: Column) -> Column:
    inner = F.regexp_replace(html, r"(?i)\A<pre\b[^<>]*+>\n?|</pre>\z", "")
    text = decode_entities(F.regexp_replace(inner, r"<[a-zA-Z/!?][^<>]*+>", ""))
    code = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.concat(F.lit("```\n"), F.rtrim(code, F.lit("\n")), F.lit("\n```"))


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page: all body content is kept, scripts, styles, comments and the head are not."""
    pre = r"(?is)<pre\b[^<>]*+>(?:(?!</?pre\b).)*+</pre>"
    cleaned = _chain(html, DROPPED)

    def with_pre(text: Column) -> Column:
        parts = F.transform(
            extract_all(text, rf"{pre}|(?:[^<]|(?!{pre})<)++"),
            lambda part: F.when(part.rlike(r"(?i)\A<pre\b"), _preformatted(part)).otherwise(_flow(part)),
        )
        return F.array_join(F.filter(parts, lambda part: part != ""), "\n\n")

    return let(cleaned, lambda text: F.when(text.rlike(r"(?i)<pre\b"), with_pre(text)).otherwise(_flow(text)))


def html_title(html: Column, url: Column) -> Column:
    """The title element, else the stem of the URL's last path part."""
    raw = F.regexp_extract(html, r"(?is)<title\b[^<>]*+>((?:(?!</?title\b).)*+)</title>", 1)
    title = F.regexp_replace(F.regexp_replace(decode_entities(raw), r"[ \t\n\f\r]+", " "), r"\A +| +\z", "")
    path = F.regexp_replace(url, r"[?#].*", "")
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/?\z", 1), r"(?<=.)\.[^.]*\z", "")
    return let(title, lambda t: F.when(t == "", stem).otherwise(t))
