"""Text building blocks: binding, decoding, line ends, front matter, trimming, wrapping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions import patterns as p
from mdloom.functions.fixed import LINE_LENGTH, MAX_MARKDOWN_BYTES


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    An expression mentioned twice is evaluated twice, and nesting such expressions multiplies the
    work; a one-element ``transform`` binds the value to a lambda variable instead.
    """
    return F.transform(F.array(value), use)[0]


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def units(text: Column, pattern: str) -> Column:
    """Cut a document by a pattern made with ``patterns.units_of``."""
    return extract_all(F.concat(F.lit("\n"), text), pattern, 1)


# A pattern needs the whole text as a Java string. What these see at the first or last character spares most texts that; they
# mention the text more than once, so it has to be a column or a bound value.
def starts_visibly(text: Column) -> Column:
    """Starts with an ASCII character that is no blank."""
    return (text >= "!") & (text < "\x7f")


def starts_with_letter(text: Column) -> Column:
    return ((text >= "a") & (text < "{")) | ((text >= "A") & (text < "["))


def ends_visibly(text: Column) -> Column:
    """Ends with an ASCII character that is no blank."""
    last = F.substring(text.cast("binary"), -1, 1)  # a byte: characters would be counted from the start
    return (last >= F.lit(b"!")) & (last <= F.lit(b"~"))


def unless_letter(text: Column, test: Column) -> Column:
    """A test that no text passes which starts with an ASCII letter."""
    return F.when(starts_with_letter(text), F.lit(False)).otherwise(test)


def is_blank(text: Column) -> Column:
    return F.when(starts_visibly(text), F.lit(False)).otherwise(~text.rlike(p.NOT_W))


def _until_visible(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?s)\A(.*{p.NOT_W})", 1)


def rstrip(text: Column) -> Column:
    return F.when(ends_visibly(text), text).otherwise(_until_visible(text))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{p.W}++", "")


def strip(text: Column) -> Column:
    return F.when(starts_visibly(text) & ends_visibly(text), text).otherwise(_until_visible(lstrip(text)))


_UTF16_LE = r"\A(?:..(?:[^D].|D[0-7])|..D[89AB]..D[C-F])*+\z"
_UTF16_BE = r"\A(?:(?:[^D].|D[0-7])..|D[89AB]..D[C-F]..)*+\z"


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-16 when a byte-order mark says so, else UTF-8, else Latin-1.

    Broken UTF-16 gives null: one bad file must not fail the job that reads it.
    """
    mark = F.hex(F.substring(content, 1, 2))
    utf16 = F.substr(content, F.lit(3))
    utf8 = content.cast("string")

    def sound(pattern: str) -> Column:
        return F.hex(utf16).rlike(pattern)

    return (
        F.when((mark == "FFFE") & sound(_UTF16_LE), F.decode(utf16, "UTF-16LE"))
        .when((mark == "FEFF") & sound(_UTF16_BE), F.decode(utf16, "UTF-16BE"))
        .when(mark.isin("FFFE", "FEFF"), F.lit(None).cast("string"))
        .when(F.is_valid_utf8(utf8), utf8)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def text_to_markdown(text: Column) -> Column:
    """Plain text is Markdown already."""
    return text


def within_output_limit(markdown: Column, max_bytes: int = MAX_MARKDOWN_BYTES) -> Column:
    """UTF-8 size, not characters."""
    return F.octet_length(markdown) <= F.lit(max_bytes)


converted_size_guard = within_output_limit


def normalize_newlines(markdown: Column) -> Column:
    line_feeds = F.when(markdown.contains("\r"), F.regexp_replace(markdown, r"\r\n?", "\n")).otherwise(markdown)
    return F.when(markdown.startswith("\ufeff"), F.regexp_replace(line_feeds, "\\A\ufeff++", "")).otherwise(line_feeds)


def front_matter(markdown: Column) -> Column:
    """The front matter lines with both markers, or ''."""
    starts_otherwise = ((markdown >= "!") & (markdown < "+")) | ((markdown >= ".") & (markdown < "\x7f"))
    return F.when(starts_otherwise, F.lit("")).otherwise(F.regexp_extract(markdown, p.FRONT_MATTER, 0))


def after_front_matter(markdown: Column, front: Column) -> Column:
    return F.when(front == "", markdown).otherwise(F.substr(markdown, F.length(front) + 2))


def front_matter_has_title(front: Column) -> Column:
    return front.rlike(p.FRONT_MATTER_TITLE)


def is_fence(unit: Column) -> Column:
    return unless_letter(unit, unit.rlike(r"\A" + p.FENCE_OPEN))


def is_indented(line: Column) -> Column:
    return line.startswith("    ") | line.startswith("\t")


def trim_plain_line(line: Column) -> Column:
    """Drop trailing blanks, but not of indented code nor of a two-blank hard break."""
    return F.when(ends_visibly(line) | line.endswith("  ") | is_indented(line), line).otherwise(_until_visible(line))


def drop_trailing_blank_lines(text: Column) -> Column:
    return let(text, lambda t: F.when(ends_visibly(t), t).otherwise(F.regexp_extract(t, rf"(?s)\A(.*{p.NOT_W}[^\n]*+)", 1)))


def expand_tabs(text: Column) -> Column:
    """Tabs to the next multiple of eight. A tab ends on such a column, so each piece stands alone."""
    padded = F.transform(
        F.split(text, "\t", -1),
        lambda piece: F.concat(piece, F.repeat(F.lit(" "), 8 - F.length(piece) % 8)),
    )
    joined = F.array_join(padded, "")
    last = F.substring_index(text, "\t", -1)
    return F.when(text.contains("\t"), F.substr(joined, F.lit(1), F.length(joined) - 8 + F.length(last) % 8)).otherwise(
        text
    )


def wrapped_lines(text: Column, width: int = LINE_LENGTH) -> Column:
    """Greedy word wrap to an array of lines; words and hyphens are never broken.

    A line is the longest stretch of at most ``width`` characters that ends at a word end; a longer
    word stands alone. Leading blanks count for the first line.
    """
    inner = max(width - 2, 0)
    line = (
        rf"(?s)(\A (?:.{{0,{inner}}}[^ ])(?![^ ])|[^ ](?:.{{0,{inner}}}[^ ])?(?![^ ])|[^ ]{{{width + 1},}}+)"
    )
    other_blanks = "\n\x0b\f\r"
    has_other = reduce(or_, [text.contains(c) for c in other_blanks])
    spaced = F.when(has_other, F.translate(text, other_blanks, " " * 4)).otherwise(text)
    return extract_all(expand_tabs(spaced), line, 1)
