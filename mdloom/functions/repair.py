"""The Markdown repair passes: ``Column -> Column`` on a whole document body.

A pass cuts the body into units (a fenced block, a block of the pass, or a single line), maps the
units, and joins them again. Nothing leaves the row, so a corpus of any size is repaired where it was
read: no exchange, no sort, no window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions import inline
from mdloom.functions import patterns as p
from mdloom.functions.fixed import DEFAULT_TITLE, LINE_LENGTH
from mdloom.functions.text import (
    after_front_matter,
    drop_trailing_blank_lines,
    front_matter,
    is_blank,
    is_fence,
    join_lines,
    let,
    lstrip,
    rstrip,
    starts_with_letter,
    strip,
    trim_plain_line,
    units,
    unless_letter,
    wrapped_lines,
)

LINES = p.units_of()
SETEXT_UNITS = p.units_of(p.SETEXT)
BLOCK_UNITS = p.units_of(p.ATX + p.REST, p.LIST_RUN)
TABLE_UNITS = p.units_of(p.TABLE_RUN)
BLANK_UNITS = p.units_of(p.BLANK_RUN)
PARAGRAPH_UNITS = p.units_of(p.PARAGRAPH)
TEXT_UNITS = p.units_of(p.PARAGRAPH, p.BLANK_RUN)


def map_lines(body: Column, use: Callable[[Column], Column]) -> Column:
    """Apply a line function outside code fences."""
    return join_lines(
        F.transform(units(body, LINES), lambda u: F.when(is_fence(u), u).otherwise(use(u)))
    )


# --- headings ---------------------------------------------------------------------------------------
def setext_units(body: Column) -> Column:
    def convert(unit: Column) -> Column:
        h1 = F.regexp_replace(unit, rf"\A{p.W}*+([^\n]*?){p.H}*+\n {{0,3}}=++\z", "# $1")
        return F.regexp_replace(h1, rf"\A{p.W}*+([^\n]*?){p.H}*+\n {{0,3}}-++\z", "## $1")

    return F.transform(
        units(body, SETEXT_UNITS),
        lambda u: F.when(is_fence(u), u).when(u.contains("\n"), convert(u)).otherwise(trim_plain_line(u)),
    )


def last_kept_h1(parts: Column, has_title: Column) -> Column:
    """1-based unit after which every H1 is demoted; 0 when the front matter names the title."""
    first = F.array_position(F.transform(parts, _is_h1), F.lit(True))
    return F.when(has_title, F.lit(0).cast("bigint")).otherwise(first)


def _is_h1(unit: Column) -> Column:
    return unless_letter(unit, unit.rlike(r"\A" + p.ATX_H1))


def demote_units(parts: Column, has_title: Column) -> Column:
    # Bound with let(): a projected column used once may be inlined by the optimizer, here into the
    # lambda, and would then be computed again for every line.
    return let(
        last_kept_h1(parts, has_title),
        lambda kept: F.transform(
            parts, lambda u, i: F.when((i + 1 > kept) & _is_h1(u), inline.demote_h1(u)).otherwise(u)
        ),
    )


def setext_to_atx(body: Column) -> Column:
    """Underlined headings become ``#`` / ``##``; other lines lose trailing blanks."""
    return join_lines(setext_units(body))


def demote_repeated_h1(body: Column, has_title: Column) -> Column:
    """Keep the first ``#`` heading (none when the front matter has a title); the others become ``##``."""
    return let(units(body, LINES), lambda parts: join_lines(demote_units(parts, has_title)))


# --- blocks -----------------------------------------------------------------------------------------
def _is_heading(unit: Column) -> Column:
    return unless_letter(unit, unit.rlike(r"\A" + p.ATX))


def _block_gap(parts: Column, unit: Column, i: Column) -> Column:
    """Does a blank line belong before this unit of ``BLOCK_UNITS``?"""
    before = F.get(parts, i - 1)
    opens = unless_letter(unit, unit.rlike(rf"\A(?:{p.ATX}|(?!{p.INDENTED}){p.LIST_ITEM})"))
    return (i > 0) & ((opens & ~is_blank(before)) | (_is_heading(before) & ~is_blank(unit)))


def spaced_blocks(parts: Column) -> Column:
    gaps = F.transform(
        parts, lambda u, i: F.when(_block_gap(parts, u, i), F.concat(F.lit("\n"), u)).otherwise(u)
    )
    return drop_trailing_blank_lines(join_lines(gaps))


def separate_blocks(body: Column) -> Column:
    """Blank lines around headings and before lists; other lines lose trailing blanks.

    A list lasts to the next heading, fence or blank line, so lazy continuation lines stay inside its
    unit and never start a second list.
    """
    return let(units(map_lines(body, trim_plain_line), BLOCK_UNITS), spaced_blocks)


def pipe_count(row: Column) -> Column:
    """Unescaped pipes."""
    return F.length(F.regexp_replace(row, r"\\[\s\S]?|[^|\\]++", ""))


def rows_are_consistent(rows: Column) -> Column:
    """A header, a separator as second row, and the same number of pipes in every row."""
    return F.when(
        (F.size(rows) >= 2) & F.get(rows, F.lit(1)).rlike(p.TABLE_SEPARATOR),
        let(
            pipe_count(rows[0]),
            lambda n: (n > 1) & F.forall(rows, lambda row: pipe_count(row) == n),
        ),
    ).otherwise(F.lit(False))


def table_rows(block: Column) -> Column:
    return F.transform(F.split(block, "\n", -1), rstrip)


def _repaired_table(block: Column, width: int) -> Column:
    def as_text_block(rows: Column) -> Column:
        wrapped = F.flatten(F.transform(rows, lambda row: wrapped_lines(row, width)))
        return F.concat(F.array(F.lit("```text")), wrapped, F.array(F.lit("```")))

    return let(
        table_rows(block),
        lambda rows: join_lines(F.when(rows_are_consistent(rows), rows).otherwise(as_text_block(rows))),
    )


def repaired_tables(parts: Column, width: int = LINE_LENGTH) -> Column:
    def unit_or_table(unit: Column, i: Column) -> Column:
        table = F.concat(_repaired_table(unit, width), F.lit("\n"))
        gap = (i > 0) & ~is_blank(F.get(parts, i - 1))
        return F.when(
            unless_letter(unit, unit.rlike(r"\A" + p.TABLE_LINE)),
            F.concat(F.when(gap, F.lit("\n")).otherwise(F.lit("")), table),
        ).otherwise(unit)

    return drop_trailing_blank_lines(join_lines(F.transform(parts, unit_or_table)))


def repair_tables(body: Column, width: int = LINE_LENGTH) -> Column:
    """Consistent pipe tables get blank lines around them; broken ones become ``text`` blocks."""
    return let(units(body, TABLE_UNITS), lambda parts: repaired_tables(parts, width))


def collapse_blank_lines(body: Column) -> Column:
    """Runs of blank lines outside fences shrink to their first line."""
    return drop_trailing_blank_lines(
        join_lines(
            F.transform(
                units(body, BLANK_UNITS),
                lambda u: F.when(is_blank(u), F.substring_index(u, "\n", 1)).otherwise(u),
            )
        )
    )


def _keeps_breaks(paragraph: Column) -> Column:
    """A hard break, a link or something like a reference definition."""
    return (
        paragraph.contains("  \n")
        | paragraph.contains("\\\n")
        | paragraph.endswith("  ")
        | paragraph.endswith("\\")
        | paragraph.contains("](")
        | (paragraph.contains("]:") & paragraph.rlike(p.LOOKS_LIKE_DEFINITION))
    )


def _wrapped(paragraph: Column, width: int) -> Column:
    one_line = F.array_join(F.transform(F.split(paragraph, "\n", -1), strip), " ")
    return join_lines(let(one_line, lambda text: wrapped_lines(text, width)))


def _is_free_paragraph(unit: Column) -> Column:
    return (starts_with_letter(unit) | unit.rlike(p.PARAGRAPH_START)) & ~_keeps_breaks(unit)


def wrap_paragraphs(body: Column, width: int = LINE_LENGTH) -> Column:
    """Join and rewrap every paragraph that has no hard break and no link."""
    return join_lines(
        F.transform(
            units(body, PARAGRAPH_UNITS),
            lambda u: F.when(_is_free_paragraph(u), _wrapped(u, width)).otherwise(u),
        )
    )


def collapse_and_wrap(body: Column, width: int = LINE_LENGTH) -> Column:
    """``collapse_blank_lines`` and ``wrap_paragraphs`` in one walk: their units never overlap."""
    return drop_trailing_blank_lines(
        join_lines(
            F.transform(
                units(body, TEXT_UNITS),
                lambda u: F.when(is_blank(u), F.substring_index(u, "\n", 1))
                .when(_is_free_paragraph(u), _wrapped(u, width))
                .otherwise(u),
            )
        )
    )


# --- document ---------------------------------------------------------------------------------------
def heading_text(title: Column) -> Column:
    bare = let(F.translate(title, "\\`*_{}[]()<>#", ""), strip)
    bare = F.regexp_replace(bare, r"[.!?,;:]++\z", "")
    return F.when(bare == "", F.lit(DEFAULT_TITLE)).otherwise(bare)


def starts_with_h1(body: Column) -> Column:
    # A first line may also end at one of the line separators that Python's splitlines() knows.
    ends = r"\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029"
    return body.startswith("# ") | unless_letter(body, body.rlike(rf"\A(?:{p.W}*[{ends}])? {{0,3}}#(?:[ \t{ends}]|\z)"))


def ensure_document_heading(body: Column, title: Column) -> Column:
    return (
        F.when(is_blank(body), F.lit(""))
        .when(starts_with_h1(body), F.concat(rstrip(body), F.lit("\n")))
        .otherwise(F.concat(F.lit("# "), heading_text(title), F.lit("\n\n"), lstrip(body)))
    )


def reattach_front_matter(front: Column, body: Column) -> Column:
    return F.when(front == "", body).otherwise(F.concat(rstrip(front), F.lit("\n\n"), let(body, strip), F.lit("\n")))


def fix_body(body: Column) -> Column:
    """One blank after heading marks, no single trailing blank, exactly one line feed at the end."""

    def fix_line(line: Column) -> Column:
        marks = F.regexp_replace(line, r"\A( {0,3}#{1,6})[ \t]++(?=[^ \t])", "$1 ")
        return F.when(line.endswith(" ") & ~line.endswith("  "), let(marks, rstrip)).otherwise(marks)

    # Plain substring tests show that most repaired documents have no line to fix.
    marks_of_work = [body.contains(s) for s in (" \n", "#  ", "#\t", "# \t")]
    lines = F.when(reduce(or_, marks_of_work) | body.endswith(" "), map_lines(body, fix_line)).otherwise(body)
    return F.concat(F.rtrim(lines, F.lit("\n")), F.lit("\n"))


def mechanical_fix(markdown: Column) -> Column:
    """``fix_body`` of what follows the front matter."""

    def fixed(front: Column) -> Column:
        body = fix_body(after_front_matter(markdown, front))
        return F.when(front == "", body).otherwise(F.concat(front, F.lit("\n"), body))

    return F.when(is_blank(markdown), F.lit("")).otherwise(let(front_matter(markdown), fixed))
