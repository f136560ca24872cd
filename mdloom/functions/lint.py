"""Lint rules as predicates over annotated lines, and the scan that evaluates them in one pass.

A rule sees one line, its neighbours and a few facts about the document. All rules of a registry are
evaluated while a document is walked once; the findings stay in the document's row as an array, so
"is this document clean" is a size test and not a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions import inline
from mdloom.functions import patterns as p
from mdloom.functions.fixed import LINE_LENGTH, MAX_REPORT_CHARACTERS, TRUNCATION_LINE
from mdloom.functions.repair import BLOCK_UNITS, TABLE_UNITS, rows_are_consistent, table_rows
from mdloom.functions.text import (
    front_matter_has_title,
    is_blank,
    is_fence,
    is_indented,
    let,
    trim_plain_line,
    units,
    unless_letter,
)

DIAGNOSTICS_TYPE = "array<struct<line_no:int,col:int,rule:string,message:string>>"


# --- annotated lines ---------------------------------------------------------------------------------
def fence_lines(unit: Column, line: Callable[..., Column]) -> Column:
    """Map the lines of a unit with (text, position, is_boundary, in_fence)."""

    def of_fence(texts: Column) -> Column:
        closed = unit.rlike(rf"{p.FENCE_CLOSED}[^\n]*+\z")
        return let(
            closed,
            lambda c: F.transform(
                texts,
                lambda t, k: line(t, k, (k == 0) | (c & (k == F.size(texts) - 1)), (k > 0) & ~(c & (k == F.size(texts) - 1))),
            ),
        )

    def plain(texts: Column) -> Column:
        return F.transform(texts, lambda t, k: line(t, k, F.lit(False), F.lit(False)))

    return let(
        F.split(unit, "\n", -1),
        lambda texts: F.when(is_fence(unit), of_fence(texts)).otherwise(plain(texts)),
    )


def marked_lines(body: Column) -> Column:
    """array<struct<line, is_boundary, in_fence, opens_list>> in document order."""

    def of_unit(unit: Column) -> Column:
        opens_list = unless_letter(unit, unit.rlike(rf"\A(?!{p.INDENTED}){p.LIST_ITEM}"))
        return let(
            opens_list,
            lambda opens: fence_lines(
                unit,
                lambda text, k, boundary, inside: F.struct(
                    text.alias("line"),
                    boundary.alias("is_boundary"),
                    inside.alias("in_fence"),
                    (opens & (k == 0)).alias("opens_list"),
                ),
            ),
        )

    return F.flatten(F.transform(units(body, BLOCK_UNITS), of_unit))


def table_marks(body: Column) -> Column:
    """array<struct<in_table, opens_table, table_ok>>, one per line."""

    def of_unit(unit: Column) -> Column:
        in_table = unless_letter(unit, unit.rlike(r"\A" + p.TABLE_LINE))
        ok = F.when(in_table, rows_are_consistent(table_rows(unit))).otherwise(F.lit(True))
        return let(
            F.struct(in_table.alias("in_table"), ok.alias("table_ok")),
            lambda table: F.transform(
                F.split(unit, "\n", -1),
                lambda _, k: F.struct(
                    table["in_table"].alias("in_table"),
                    (table["in_table"] & (k == 0)).alias("opens_table"),
                    table["table_ok"].alias("table_ok"),
                ),
            ),
        )

    return F.flatten(F.transform(units(body, TABLE_UNITS), of_unit))


def line_classes(line: Column) -> dict[str, Column]:
    """The syntactic classes of one line, whatever surrounds it."""
    return {
        "is_heading": line.rlike(r"\A" + p.ATX),
        "is_list_item": line.rlike(r"\A" + p.LIST_ITEM),
        "is_hard_break": line.rlike(p.HARD_BREAK),
        "is_reference_definition": line.rlike(r"\A" + p.REFERENCE_DEFINITION),
        "is_indented": is_indented(line),
        "is_table_line": line.rlike(r"\A" + p.TABLE_LINE),
        "is_blank": is_blank(line),
    }


def annotated_lines(lines: Column, tables: Column) -> Column:
    """Marked lines with their classes; ``open`` means outside fences. Null ``tables``: there are none."""

    def one(x: Column, i: Column) -> Column:
        line, table = x["line"], F.get(tables, i)
        outside = ~x["is_boundary"] & ~x["in_fence"]
        return F.struct(
            line.alias("line"),
            outside.alias("open"),
            x["opens_list"].alias("opens_list"),
            F.coalesce(table["in_table"], F.lit(False)).alias("in_table"),
            F.coalesce(table["opens_table"], F.lit(False)).alias("opens_table"),
            F.coalesce(table["table_ok"], F.lit(True)).alias("table_ok"),
            is_blank(line).alias("blank"),
            is_indented(line).alias("indented"),
            (outside & unless_letter(line, line.rlike(r"\A" + p.ATX))).alias("heading"),
            (outside & unless_letter(line, line.rlike(r"\A" + p.ATX_H1))).alias("h1"),
        )

    return F.transform(lines, one)


# --- rules -------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Context:
    """What a rule may look at: a line, its neighbours (null at the ends), and document facts."""

    x: Column
    before: Column
    after: Column
    number: Column  # 1-based position in the body
    first_h1: Column  # 1-based, 0 when there is none
    first_content: Column  # 1-based, 0 when there is none
    last: Column
    has_title: Column
    ends_well: Column

    @property
    def line(self) -> Column:
        return self.x["line"]


@dataclass(frozen=True)
class Rule:
    name: str
    message: str
    finds: Callable[[Context], Column]
    column: Callable[[Context], Column] = lambda c: F.lit(1)


def _filled(neighbour: Column) -> Column:
    return F.coalesce(~neighbour["blank"], F.lit(False))


_NO_MARKUP = rf"{p.CODE_SPAN}|<https?://[^<>]*+>"
_TAG = r"<[a-zA-Z/!][^<>]*+>"
PRAGMA = r"\A<!-- *pyml "
GOOD_PRAGMA = (
    r"\A<!-- *pyml (?:(?:disable|enable|disable-next-line) +[^ ]+|disable-num-lines +[0-9]+ +[^ ]+) *-->[ \t]*\z"
)


def _tag(line: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(line, _NO_MARKUP, " "), _TAG, 0)


def _inline_html(c: Context) -> Column:
    candidate = c.x["open"] & ~c.x["indented"] & c.line.contains("<") & ~c.line.rlike(PRAGMA)
    return F.when(candidate, _tag(c.line) != "").otherwise(F.lit(False))


def _setext(c: Context) -> Column:
    text = c.x["open"] & ~c.x["blank"] & ~c.x["heading"] & ~c.x["indented"]
    after = c.after["line"]
    underline = c.after["open"] & unless_letter(after, after.rlike(r"\A {0,3}(?:=++|-++)\z"))
    return text & F.coalesce(underline, F.lit(False)) & ~c.line.rlike(r"\A" + p.LIST_ITEM)


def line_length_rule(width: int) -> Rule:
    return Rule(
        "MD013",
        "Line length",
        lambda c: (F.length(c.line) > width) & F.substr(c.line, F.lit(width + 1)).rlike(r"[ \t]"),
        lambda c: F.lit(width + 1),
    )


RULES: tuple[Rule, ...] = (
    line_length_rule(LINE_LENGTH),
    Rule("MD033", "Inline HTML", _inline_html, lambda c: F.greatest(F.lit(1), F.position(_tag(c.line), c.line))),
    Rule("pragma", "Malformed pragma", lambda c: c.x["open"] & c.line.startswith("<!--") & c.line.rlike(PRAGMA) & ~c.line.rlike(GOOD_PRAGMA)),
    Rule("heading_spacing", "Heading marks need exactly one blank", lambda c: c.x["heading"] & ~c.line.rlike(r"\A#{1,6}(?: [^ \t][^\n]*)?\z")),
    Rule("heading_punctuation", "Heading ends with punctuation", lambda c: c.x["heading"] & c.line.rlike(rf"[.,;:!?]{p.W}*+\z")),
    Rule("setext_heading", "Underlined heading", _setext),
    Rule("repeated_h1", "More than one top heading", lambda c: c.x["h1"] & (c.has_title | (c.number > c.first_h1))),
    Rule("first_line_h1", "Document must start with a top heading", lambda c: (c.number == c.first_content) & ~c.has_title & ~c.x["h1"]),
    Rule("bare_url", "Bare URL", lambda c: c.x["open"] & (inline.autolink_bare_urls(c.line) != c.line)),
    Rule("reversed_link", "Reversed link", lambda c: c.x["open"] & (inline.escape_reversed_links(c.line) != c.line)),
    Rule("heading_blank_lines", "Heading needs blank lines around it", lambda c: c.x["heading"] & (_filled(c.before) | _filled(c.after))),
    Rule("list_blank_lines", "List needs a blank line before it", lambda c: c.x["opens_list"] & _filled(c.before)),
    Rule(
        "table_blank_lines",
        "Table needs blank lines around it",
        lambda c: c.x["in_table"]
        & ((c.x["opens_table"] & _filled(c.before)) | F.coalesce(~c.after["in_table"] & ~c.after["blank"], F.lit(False))),
    ),
    Rule("multiple_blank_lines", "Several blank lines", lambda c: c.x["open"] & c.x["blank"] & F.coalesce(c.before["open"] & c.before["blank"], F.lit(False))),
    Rule("table_columns", "Inconsistent table", lambda c: c.x["opens_table"] & ~c.x["table_ok"]),
    Rule("trailing_space", "Trailing blanks", lambda c: c.x["open"] & (trim_plain_line(c.line) != c.line), lambda c: F.length(trim_plain_line(c.line)) + 1),
    Rule("final_newline", "One line feed must end the document", lambda c: (c.number == c.last) & ~c.ends_well),
)


def rules_for(rules: Sequence[Rule], width: int) -> tuple[Rule, ...]:
    """The rules, with the line length that the paragraphs are wrapped to."""
    return tuple(line_length_rule(width) if rule.name == "MD013" else rule for rule in rules)


def rules_named(*names: str) -> tuple[Rule, ...]:
    return tuple(rule for rule in RULES if rule.name in names)


# --- scan --------------------------------------------------------------------------------------------
def document_facts(lines: Column, text: Column, front: Column) -> Column:
    return F.struct(
        F.array_position(F.transform(lines, lambda x: x["h1"]), F.lit(True)).alias("first_h1"),
        F.array_position(F.transform(lines, lambda x: x["blank"]), F.lit(False)).alias("first_content"),
        F.size(lines).alias("last"),
        front_matter_has_title(front).alias("has_title"),
        (text.endswith("\n") & ~text.endswith("\n\n")).alias("ends_well"),
        F.when(front == "", F.lit(0)).otherwise(F.regexp_count(front, F.lit("\n")) + 1).alias("offset"),
    )


def findings(lines: Column, doc: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All findings of a document, ordered by line and then by rule order."""

    def of_line(x: Column, i: Column) -> Column:
        c = Context(
            x, F.get(lines, i - 1), F.get(lines, i + 1), i + 1, doc["first_h1"], doc["first_content"],
            doc["last"], doc["has_title"], doc["ends_well"],
        )
        found = [
            F.when(
                rule.finds(c),
                F.struct(
                    (doc["offset"] + c.number).cast("int").alias("line_no"),
                    rule.column(c).cast("int").alias("col"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.message).alias("message"),
                ),
            )
            for rule in rules
        ]
        return F.filter(F.array(*found), lambda f: f.isNotNull())

    return F.flatten(F.transform(lines, of_line)).cast(DIAGNOSTICS_TYPE)


# --- reports -----------------------------------------------------------------------------------------
def diagnostic_text(name: Column, line_no: Column, col: Column, rule: Column, message: Column) -> Column:
    return F.concat(name, F.lit(":"), line_no.cast("string"), F.lit(":"), col.cast("string"), F.lit(": "), rule, F.lit(" "), message)


def cap_text(text: Column, limit: int = MAX_REPORT_CHARACTERS) -> Column:
    """Joined diagnostics cut to ``limit`` characters, with a closing line when the limit was reached."""
    cut = F.regexp_replace(F.left(text, F.lit(limit)), r"\n\z", "")
    return F.when(F.length(text) + 1 >= limit, F.concat(cut, F.lit("\n" + TRUNCATION_LINE))).otherwise(text)


def full_report(name: Column, diagnostics: Column) -> Column:
    """All findings, one per line, in the order of line, column and rule."""
    lines = F.transform(F.sort_array(diagnostics), lambda d: diagnostic_text(name, d["line_no"], d["col"], d["rule"], d["message"]))
    return F.array_join(lines, "\n")


def report(name: Column, diagnostics: Column, limit: int = MAX_REPORT_CHARACTERS) -> Column:
    return let(full_report(name, diagnostics), lambda text: cap_text(text, limit))
