"""CSV text to a Markdown table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdloom.functions.text import extract_all, let, normalize_newlines

_FIELD = r'(?:"(?:[^"]|"")*+"|[^"{stop}])*+'
_RECORDS = r"\n(" + _FIELD.replace("{stop}", r"\n") + ")"
_CELLS = ",(" + _FIELD.replace("{stop}", ",") + ")"


def _cells(record: Column) -> Column:
    def cell(raw: Column) -> Column:
        bare = F.when(
            raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1),
            F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(raw)
        return F.replace(F.replace(bare, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))

    return F.transform(extract_all(F.concat(F.lit(","), record), _CELLS, 1), cell)


def csv_to_markdown(text: Column) -> Column:
    """Header, separator and one row per record; the table is as wide as the widest record, shorter ones are filled."""

    def table(records: Column) -> Column:
        width = F.array_max(F.transform(records, F.size))

        def row(cells: Column) -> Column:
            filled = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))
            return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

        separator = F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width)))
        lines = F.transform(records, row)
        return F.when(F.size(records) == 0, F.lit("")).otherwise(
            F.array_join(F.concat(F.slice(lines, 1, 1), separator, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")
        )

    records = extract_all(F.concat(F.lit("\n"), normalize_newlines(text)), _RECORDS, 1)
    return let(F.transform(F.filter(records, lambda record: record != ""), _cells), table)
