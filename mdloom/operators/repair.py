"""Repair and scan whole documents: one projection per step, all of them narrow.

The steps are separate columns rather than one nested expression, so that a value used twice is
computed once and the plan stays quick to analyse. Rows whose ``markdown`` is null pass through every
step untouched; the attempt loop uses that to leave finished documents alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import inline, lint, repair
from mdloom.functions import text as tx
from mdloom.functions.fixed import LINE_LENGTH, MAX_ATTEMPTS, MAX_MARKDOWN_BYTES
from mdloom.functions.lint import DIAGNOSTICS_TYPE, RULES, Rule
from mdloom.operators.once import computed_once
from mdloom.sources.staging import staging_folder

TOO_LARGE = "markdown_too_large"


def split_front_matter(docs: DataFrame, column: str = "markdown") -> DataFrame:
    """+front_matter, +body."""
    return docs.withColumn("front_matter", tx.front_matter(F.col(column))).withColumn(
        "body", tx.after_front_matter(F.col(column), F.col("front_matter"))
    )


Steps = list[dict[str, Column]]


def run_steps(docs: DataFrame, steps: Steps, *, drop: Sequence[str]) -> DataFrame:
    """Project step by step. The input is fenced off: projections would move into each branch of a union."""
    docs = computed_once(docs, "markdown")
    for step in steps:
        docs = docs.withColumns(step)
    return docs.drop(*drop)


def _split_steps(column: str) -> Steps:
    return [
        {"front_matter": tx.front_matter(F.col(column))},
        {"body": tx.after_front_matter(F.col(column), F.col("front_matter"))},
    ]


PREPARE_COLUMNS = ("front_matter", "body", "_has_title", "_parts")


def once_per_application(build):
    """Keep built steps: columns are only names and functions, and building them costs many JVM calls."""
    kept = lru_cache(maxsize=16)(lambda application, *args: build(*args))

    @wraps(build)
    def steps(*args):
        return kept(SparkSession.active().sparkContext.applicationId, *args)

    return steps


@once_per_application
def prepare_steps(width: int = LINE_LENGTH, title: str = "title") -> Steps:
    body, front, has_title, parts = F.col("body"), F.col("front_matter"), F.col("_has_title"), F.col("_parts")
    lines = repair.demote_units(parts, has_title)
    for line_pass in (inline.autolink_bare_urls, inline.escape_reversed_links, inline.clean_heading_punctuation):
        lines = F.transform(lines, line_pass)
    return [
        {"markdown": tx.normalize_newlines(F.col("markdown"))},
        *_split_steps("markdown"),
        {"_has_title": tx.front_matter_has_title(front), "_parts": repair.setext_units(body)},
        {"_parts": tx.units(tx.join_lines(lines), repair.BLOCK_UNITS)},
        {"body": repair.spaced_blocks(parts)},
        {"body": F.when(body.contains("|"), repair.repair_tables(body, width)).otherwise(body)},
        {"body": repair.collapse_and_wrap(body, width)},
        {"body": F.when(has_title, body).otherwise(repair.ensure_document_heading(body, F.coalesce(title, F.lit(""))))},
        {"markdown": repair.reattach_front_matter(front, body)},
    ]


def prepare_documents(docs: DataFrame, width: int = LINE_LENGTH, title: str = "title") -> DataFrame:
    """All repair passes in their fixed order, on the ``markdown`` column."""
    return computed_once(run_steps(docs, prepare_steps(width, title), drop=PREPARE_COLUMNS), "markdown")


FIX_COLUMNS = ("front_matter", "body")


@once_per_application
def fix_steps() -> Steps:
    front, fixed = F.col("front_matter"), repair.fix_body(F.col("body"))
    with_front = F.when(front == "", fixed).otherwise(F.concat(front, F.lit("\n"), fixed))
    return [
        *_split_steps("markdown"),
        {"markdown": F.when(tx.is_blank(F.col("markdown")), F.lit("")).otherwise(with_front)},
    ]


def fix_documents(docs: DataFrame) -> DataFrame:
    """The mechanical fixes, on the ``markdown`` column."""
    return computed_once(run_steps(docs, fix_steps(), drop=FIX_COLUMNS), "markdown")


SCAN_COLUMNS = ("_text", "front_matter", "body", "_tables", "_lines", "_facts")


@once_per_application
def scan_steps(rules: Sequence[Rule] = RULES) -> Steps:
    text, body, lines = F.col("_text"), F.col("body"), F.col("_lines")
    none = F.array().cast(DIAGNOSTICS_TYPE)
    found = lint.findings(lines, F.col("_facts"), rules)
    return [
        {"_text": tx.normalize_newlines(F.col("markdown"))},
        *_split_steps("_text"),
        {"body": F.regexp_replace(body, r"\n\z", "")},
        {"_tables": F.when(body.contains("|"), lint.table_marks(body)), "_lines": lint.marked_lines(body)},
        {"_lines": lint.annotated_lines(lines, F.col("_tables"))},
        {"_facts": lint.document_facts(lines, text, F.col("front_matter"))},
        {"diagnostics": F.when(tx.is_blank(text), none).otherwise(found)},
    ]


def scan_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """+diagnostics: every finding of every rule, as an array in the document's row."""
    return computed_once(run_steps(docs, scan_steps(tuple(rules)), drop=SCAN_COLUMNS), "diagnostics")


def _finding(rule: str, message: str) -> Column:
    return F.array(
        F.struct(
            F.lit(1).alias("line_no"), F.lit(1).alias("col"), F.lit(rule).alias("rule"), F.lit(message).alias("message")
        )
    ).cast(DIAGNOSTICS_TYPE)


def repair_until_clean(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    max_attempts: int = MAX_ATTEMPTS,
    width: int = LINE_LENGTH,
    max_bytes: int = MAX_MARKDOWN_BYTES,
    stage: str | None = None,
) -> DataFrame:
    """``markdown`` repaired; +is_clean, +attempts, +runs, +diagnostics.

    Each attempt fixes, prepares and scans the documents that are not clean yet. An attempt is one
    narrow job from table to table: its result is written split into settled and open documents, the
    next attempt reads the open part only, and the loop ends when there is none. The result is the
    union of the settled parts, so whatever is done with it later never repairs a document again.

    A document that an attempt no longer changes is charged the remaining attempts at once: they
    would all give the same text and the same findings. ``attempts`` is what is charged, ``runs`` how
    often the document was really repaired. Blank input is clean without an attempt.
    """
    if max_attempts < 1 or width < 1:
        raise ValueError("max_attempts and width must be positive")
    spark = docs.sparkSession
    stage = stage or staging_folder(spark, "repair")
    settled = []
    state = _first_state(docs, width)
    for number in range(1, max_attempts + 1):
        table = f"{stage}/attempt={number}"
        attempted = _attempt(state, number, rules, max_attempts, width, max_bytes)
        attempted.write.mode("errorifexists").partitionBy("open").parquet(table)
        written = spark.read.schema(attempted.schema).parquet(table)
        settled.append(written.filter("not open").drop("open"))
        state = written.filter("open")
        if state.isEmpty():
            break
    result = reduce(DataFrame.unionByName, settled)
    columns = [*[c for c in docs.columns if c != "markdown"], "markdown", "attempts", "runs", "diagnostics"]
    return result.select(*columns, (F.size("diagnostics") == 0).alias("is_clean"))


def _first_state(docs: DataFrame, width: int) -> DataFrame:
    """Documents prepared once; ``open`` is false for blank ones."""
    markdown = F.col("markdown")
    state = docs.withColumn("open", F.coalesce(~tx.is_blank(markdown), F.lit(False)))
    state = state.withColumn("markdown", F.when(F.col("open"), markdown))
    state = run_steps(state, prepare_steps(width), drop=PREPARE_COLUMNS)
    return state.withColumns({"attempts": F.lit(0), "runs": F.lit(0), "diagnostics": F.array().cast(DIAGNOSTICS_TYPE)})


def _attempt(
    state: DataFrame, number: int, rules: Sequence[Rule], max_attempts: int, width: int, max_bytes: int
) -> DataFrame:
    """One attempt. A null ``markdown`` passes the steps untouched, so nothing is done for closed rows."""
    too_large = _finding(TOO_LARGE, "Markdown exceeds the size limit")
    new, old, same, fits = F.col("markdown"), F.col("_old"), F.col("_same"), F.col("_fits")
    is_open, diagnostics = F.col("open"), F.col("diagnostics")
    state = state.withColumn("_old", new).withColumn(
        "markdown", F.when(is_open & tx.within_output_limit(new, max_bytes), new)
    )
    state = run_steps(state, fix_steps() + prepare_steps(width), drop=PREPARE_COLUMNS)
    state = state.withColumns(
        {
            "_same": F.lit(number > 1) & new.eqNullSafe(old),
            "_fits": F.coalesce(tx.within_output_limit(new, max_bytes), F.lit(False)),
            "_before": diagnostics,
            "_old": F.coalesce(new, old, F.lit("")),
        }
    ).withColumn("markdown", F.when(fits & ~same, new))
    state = run_steps(state, scan_steps(tuple(rules)), drop=SCAN_COLUMNS)
    state = state.withColumns(
        {
            "markdown": old,
            "diagnostics": F.when(~is_open | same, F.col("_before")).when(~fits, too_large).otherwise(diagnostics),
            "attempts": F.when(~is_open, F.col("attempts"))
            .when(same | ~fits, F.lit(max_attempts))
            .otherwise(F.lit(number)),
            "runs": F.when(~is_open, F.col("runs")).otherwise(F.lit(number)),
        }
    )
    still_open = is_open & (F.size(diagnostics) > 0) & (F.col("attempts") < max_attempts)
    return state.withColumn("open", still_open).drop("_old", "_same", "_fits", "_before")
