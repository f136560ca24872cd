"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import admission as fa
from mdloom.functions import csv_text, html, inline, lint, repair
from mdloom.functions import text as tx
from mdloom.operators import admission, archive, intake, lines, publish, tables
from mdloom.operators import lint as lint_ops
from mdloom.operators import repair as repair_ops
from mdloom.plans import corpus
from mdloom.plans.pipeline import convert_documents, process_documents, process_markdown
from mdloom.sources import tables as st
from mdloom.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]
ROOT = "file:/corpus/in"
NOW = datetime(2024, 1, 30, tzinfo=timezone.utc)
BURST_GAP_SECONDS = 6 * 3600
ORDER_TABLE_BYTES, CSV_BYTES = 64 * 1024, 8 * 1024  # so that groups take several parts
REPORT_REPEATS = 60  # findings so long that reports reach the limit


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark, folder):
    return spread(_table(spark, folder, "documents"))


def _pages(spark, folder):
    return spread(_table(spark, folder, "pages"))


def _defects(spark, folder):
    return corpus.defects(_documents(spark, folder))


def _bodies(spark, folder):
    """Defect documents with normal line ends, split into front_matter and body."""
    return repair_ops.split_front_matter(_defects(spark, folder).withColumn("markdown", tx.normalize_newlines(F.col("markdown"))))


def _files(spark, folder):
    return admission.file_parts(corpus.files(_documents(spark, folder)))


def _members(spark, folder):
    """Bundles of documents, and of order lines: among these every limit is broken, and one archive of seven holds a third of all lines."""
    return corpus.manifest(_documents(spark, folder)).unionByName(corpus.line_manifest(_table(spark, folder, "lineitem")))


def _body_pass(change: Callable[[Column], Column]) -> Query:
    return lambda spark, folder: _bodies(spark, folder).select("doc_id", change(F.col("body")).alias("markdown"))


def _line_pass(change: Callable[[Column], Column]) -> Query:
    """A line function on every line outside fences, as rows."""

    def query(spark, folder):
        rows = lines.mark_fences(_bodies(spark, folder)).filter("not is_boundary and not in_fence")
        return rows.select("doc_id", "line_no", change(F.col("line")).alias("line"))

    return query


def _file_flag(name: str, flag: Callable[[], Column]) -> Query:
    return lambda spark, folder: _files(spark, folder).select("path", flag().alias(name))


def _rule(name: str) -> Query:
    return lambda spark, folder: lint_ops.run_rules(_defects(spark, folder), lint.rules_named(name))


def _scanned(spark, folder):
    return repair_ops.scan_documents(_defects(spark, folder))


def _findings(spark, folder):
    return _scanned(spark, folder).select("doc_id", "name", F.inline("diagnostics"))


def file_parts(spark, folder):
    urls = _pages(spark, folder).withColumnRenamed("url", "path")
    return admission.file_parts(urls).select("page_id", "name", "stem", "suffix")


def decode_text(spark, folder):
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return _documents(spark, folder).select("doc_id", tx.decode_text(content).alias("text"))


def admission_verdict(spark, folder):
    return admission.admission_verdict(_files(spark, folder), ROOT).select("path", "reason")


def reject_report(spark, folder):
    return admission.reject_report(admission_verdict(spark, folder))


def table_to_markdown(spark, folder):
    named = _table(spark, folder, "nation").join(
        _table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return tables.table_to_markdown(named, ["r_name"], ["n_nationkey"], ["n_nationkey", "n_name"])


def orders_to_markdown(spark, folder):
    return tables.table_to_markdown(
        _table(spark, folder, "orders"), ["o_orderpriority"], ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus"], ORDER_TABLE_BYTES
    )


def csv_to_markdown(spark, folder):
    """Orders as CSV with records of three to six fields, under a header of four: texts of bounded size, as many as a month's orders take."""
    quoted = F.concat(F.lit('"'), F.replace("o_orderpriority", F.lit("-"), F.lit('""|')), F.lit('"'))
    fields = F.array(F.col("o_orderkey").cast("string"), quoted, F.col("o_orderstatus"), F.lit("x"), F.lit("a,b"), F.lit(""))
    record = F.array_join(F.transform(F.slice(fields, F.lit(1), (3 + F.col("o_orderkey") % 4).cast("int")), lambda f: F.when(f == "a,b", F.lit('"a,b"')).otherwise(f)), ",")
    month, order = F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.struct("o_orderkey").alias("_order")
    texts = tables.packed_lines(_table(spark, folder, "orders").select(month, order, record.alias("_line")), ["month"], CSV_BYTES)
    return texts.select("month", "part_no", csv_text.csv_to_markdown(F.concat(F.lit("a,b,c,d\r\n"), "text")).alias("markdown"))


def assemble_lines(spark, folder):
    return lines.assemble_lines(lines.explode_lines(_bodies(spark, folder)))


def demote_repeated_h1(spark, folder):
    has_title = tx.front_matter_has_title(F.col("front_matter"))
    return _bodies(spark, folder).select("doc_id", repair.demote_repeated_h1(F.col("body"), has_title).alias("markdown"))


def front_matter_parts(spark, folder):
    return _bodies(spark, folder).select("doc_id", "front_matter", "body")


def cap_report(spark, folder):
    return lint_ops.cap_report(lint_ops.format_diagnostics(_findings(spark, folder)).withColumn("text", F.repeat("text", REPORT_REPEATS)))


def is_clean(spark, folder):
    docs = _defects(spark, folder)
    rules = lint.rules_named("MD013", "MD033", "pragma")
    return lint_ops.is_clean(docs, lint_ops.run_rules(docs, rules))


def merge_latest_valid(spark, folder):
    docs = corpus.seeded(_documents(spark, folder))
    previous = docs.filter(F.col("doc_id") % 3 > 0).select("name", F.concat(F.lit("old "), "name").alias("markdown"))
    scanned = repair_ops.scan_documents(docs, lint.rules_named("MD033", "table_columns"))
    return publish.merge_latest_valid(previous, scanned.filter(F.size("diagnostics") == 0))


def repair_until_clean(spark, folder):
    done = repair_ops.repair_until_clean(_defects(spark, folder))
    return done.select("doc_id", "markdown", "attempts", "runs", "is_clean")


def prepare_documents(spark, folder):
    return repair_ops.prepare_documents(_defects(spark, folder)).select("doc_id", "markdown")


def process_pages(spark, folder):
    """The flagship: pages to Markdown, repaired, checked and routed."""
    done = process_documents(st.docs_from_pages(_pages(spark, folder)))
    return done.select("doc_id", "name", "markdown", "attempts", "outcome", F.size("diagnostics").alias("findings"))


def process_corpus(spark, folder):
    """Pages, and documents behind the gate, some of them unreadable: every outcome arises in one run."""
    pages = convert_documents(st.docs_from_pages(_pages(spark, folder))).withColumn("doc_id", F.col("doc_id") + corpus.PAGE_IDS)
    judged = admission.admission_verdict(admission.file_parts(corpus.seeded_files(_documents(spark, folder))), ROOT)
    lost = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    read = judged.withColumns({"io_error": lost, "io_attempts": (1 + F.col("doc_id") % 7).cast("int"), "markdown": F.when(~lost, F.col("markdown"))})
    columns = ["doc_id", "name", "title", "markdown", "reason", "io_error", "io_attempts"]
    pages = pages.withColumns({"io_error": F.lit(False), "io_attempts": F.lit(1)})
    done = process_markdown(pages.select(*columns).unionByName(read.select(*columns)))
    return done.select("doc_id", "name", "markdown", "attempts", "runs", "outcome", F.size("diagnostics").alias("findings"))


def route_outcome(spark, folder):
    """Verdicts of the gate joined by position with scan results: every outcome occurs."""
    files = admission.admission_verdict(_files(spark, folder), ROOT)
    doc_id = F.regexp_extract("stem", r"doc(\d+)", 1).cast("bigint")
    judged = files.select(doc_id.alias("doc_id"), "reason", (doc_id % 5 == 1).alias("io_error"), (1 + doc_id % 7).alias("io_attempts"))
    scanned = repair_ops.scan_documents(corpus.seeded(_documents(spark, folder)), lint.rules_named("MD033", "MD013"))
    clean = scanned.select("doc_id", (F.size("diagnostics") == 0).alias("is_clean"))
    return publish.route_outcome(judged.join(clean, "doc_id")).select("doc_id", "outcome")


def changed_files(spark, folder):
    files = corpus.files(_documents(spark, folder)).drop("content")
    older = F.when(F.col("length") % 3 == 0, F.col("length") - 1).otherwise(F.col("length"))
    ledger = files.filter(F.col("length") % 7 > 0).withColumn("length", older)
    return intake.changed_files(files, ledger).select("path", "length", "modificationTime")


def debounce(spark, folder):
    return intake.debounce(_table(spark, folder, "events"), "user_id", state="event_type", gap_seconds=BURST_GAP_SECONDS)


def retry_ledger(spark, folder):
    return intake.retry_ledger(corpus.attempts(_table(spark, folder, "events")))


def due_jobs(spark, folder):
    return intake.due_jobs(retry_ledger(spark, folder), NOW)


def _entities(spark, folder):
    return _pages(spark, folder).select("page_id", html.decode_entities(F.col("html")).alias("text"))


def _archives(spark, folder):
    return corpus.archives(_documents(spark, folder))


def archive_members(spark, folder):
    return archive.archive_members(_archives(spark, folder)).withColumn("head", F.hex("head"))


def archive_type_mismatch(spark, folder):
    files = admission.file_parts(_archives(spark, folder)).withColumn("is_zip_file", archive.inspect_archive(F.col("content"))["is_zip_file"])
    return archive.archive_type_mismatch(files).select("path", "is_zip_file", "reason")


def _bundle_parts(spark, folder):
    """Members of the files that are archives by name and content."""
    return archive.expand_bundle(_archives(spark, folder).filter(r"path rlike '[.](zip|epub)$'"))


def expand_bundle(spark, folder):
    return _bundle_parts(spark, folder).withColumn("content", F.hex("content"))


def join_bundle(spark, folder):
    nested = F.hex("content").startswith("504B")
    markdown = F.when(~nested, tx.normalize_newlines(F.decode("content", "UTF-8")))
    return archive.join_bundle(_bundle_parts(spark, folder).withColumn("markdown", markdown)).select("path", "markdown")


QUERIES: dict[str, Query] = {
    # sources
    "file_parts": file_parts,
    "drop_hidden": lambda s, d: admission.drop_hidden(_files(s, d)).select("path", "name"),
    "route_format": lambda s, d: admission.route_format(_files(s, d)).select("path", "format"),
    "decode_text": decode_text,
    "docs_from_pages": lambda s, d: st.docs_from_pages(_pages(s, d)),
    "docs_from_documents": lambda s, d: st.docs_from_documents(_documents(s, d)),
    # admission
    "is_blocked_media_suffix": _file_flag("blocked", lambda: fa.is_blocked_media_suffix(F.col("suffix"))),
    "is_supported_suffix": _file_flag("supported", lambda: fa.is_supported_suffix(F.col("suffix"))),
    "has_media_signature": _file_flag("media", lambda: fa.has_media_signature(F.col("content"))),
    "within_input_limit": _file_flag("fits", lambda: fa.within_input_limit(F.col("length"))),
    "inside_root": _file_flag("inside", lambda: fa.inside_root(F.col("path"), ROOT)),
    "within_output_limit": lambda s, d: _documents(s, d).select("doc_id", tx.within_output_limit(F.col("text"), 20_000).alias("fits")),
    "admission_verdict": admission_verdict,
    "reject_report": reject_report,
    # archives
    "archive_members": archive_members,
    "archive_type_mismatch": archive_type_mismatch,
    "expand_bundle": expand_bundle,
    "join_bundle": join_bundle,
    "member_verdict": lambda s, d: archive.member_verdict(_members(s, d)),
    "archive_totals": lambda s, d: archive.archive_totals(_members(s, d)),
    "archive_verdict": lambda s, d: archive.archive_verdict(_members(s, d)),
    # conversion
    "html_to_markdown": lambda s, d: _pages(s, d).select("page_id", html.html_to_markdown(F.col("html")).alias("markdown")),
    "html_title": lambda s, d: _pages(s, d).select("page_id", html.html_title(F.col("html"), F.col("url")).alias("title")),
    "text_to_markdown": lambda s, d: _documents(s, d).select("doc_id", tx.text_to_markdown(F.col("text")).alias("markdown")),
    "table_to_markdown": table_to_markdown,
    "csv_to_markdown": csv_to_markdown,
    "orders_to_markdown": orders_to_markdown,
    "decode_entities": _entities,
    "converted_size_guard": lambda s, d: _pages(s, d).select("page_id", tx.converted_size_guard(html.html_to_markdown(F.col("html")), 4_000).alias("fits")),
    # lines
    "normalize_newlines": lambda s, d: _defects(s, d).select("doc_id", tx.normalize_newlines(F.col("markdown")).alias("markdown")),
    "split_front_matter": front_matter_parts,
    "front_matter_has_title": lambda s, d: _bodies(s, d).select("doc_id", tx.front_matter_has_title(F.col("front_matter")).alias("has_title")),
    "explode_lines": lambda s, d: lines.explode_lines(_bodies(s, d)),
    "mark_fences": lambda s, d: lines.mark_fences(_bodies(s, d)),
    "classify_lines": lambda s, d: lines.classify_lines(lines.explode_lines(_bodies(s, d))),
    "trim_plain_line": _line_pass(tx.trim_plain_line),
    "assemble_lines": assemble_lines,
    # repair
    "setext_to_atx": _body_pass(repair.setext_to_atx),
    "demote_repeated_h1": demote_repeated_h1,
    "autolink_bare_urls": _line_pass(inline.autolink_bare_urls),
    "autolink_reference_definitions": lambda s, d: lines.explode_lines(_bodies(s, d))
    .filter(r"line rlike '^\\s*\\[[\\s\\S]*?\\]:'")
    .select("doc_id", "line_no", inline.autolink_reference_definitions(F.col("line")).alias("line")),
    "escape_reversed_links": _line_pass(inline.escape_reversed_links),
    "clean_heading_punctuation": _line_pass(inline.clean_heading_punctuation),
    "separate_blocks": _body_pass(repair.separate_blocks),
    "table_blocks": lambda s, d: lines.table_blocks(_bodies(s, d)),
    "table_is_consistent": lambda s, d: lines.table_is_consistent(_bodies(s, d)),
    "repair_tables": _body_pass(repair.repair_tables),
    "collapse_blank_lines": _body_pass(repair.collapse_blank_lines),
    "wrap_paragraphs": _body_pass(repair.wrap_paragraphs),
    "ensure_document_heading": lambda s, d: _bodies(s, d).select("doc_id", repair.ensure_document_heading(F.col("body"), F.col("title")).alias("markdown")),
    "reattach_front_matter": lambda s, d: _bodies(s, d).select("doc_id", repair.reattach_front_matter(F.col("front_matter"), F.col("body")).alias("markdown")),
    "mechanical_fix": lambda s, d: repair_ops.fix_documents(_defects(s, d).withColumn("markdown", tx.normalize_newlines(F.col("markdown")))).select("doc_id", "markdown"),
    "prepare_documents": prepare_documents,
    "repair_until_clean": repair_until_clean,
    # lint
    **{rule.name: _rule(rule.name) for rule in lint.RULES},
    "run_rules": lambda s, d: lint_ops.run_rules(_defects(s, d)),
    "format_diagnostics": lambda s, d: lint_ops.format_diagnostics(_findings(s, d)).select("doc_id", "text"),
    "cap_report": cap_report,
    "is_clean": is_clean,
    "rule_summary": lambda s, d: lint_ops.rule_summary(lint_ops.run_rules(_defects(s, d))),
    # publication
    "output_name": lambda s, d: _defects(s, d).select("doc_id", publish.output_name(F.col("name")).alias("output")),
    "route_outcome": route_outcome,
    "merge_latest_valid": merge_latest_valid,
    "quarantine_rows": lambda s, d: publish.quarantine_rows(_scanned(s, d)),
    "run_report": lambda s, d: publish.run_report(route_outcome(s, d)),
    "empty_document": lambda s, d: _defects(s, d).select("doc_id", publish.empty_document(F.when(F.col("doc_id") % 4 == 0, F.lit(" \n\t ")).otherwise(F.col("markdown"))).alias("markdown")),
    # intake
    "changed_files": changed_files,
    "debounce": debounce,
    "retry_ledger": retry_ledger,
    "due_jobs": due_jobs,
    # pipeline
    "process_pages": process_pages,
    "process_corpus": process_corpus,
}
