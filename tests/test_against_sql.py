"""Random documents through every pass in Spark and, written independently, in DuckDB."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mdloom.functions import repair
from mdloom.functions import text as tx
from mdloom.operators import lint as lint_ops
from mdloom.operators import lines as line_ops
from mdloom.operators import repair as repair_ops
from oracles import markdown as o

SNIPPETS = [
    "", "", " ", "  ", "   ", "\t", "plain text", "two  words  ", "ends with slash\\", "trailing ", "# One", "# Two?",
    "#", "# ", "## Sub :", "##  Spaced  .", "###\tTab", "####### seven", " # shifted", "    # code", "===", "---", "----",
    "= = =", " --", "   ===", "    ===", "- item", "* star", "1. one", "2) two", "  - nested", "    - deep", "\t- tab",
    "-", "-no", "+ plus", "```", "````", "```text", "``` a`b", "~~~", "~~~~", "~~~ x ~ y", "  ```", "    ```", "``",
    "| a | b |", "| --- | --- |", "| --- |", "| a \\| b | c |", "|", " | x |", "    | code |", "| long " + "cell " * 40 + "|",
    "> quote", "[ref]: target", "[x](y) link", "see (a)[b]", "`(c)[d]` and (e)[f]", "[w]: www.example.com",
    "go https://example.com/a. now", "(https://example.com/b)", "www.example.com!", "<https://kept.example>", "<b>bold</b>",
    "<!-- pyml disable -->", "<!-- pyml disable MD013 -->", " ", "　wide　", "word " * 40, "x" * 130,
    "tail " + "y" * 125 + " end", "+++", "title: T", "1", " sep", "a b",
]


def corpus(seed: int, n: int) -> pd.DataFrame:
    rng = random.Random(seed)
    docs = []
    for doc_id in range(n):
        lines = [rng.choice(SNIPPETS) for _ in range(rng.randint(0, 14))]
        if rng.random() < 0.15:
            marker = rng.choice(["---", "+++"])
            lines = [marker, rng.choice(["title: x", "Title : y", "other: z", "# c"]), marker, *lines]
        docs.append((doc_id, f"t*{doc_id}!", rng.choice(["\n", "\n", "\n", "\r\n"]).join(lines)))
    return pd.DataFrame(docs, columns=["doc_id", "title", "md"])


@pytest.fixture(scope="module")
def both(spark):
    pdf = corpus(7, 1500)
    con = duckdb.connect()
    con.register("src", pdf)
    docs = spark.createDataFrame(pdf).withColumnRenamed("md", "markdown").repartition(8).cache()
    return docs, con


def same(frame, con, sql):
    got = sorted(map(tuple, frame.collect()), key=repr)
    expected = sorted(con.execute(sql).fetchall(), key=repr)
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    assert len(got) == len(expected)
    assert not wrong, f"{len(wrong)} of {len(got)} differ, first: {wrong[0]}"


BODIES = [("n", f"select doc_id, title, {o.normalized('md')} as md from src")] + o.front("f", "n")


def bodies(docs):
    return repair_ops.split_front_matter(docs.withColumn("markdown", tx.normalize_newlines(F.col("markdown"))))


@pytest.mark.parametrize("name", ["setext_to_atx", "separate_blocks", "repair_tables", "collapse_blank_lines", "wrap_paragraphs"])
def test_body_pass(both, name):
    docs, con = both
    sql = {
        "setext_to_atx": o.setext, "separate_blocks": o.separate, "repair_tables": o.tables,
        "collapse_blank_lines": o.collapse, "wrap_paragraphs": o.wrap,
    }[name]
    frame = bodies(docs).select("doc_id", getattr(repair, name)(F.col("body")))
    same(frame, con, o.statement(BODIES + sql("r", "f_out"), "select doc_id, md from r_out"))


def test_fences(both):
    docs, con = both
    frame = line_ops.mark_fences(bodies(docs)).select("doc_id", "line_no", "line", "is_boundary", "in_fence")
    same(frame, con, o.statement(BODIES + o.lines("l", "f_out"), "select doc_id, line_no, line, bnd, inside from l_ln"))


def test_prepare(both):
    docs, con = both
    same(
        repair_ops.prepare_documents(docs).select("doc_id", "markdown"),
        con,
        o.statement(o.prepare("r", "src", "src"), "select doc_id, md from r"),
    )


def test_scan(both):
    docs, con = both
    frame = lint_ops.run_rules(docs).select("doc_id", "line_no", "col", "rule")
    same(frame, con, o.statement(o.scan("g", "src"), "select doc_id, line_no, col, rule from g"))


def test_loop_invariants(both):
    docs, _ = both
    done = repair_ops.repair_until_clean(docs).cache()
    assert done.count() == docs.count()
    assert done.filter("is_clean != (size(diagnostics) = 0)").isEmpty()
    assert done.filter("not is_clean and attempts != 5").isEmpty()
    clean = done.filter("is_clean and markdown != ''").select("doc_id", "markdown")
    assert not clean.isEmpty()
    assert lint_ops.run_rules(clean).isEmpty()
