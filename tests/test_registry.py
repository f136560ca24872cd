"""Registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, rows_of_frame, rows_of_sql

from __spark_entry__ import entry, oracle_sql, queries
from mdloom.plans.queries import QUERIES
from oracles.statements import STATEMENTS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert rows_of_frame(QUERIES[name](spark, FOLDER)) == rows_of_sql(con, STATEMENTS[name])


def test_every_limit_and_outcome_occurs(spark):
    verdicts = {r["reason"] for r in QUERIES["archive_verdict"](spark, "/root/testdata/sf0.01").collect()}
    assert verdicts == {None, "too_many_entries", "expands_too_far", "unsafe_ratio", "nested_archive", "blocked_media", "unsupported_member", "unreadable_member"}
    limits = {r["reason"] for r in QUERIES["archive_totals"](spark, "/root/testdata/sf0.01").collect()}
    assert limits == {None, "too_many_entries", "expands_too_far", "unsafe_ratio"}
    ended = QUERIES["process_corpus"](spark, "/root/testdata/sf0.01").collect()
    assert {r["outcome"] for r in ended} == {"published", "quarantined", "rejected", "retry", "failed"}
    assert {r["attempts"] - r["runs"] for r in ended if r["outcome"] == "quarantined"} != {0}  # charged beyond what was run
    for name in ("csv_to_markdown", "orders_to_markdown"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").agg({"part_no": "max"}).first()[0] > 0


def test_entry(spark):
    assert not entry(spark).isEmpty()
