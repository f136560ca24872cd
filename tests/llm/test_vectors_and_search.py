"""Top-k search, lexical ranking and whitening against brute force, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdloom.llm import lexical, topk, whiten
from mdloom.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, rank int, x string"


def whole(vector):
    return None if vector is None or any(c is None or not math.isfinite(c) for c in vector) else [math.floor(256 * c) for c in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))  # what is missing counts as 0


def by_hand(rows, queries, k=5):
    known = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    out = []
    for q, x in queries:
        scored = sorted(((-product(x, y), math.inf if i is None else i) for i, y in known if i != q))[:k]
        out += [(q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(300)]
    rows[7] = (7, None)
    rows[8] = (8, [0.5, None, 0.1, 0.0, 0.0, 0.0])
    rows[9] = (9, [float("nan")] * 6)
    rows[10] = (10, [float("inf")] + [0.0] * 5)
    rows[11] = (11, [])
    rows[12] = (12, [0.25, -0.5])  # shorter than the others
    rows[50] = (50, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0])  # every score is 0: ties by id
    rows += [(i, rows[100][1]) for i in range(1000, 1100)]  # a hot vector
    rows += [(3, rows[3][1]), (None, rows[150][1]), (None, [0.1] * 6), (100, rows[100][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2, "y") for i, v in rows], VECTORS).repartition(5)


def test_top_k_by_hand(spark, vector_rows, monkeypatch):
    vectors = frame(spark, vector_rows)
    queries = [(i, whole(v)) for i, v in {i: v for i, v in vector_rows if i is not None and i % 50 == 0}.items()]
    expected = by_hand(vector_rows, queries)
    for cells, query_cells in ((1 << 17, 1 << 17), (60, 1 << 17), (200, 12)):  # one block; many blocks; many blocks of queries
        monkeypatch.setattr(topk, "CELLS", cells)
        monkeypatch.setattr(topk, "QUERY_CELLS", query_cells)
        found = topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, found), key=repr) == expected
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.exact_top_k(vectors, vectors.limit(0)).count() == 0
    assert topk.exact_top_k(vectors.filter("vec_id in (0, 1, 2)"), vectors.filter("vec_id = 0")).count() == 2  # fewer candidates than k
    assert topk.exact_top_k(frame(spark, [(0, None), (1, None)]), frame(spark, [(0, None)])).count() == 0


def test_top_k_of_very_large_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [1e12, 1e12])]
    found = topk.exact_top_k(frame(spark, rows), frame(spark, rows[:1])).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_bounds_never_lose_a_candidate(seed, k, size, few_values):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2 if few_values else -300, 3 if few_values else 300, (size, 5))
    ids = rng.permutation(size).astype(np.int64)
    query = rng.integers(-3, 4, 5)
    best_ids, best_scores = topk.SortedLists(ids, x).best(query, int(ids[0]), -np.inf, k)
    expected = sorted((-int(v @ query), int(i)) for i, v in zip(ids[1:], x[1:], strict=True))[:k]
    assert [(-int(s), int(i)) for i, s in zip(best_ids, best_scores, strict=True)] == expected
    if len(expected) == k:  # a bound from an earlier block: ties with it are kept
        again, _ = topk.SortedLists(ids, x).best(query, int(ids[0]), -expected[-1][0], k)
        assert again.tolist() == best_ids.tolist()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked_by_hand(docs, items, top=10):
    known = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, length = len(known), sum(len(t) for _, t in known)
    out = []
    for item, text in set(items):
        wanted, scored = set(terms(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in known) + 1))) for t in wanted}
        for doc, words in known:
            m = 100 - 90 + 90 * len(words) * n_docs // length
            score = sum(weight[t] * (10**9 * words.count(t) // (1000 * words.count(t) + 8 * m)) for t in wanted)
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def test_lexical_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉPSILON", "zeta9", "42", "漢字", "x", "theta"]
    text = lambda n: " ,-_\x00"[rng.integers(5)].join(rng.choice(words, n).tolist())
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, "!!! ..."), (203, "unheard"), (204, "x " * 50_000), (5, docs[5][1]), (None, docs[6][1]), *((i, "theta beta") for i in range(300, 330))]
    items = [(i, text(int(rng.integers(1, 8)))) for i in range(90)]
    items += [(90, None), (91, ""), (92, "nothing known here"), (3, items[3][1]), (3, "theta"), (None, "beta"), (93, "?!")]
    expected = ranked_by_hand(docs, [(i, t) for i, t in items if t])
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, n bigint, score bigint").repartition(4)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, place string")
    for block, tile_terms, tile_docs, tile_items in ((1 << 20, 1024, 512, 64), (200, 3, 7, 5)):
        monkeypatch.setattr(lexical, "TILE_TERMS", tile_terms)
        monkeypatch.setattr(lexical, "TILE_DOCS", tile_docs)
        monkeypatch.setattr(lexical, "TILE_ITEMS", tile_items)
        found = lexical.lexical_search(d, b, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, found), key=repr) == expected
    assert lexical.lexical_search(d.limit(0), b).count() == 0
    assert lexical.lexical_search(d, b.limit(0)).count() == 0


def test_tiles_stay_exact():
    heavy = 2**17 - 1
    many = np.arange(40_000)
    item = (many, np.full(len(many), heavy))
    scores = lexical.tile_scores([item], many, np.zeros(len(many), int), np.full(len(many), lexical.MOST_IMPACT - 1), 1)
    assert scores[0, 0] == 40_000 * heavy * (lexical.MOST_IMPACT - 1) > 2**52
    assert lexical.length_parts(np.array([10**9]), 10**11, 10**15).tolist() == [10 + 90 * 10**20 // 10**15]


@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 6), st.sampled_from([1, 2, 300, 10**6, 2**40, 2**62]))
@settings(max_examples=80, deadline=None)
def test_scatter_is_exact(seed, rows, dims, wide):
    x = np.random.default_rng(seed).integers(-wide, wide, (rows, dims))
    big = x.astype(object)
    assert (np.triu((big.T @ big) - whiten.scatter(x).astype(object) - np.tril((big.T @ big), -1)) == 0).all()


def test_whitening_by_hand(spark, vector_rows):
    rows = [(i, v) for i, v in vector_rows if i != 12]
    kept = [(i, whole(v) or [0] * 6) for i, v in rows if whole(v) is not None]
    x = np.array([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).T @ (fit - sums / n) / n
    values = np.linalg.eigvalsh(centred)[::-1]
    out = whiten.whiten(frame(spark, rows)).collect()
    assert len(out) == 4 * len(kept) and {r.n for r in out} == {n}
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in out)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    deviation = {}
    for (i, _), d in zip(kept, ((n * x - sums) ** 2).sum(axis=1).tolist(), strict=True):
        deviation.setdefault(i, set()).add(d)
    assert all(r.deviation in deviation[r.vec_id] for r in out)
    vectors = np.linalg.eigh(centred)[1][:, ::-1]
    for c in range(4):
        want = sorted(((x - sums / n) @ vectors[:, c] / np.sqrt(values[c])).tolist())
        got = sorted(r.whitened for r in out if r.component == c + 1)
        assert np.allclose(got, want, atol=1e-8) or np.allclose(got, sorted(-w for w in want), atol=1e-8)


def test_whitening_without_variance(spark, vector_rows):
    some = frame(spark, vector_rows)
    for none in (some.limit(0), some.filter("vec_id = 7"), some.filter("vec_id = 20"), some.filter("vec_id >= 1000"), some.filter("vec_id = 11")):
        assert whiten.whiten(none).count() == 0
    line = frame(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(10)])  # one direction only
    assert {r.component for r in whiten.whiten(line).collect()} == {1}
    mixed = whiten.whiten(some)  # vectors of unlike length: filled up with 0
    assert mixed.filter("vec_id = 12").count() == 4 and mixed.filter("vec_id is null").count() == 8


def test_whitening_query(spark):
    out = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01")
    got = out.agg(F.max("identity_error"), F.countDistinct("vec_id"), F.count("*")).first()
    assert got[0] < 1e-4 and got[2] == 4 * got[1]
