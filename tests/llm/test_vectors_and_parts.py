import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import additive, base, graph, recurring


def dot(a, b):
    total = 0.0  # sum() would compensate
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(vectors, k=20):
    out = {}
    for i, v in vectors.items():
        if i % 20:
            continue
        ranked = sorted((-dot(vectors[j], v), j) for j in vectors if j != i)[:k]
        out[i] = [(j, -s) for s, j in ranked]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    x[300:500] = x[7] + rng.normal(scale=1e-3, size=(200, 16))  # a large group of near copies
    x[500:560] = x[9]  # and one of exact copies
    return {i: [float(np.float32(a)) for a in v] for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))}


def test_recall_ties_and_scores(spark, vectors):
    rows = [(i, v, 1) for i, v in vectors.items()]
    odd = [(1001, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [math.inf] * 16, 0), (1100, [1.0], 0), (None, [1.0] * 16, 0)]
    docs = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, vector int")
    got = {}
    for r in additive.nearest(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(vectors)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        for j, s in found:
            assert s == pytest.approx(sum(a * b for a, b in zip(vectors[q], vectors[j])), abs=1e-12)
    assert got[500] == want[500]  # exact copies: ties go to the smaller ids


@pytest.mark.parametrize("cell_rows", [64, 4])
def test_recall_on_the_test_table(spark, cell_rows, monkeypatch):
    """Against brute force over the whole table: in one cell, and in cells of few vectors."""
    monkeypatch.setattr(additive, "CELL_ROWS", cell_rows)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    hits = total = 0
    got = {}
    for r in additive.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len(got[ids[i]] & set(best.tolist())), total + 20
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.93 * total, hits / total


@pytest.mark.parametrize("cell_rows", [64, 1])
def test_rows_found_for_a_query_are_bounded(spark, vectors, cell_rows, monkeypatch):
    """Blocks and rounds of few vectors: each gives a query k + 1 rows at most, equal vectors are listed once, and
    what is found is what one block finds."""
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    n_queries, k, written = len(vectors) // 20, 4, []
    monkeypatch.setattr(additive, "CELL_ROWS", cell_rows)
    run = lambda: [tuple(r) for r in additive.nearest(table, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect()]
    whole = run()

    def watched(df):
        out = base.materialise(df)
        if "query" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(additive, "materialise", watched)
    monkeypatch.setattr(additive, "ROW_BLOCK", 80)
    monkeypatch.setattr(additive, "GROWTH", 3, raising=False)
    found = run()
    assert 2 <= len(written) and max(written) <= n_queries * (k + 1) * 6, written
    want = {q: {j for j, _ in near} for q, near in brute(vectors, k).items()}
    for result in (whole, found):
        assert len(result) == n_queries * k
        assert sum(j in want[q] for q, _, j, _ in result) >= 0.9 * n_queries * k
    assert sum(a in set(whole) for a in found) >= 0.9 * len(found)


def test_few_vectors_in_the_first_cells(spark, monkeypatch):
    """A query goes on to further cells until they hold enough vectors."""
    monkeypatch.setattr(additive, "CELL_ROWS", 0)
    monkeypatch.setattr(additive, "probes", lambda *_: 1)
    x = np.random.default_rng(5).normal(size=(90, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = additive.nearest(table, F.col("vec_id") % 20 == 0, 7).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in counts) == [(q, 7) for q in range(0, 90, 20)]


def test_doubles_are_scored_as_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 1e300 if i == 7 else 0.5]) for i in range(45)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in additive.nearest(docs.where("vec_id <> 7"), F.col("vec_id") % 20 == 0).where("query_id = 40").orderBy("rank").collect()]
    want = brute({i: v for i, v in rows if i != 7})[40]
    assert got == want


def test_small_and_empty_tables(spark):
    make = lambda n: spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    assert additive.nearest(make(0), F.col("vec_id") % 20 == 0).count() == 0
    assert additive.nearest(make(1), F.col("vec_id") % 20 == 0).count() == 0
    assert [r.vec_id for r in additive.nearest(make(4), F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [3, 2, 1]


def test_beam_is_no_worse_than_greedy():
    x = np.random.default_rng(1).normal(size=(500, 12)).astype(np.float32)
    books = additive.learn(x, books=4, words=16)
    wide, narrow = (np.square(additive.encode(x, books, b)[1]).sum() for b in (8, 1))
    assert wide <= narrow
    codes, rest = additive.encode(x, books)
    assert np.allclose(books[np.arange(4), codes].sum(1) + rest, x, atol=1e-4)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {j: 100 for j in range(100, 120)} | {200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_filter_loses_no_key(spark):
    rows = [(int(k), d) for k in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000) for d in ((1, 2) if k % 2 else (1, 1))]
    filter_, n = recurring.recurring_filter(spark.createDataFrame(rows, "key long, doc_id long"))
    keys = np.array([k for k, _ in rows[::2]], np.int64)
    ok = recurring.passes(keys, filter_.value)
    assert ok[keys % 2 == 1].all() and n == (keys % 2 == 1).sum() and ok[keys % 2 == 0].mean() < 0.2


def test_kth_largest(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=500), np.full(50, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 100, 300, 552):
        assert base.kth_largest(df, "v", k) == sorted(x)[-k]
    assert base.kth_largest(df, "v", 553) is None and base.kth_largest(df.limit(0), "v", 1) is None


def test_minimisers_cover_every_window():
    h = base.mixed(np.random.default_rng(0).integers(0, 40, 500).astype(np.uint64))
    at = set(base.minimisers(h, 7).tolist())
    for i in range(len(h) - 6):
        assert {i + j for j in range(7) if h[i + j] == h[i : i + 7].min()} <= at
