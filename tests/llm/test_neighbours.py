import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import neighbours

VECTORS = "vec_id long, embedding array<double>"


def brute(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors):
        if i % 20 == 0:
            scores = neighbours.summed(vectors, v)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df, k=20):
    out = {}
    rows = neighbours.neighbours(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect()
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {q: [x[1:] for x in rows] for q, rows in out.items()}


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], VECTORS)


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 20)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 24))
    if kind == "clusters":
        vectors = vectors[:60][rng.integers(60, size=3000)] + 0.2 * vectors
    if kind != "lengths":
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = rng.permutation(3000)
    got, want = found(frame(spark, ids, vectors)), brute(ids, vectors, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    exact = dict(zip(ids.tolist(), vectors))
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == neighbours.summed(exact[i][None], exact[q])[0] for i, s in rows)


def test_fewer_probes_where_neighbours_are_near(spark):
    """The chances tell near neighbours from far ones."""
    hashes = neighbours.Hashes(16, 6)
    rng = np.random.default_rng(6)
    units = rng.normal(size=(4000, 17))
    units /= np.linalg.norm(units, axis=1)[:, None]
    buckets = np.unique(hashes.buckets(hashes.projections(units))[:, 0])
    query = hashes.projections(units[:1, :16] / np.linalg.norm(units[0, :16]))[0]
    visits = []
    for cosine in (0.99, 0.8, 0.3):
        chances = np.sort(hashes.chances(query, cosine, 0, buckets))[::-1]
        visits.append(int(np.searchsorted(np.cumsum(chances), 0.8)) + 1)
    assert visits[0] < visits[1] < visits[2]
    assert chances.sum() <= 1 + 1e-6


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [2.0]), (6, []), (None, [9.0, 9.0]), (7, [3.0, 4.0]), (7, [3.0, 4.0]), (8, [0.0, 0.0]), (9, [-1.0, 5.0, 6.0]), (11, [3.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "value", "key", "score", "rank")})
    assert found(df) == {0: [(7, 3.0), (11, 3.0), (5, 2.0), (9, -1.0)]}


def test_hot_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 50)
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(7)
    vectors = np.vstack([np.repeat(rng.normal(size=(1, 6)), 500, axis=0), rng.normal(size=(500, 6))])
    ids = np.arange(1000)
    got, want = found(frame(spark, ids, vectors), 5), brute(ids, vectors, 5)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.95
    assert all(got[q] == want[q] for q in range(0, 500, 20))


def test_large_lengths(spark):
    vectors = np.array([[1e300, 1e300], [1e300, -1e300], [1.0, 2.0], [1e200, 0.0]])
    got = found(frame(spark, np.array([20, 1, 40, 3]), vectors))
    assert [x for x, _ in got[40]] == [20, 3, 1] and len(got[20]) == 3


def test_empty(spark):
    assert found(spark.createDataFrame([], VECTORS)) == {}
    assert found(spark.createDataFrame([(0, [1.0])], VECTORS)) == {}
