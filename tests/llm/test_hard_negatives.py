import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives, vectors
from quire.llm.hard_negatives import hard_negatives as mine

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, scale=256, positives=5, negatives=10):
    """rows: (id, label, whole vector), different from each other."""
    out = []
    for a, label, vector in rows:
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in rows if i != a)
        for ps, p in [(-s, i) for s, i, other in scores if other == label][:positives]:
            fits = [(i, -s) for s, i, other in scores if other != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def found(df, **more):
    got = mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread", [1.0, 0.15])
def test_equals_brute_force(spark, spread, monkeypatch):
    for module, name, value in ((hard_negatives, "CENTROIDS", 9), (vectors, "LIST_ROWS", 40), (hard_negatives, "LIST_ROWS", 40), (hard_negatives, "QUERY_ROWS", 3), (hard_negatives, "SAMPLE_ROWS", 200), (hard_negatives, "ROUNDS", (1, 3, 1 << 30))):
        monkeypatch.setattr(module, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + spread * rng.normal(size=8)).tolist(), int(rng.integers(4))) for k in range(700)]
    rows += [(1000 + k, centres[0].tolist(), k % 3) for k in range(250)]  # a hot vector, many ties
    whole = [(i, label, np.floor(np.array(v) * 32).astype(int).tolist()) for i, v, label in rows]
    want = brute(whole)
    assert len(want) > 100 and found(spark.createDataFrame(rows, VECTORS), scale=32.0) == want


def test_lists_are_skipped(spark, monkeypatch):
    """Far clusters are neither searched nor needed."""
    monkeypatch.setattr(hard_negatives, "CENTROIDS", 16)
    rng = np.random.default_rng(4)
    axes = np.eye(16)
    rows = [(k, (axes[k % 16] + 0.01 * rng.normal(size=16)).tolist(), 0) for k in range(800)]
    df = spark.createDataFrame(rows, VECTORS).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("value"))
    lists = hard_negatives.Lists(df, 1000.0)
    win = [{"slot": 0, "low": -(1 << 63), "high": (1 << 63) - 1, "least": 900_000}]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"value": rows[0][1], "wins": win}], pa.schema([("value", pa.list_(pa.float64())), ("wins", pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("least", pa.int64())])))]))
    out = next(hard_negatives._visits(lists.centroids, lists.radii, 1000.0, 0, 1 << 30)(iter([batch])))
    assert 1 <= len(out.column("clusters")[0].as_py()) < 8


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0], 1), (6, [], 2), (None, [0.5, 0.5], 2)]
    rows += [(7, [0.5, 9.0], 2), (7, [0.5, 9.0], 2), (8, [0.9], 2), (9, [0.91], 2), (10, [0.3], None), (11, [0.3, 0.0, 4.0], 3), (12, [0.29], 3), (100, [0.0, -1.0], 1), (200, [1e300], 5), (201, [1e300], 5)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("clash")).withColumn("rank", F.lit("clash")).withColumn("id", F.lit("clash"))
    whole = [(0, 1, [100, 0]), (5, 1, [100]), (6, 2, []), (7, 2, [50, 900]), (8, 2, [90]), (9, 2, [91]), (11, 3, [30, 0, 400]), (12, 3, [29]), (100, 1, [0, -100])]
    want = [r for r in brute(whole) if r[0] in (0, 100)]
    assert [r for r in found(df, scale=100.0) if r[0] in (0, 100) and r[1] < 200 and r[3] < 200] == want and want
    # scores beyond a long stand at its end
    assert all(r[4] <= (1 << 63) - 1 for r in found(df, scale=100.0))


def test_empty(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(0, [1.0], 0)], VECTORS)) == []
    assert found(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], VECTORS)) == []
