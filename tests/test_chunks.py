import random

import pytest
from pyspark.sql import functions as F

from quire.operators import toc

PIECES = "doc_id long, no int, size int, heading boolean, start int"


def greedy(rows, soft, hard):
    out, chunk, size, held = [], 0, rows[0][4], 0
    for _, no, own, heading, _ in rows:
        if held and (size + own > hard or (heading and size > soft)):
            chunk, size, held = chunk + 1, 0, 0
        size, held = size + own, held + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_pointers_equal_the_greedy_walk(spark, block, monkeypatch):
    monkeypatch.setattr(toc, "BLOCK", block)
    rng, rows, want = random.Random(4), [], {}
    for doc in range(120):
        start = rng.choice([0, 30, 250])
        own = [(doc, no, rng.choice([0, 1, 5, 20, 60, 130, 400]), rng.random() < 0.3, start) for no in range(rng.randint(1, 40))]
        rows += own
        want |= {(doc, no): c for no, c in enumerate(greedy(own, 90, 200))}
    got = toc.chunks(spark.createDataFrame(rows, PIECES), 90, 200)
    assert {(r["doc_id"], r["no"]): r["chunk"] for r in got.collect()} == want


def test_a_long_reading(spark):
    n = 100_000
    pieces = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("no"), F.lit(100).alias("size"), (F.col("id") % 50 == 0).alias("heading"), F.lit(0).alias("start"))
    ends = toc.chunks(pieces, 120_000, 250_000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("no").alias("first")).orderBy("chunk").collect()
    # the first heading after 120,000 characters stands at 1,250 pieces
    assert [(r["n"], r["first"]) for r in ends] == [(1250, 1250 * k) for k in range(n // 1250)]
