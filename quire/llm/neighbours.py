"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are divided by the greatest length of all and get one more component that makes them unit vectors; queries are made unit vectors. So the largest
inner product is the smallest distance. Each of TABLES tables has its own HASHES functions floor((a·x + b) / WIDTH) with normal a (fewer functions where the table is small,
so that a bucket holds BUCKET_ROWS rows or so); a bucket is one value of each, cut to four cells a function.

A query's buckets are its own and those around it, visited in the order of their estimated success: given the query's projections, those of a row of cosine c are
normal around c times them, with variance 1 - c², so that the chance to fall into a bucket is a product over its cells. First the likeliest buckets with FIRST times k rows in each table are
searched. The k-th product found there bounds c from below, and with it the query goes on to as many further buckets as make the chance that one of the true
neighbours is met in any of the tables TARGET; a query that found fewer than k, or whose buckets in use never come to that chance, visits all buckets, so nothing is capped. The
tables' candidates are ranked by their exact products.

Buckets are cut into packs of rows and queries meet them in packs, so that a bucket of a third of all rows is as many tasks. The directory of buckets in use, 4**HASHES entries a table
at most, is all that reaches the driver.

Rows without an id, and vectors that are null, zero or hold null or non-finite components take no part. Shorter vectors count as filled up with zeros. A row is
known by its id: a query's own id is no candidate for it, repeated rows with one id and equal vectors count once, and an id with several vectors is several candidates, and several
queries, whose results stand together. Ties go to the smaller id. Products are summed in doubles from the first component to the last; one
beyond a double is infinite, and one that is no number counts as the lowest. A query without any candidate has no row. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, saved
from quire.llm.vectors import LIST_ROWS, QUERY_ROWS, chunked, component_type, matrix, members, met, sound
from quire.shipping import ship

TABLES, HASHES, WIDTH, CELLS = 2, 8, 2.5, 4
#: Rows of a bucket that set the number of functions, and the cells of a function that are in use, about.
BUCKET_ROWS, CELLS_USED = 1024, 2.6
FIRST = 16
#: Chance to meet a neighbour in any table.
TARGET = 0.97
SEED = 20
#: The standard normal distribution, by points.
_POINTS = np.linspace(-8.0, 8.0, 3201)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _POINTS])


class Hashes:
    """The functions of all tables, for unit vectors of `width` components and one more."""

    def __init__(self, width: int, functions: int):
        made = np.random.default_rng(SEED)
        self.functions = functions
        self.a = made.standard_normal((width + 1, TABLES * functions))
        self.b = made.uniform(0, WIDTH, TABLES * functions)
        # cells' ends, the outer ones open
        inner = (np.arange(1, CELLS) - CELLS // 2)[None, :] * WIDTH - self.b[:, None]
        self.ends = np.hstack([np.full((len(inner), 1), -np.inf), inner, np.full((len(inner), 1), np.inf)])

    def projections(self, units: np.ndarray) -> np.ndarray:
        """Of unit vectors whose last component may be left out where it is zero."""
        return units @ self.a[: units.shape[1]]

    def buckets(self, projections: np.ndarray) -> np.ndarray:
        """One number a table."""
        cells = np.clip(np.floor((projections + self.b) / WIDTH) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
        return (cells.reshape(len(cells), TABLES, self.functions) * CELLS ** np.arange(self.functions)).sum(axis=2)

    def chances(self, projections: np.ndarray, cosine: float, table: int, buckets: np.ndarray) -> np.ndarray:
        """For one query, the chance that a row of this cosine is in each of the buckets."""
        own = slice(table * self.functions, (table + 1) * self.functions)
        spread = math.sqrt(max(1 - cosine * cosine, 1e-12))
        below = np.interp((self.ends[own] - cosine * projections[own, None]) / spread, _POINTS, _NORMAL)
        cells = np.diff(below, axis=1)
        out = np.ones(len(buckets))
        for f in range(self.functions):
            out *= cells[f, buckets // CELLS**f % CELLS]
        return out


def _units(rows: np.ndarray, longest: float) -> np.ndarray:
    shorter = rows / longest
    return np.hstack([shorter, np.sqrt(np.maximum(0, 1 - (shorter**2).sum(axis=1)))[:, None]])


def _hashed(hashes: Hashes, width: int, longest: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = hashes.buckets(hashes.projections(_units(matrix(batch.column("value"), width), longest)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(own), pa.list_(pa.int64()))], names=[*batch.schema.names, "buckets"])

    return work


def _probes(hashes: Hashes, width: int, longest: float, directory: list[tuple[np.ndarray, np.ndarray]], k: int, further: bool):
    """Adds `probes` (table, bucket): a query's first buckets, or those that the k-th product found in them (`least`) asks for."""
    need = 1 - (1 - TARGET) ** (1 / TABLES)

    def first(chances: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.argsort(-chances, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(rows[order]), FIRST * k)) + 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("value"), width)
            most = np.abs(rows).max(axis=1, initial=0)
            lengths = np.minimum(most * np.sqrt(((rows / most[:, None]) ** 2).sum(axis=1)), np.finfo(float).max) if len(rows) else most
            projections = hashes.projections(rows / lengths[:, None])
            least = batch.column("least").to_pylist()
            out = []
            for q in range(len(rows)):
                probes = []
                for t, (buckets, counts) in enumerate(directory):
                    guess = first(hashes.chances(projections[q], 0.5, t, buckets), counts)
                    if not further:
                        chosen = guess
                    elif least[q] is None or not math.isfinite(least[q]):
                        chosen = np.setdiff1d(np.arange(len(buckets)), guess)
                    else:
                        chances = hashes.chances(projections[q], min(1.0, max(-1.0, least[q] / lengths[q] / longest)), t, buckets)
                        order = np.argsort(-chances, kind="stable")
                        chosen = np.setdiff1d(order[: int(np.searchsorted(np.cumsum(chances[order]), need)) + 1], guess)
                    probes += [{"table": t, "bucket": int(b)} for b in buckets[chosen]]
                out.append(probes)
            kind = pa.list_(pa.struct([("table", pa.int32()), ("bucket", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "probes"])

    return work


def summed(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component on."""
    if not rows.shape[1]:
        return np.zeros(len(rows))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.cumsum(rows * query, axis=1)[:, -1], nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _searches(k: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for row in range(batch.num_rows):
                listed, asking = members(batch, "list", row), members(batch, "queries", row)
                ids, vectors = listed.field("id").to_numpy(zero_copy_only=False), matrix(listed.field("value"), width)
                keys, own_ids = (asking.field(f).to_numpy(zero_copy_only=False) for f in ("key", "id"))
                queries, least = matrix(asking.field("value"), width), asking.field("least").to_pylist()
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.nan_to_num(queries @ vectors.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * math.sqrt(float((vectors**2).sum(axis=1).max(initial=0)))
                for q in range(len(keys)):
                    # the order of sums differs from one product to the other by less than the slack
                    near = np.nan_to_num(slack[q], nan=np.inf, posinf=np.inf)
                    at = np.flatnonzero(ids != own_ids[q])
                    cut = -np.inf if least[q] is None else least[q] - near
                    if len(at) > k:
                        cut = max(cut, np.partition(scores[q, at], len(at) - k)[len(at) - k] - near)
                    at = at[~(scores[q, at] < cut)]
                    exact = summed(vectors[at], queries[q])
                    for j in np.lexsort((ids[at], -exact))[:k]:
                        out.append((int(keys[q]), int(ids[at[j]]), float(exact[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["key", "id", "score"])

    return work


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each row for which `queries` holds."""
    spark = vectors.sparkSession
    kind = component_type(vectors, vector_col)
    value = F.col(vector_col).cast(f"array<{kind}>")
    taking = F.col(id_col).isNotNull() & sound(value) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(taking).select(F.col(id_col).cast("long").alias("id"), value.alias("value"), queries.alias("asks"))
    most = F.array_max(F.transform("value", lambda x: F.abs(x).cast("double")))
    length = F.least(most * F.sqrt(F.aggregate("value", F.lit(0.0), lambda a, x: a + (x / most) * (x / most))), F.lit(float(np.finfo(float).max)))
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("value")), F.max(length)).first()
    width, longest = width or 0, longest or 1.0
    functions = max(2, min(HASHES, round(math.log(max(n, 1) / BUCKET_ROWS) / math.log(CELLS_USED)) if n > BUCKET_ROWS else 0))
    hashes = Hashes(width, functions)
    unlike = rows.drop("asks").dropDuplicates()
    hashed = saved(map_arrow(unlike, _hashed(hashes, width, longest), f"id long, value array<{kind}>, buckets array<long>"))
    placed = hashed.select("id", "value", F.posexplode("buckets").alias("table", "bucket"))
    # CELLS ** HASHES rows a table at most
    found = placed.groupBy("table", "bucket").count().orderBy("table", "bucket").collect()
    directory = [(np.array([r["bucket"] for r in found if r["table"] == t], np.int64), np.array([r["count"] for r in found if r["table"] == t], np.int64)) for t in range(TABLES)]
    sizes = spark.createDataFrame([(r["table"], r["bucket"], -(-r["count"] // LIST_ROWS)) for r in found], "table int, bucket long, chunks int")
    lists = saved(chunked(placed, sizes, ["table", "bucket"], ["id", "value"]))

    asking = saved(rows.where("asks").select("id", "value").dropDuplicates().withColumn("key", F.xxhash64("id", "value")))
    blocks = max(1, -(-asking.count() // QUERY_ROWS))

    def search(asked: DataFrame, further: bool) -> DataFrame:
        schema = f"key long, id long, value array<{kind}>, least double, probes array<struct<table:int,bucket:long>>"
        visits = map_arrow(asked.select("key", "id", "value", "least"), _probes(hashes, width, longest, directory, k, further), schema)
        sent = visits.select("key", "id", "value", "least", F.inline("probes"))
        pairs = met(sent, lists, sizes, ["table", "bucket"], ["key", "id", "value", "least"], blocks)
        return map_arrow(pairs, _searches(k, width), "key long, id long, score double")

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        return rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    begun = saved(ranked(search(asking.withColumn("least", F.lit(None).cast("double")), False)))
    kth = begun.where(F.col("rank") == k).select("key", F.col("score").alias("least"))
    rest = search(asking.join(kth, "key", "left"), True)
    best = ranked(begun.drop("rank").unionByName(rest))
    return best.join(asking.select("key", F.col("id").alias("query_id")), "key").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ship(__name__)
