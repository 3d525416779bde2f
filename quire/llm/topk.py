"""Exact top-k search by inner product with norm buckets.

A vector's components x become floor(scale * x). Candidates are grouped by length into bands, whose lengths lie within a factor of each other. The
longest bands, GROUP_ROWS rows or more, are searched first, for all queries; each query's k-th best score there is its threshold. A query goes on
to a shorter band only if the product of the band's greatest length and its own reaches the threshold; so a band's rows are sent only to blocks of queries that
may find something in it.

A band's rows are dealt over groups by a hash of their id, and each group is read in order of falling
length. A group's rows fall into buckets: runs of at most BUCKET_ROWS rows whose lengths lie within a factor of each other.
For each query and bucket, the query's k-th best score so far over the product of lengths is the least cosine that still counts, the local threshold:
- over 1, no row of this or any later bucket can enter, and the group is done for the query (length pruning);
- high, rows whose coordinates in the query's largest dimensions lie outside the range that the threshold allows are passed over
  (coordinate pruning);
- else all rows long enough are taken.
What is left is verified by whole inner products. Each group gives k rows a query at most; the best k of all groups are the result.
Queries meet the candidates in blocks of about QUERY_ROWS.

Vectors that are null or hold null or non-finite components take no part, as queries or candidates. Rows without an id take no part. Shorter
vectors count as filled up with zeros, however long others are. A row is known by its id: a query's own id is no candidate for it, repeated rows with one id and equal
vectors count once, and an id with several vectors is several candidates, and several queries, whose results stand together. Scores beyond a long are set to its ends.
Ties go to the smaller id. A query without any candidate has no row. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, saved
from quire.shipping import ship

QUERY_ROWS = 2048
#: Candidates of a group, about.
GROUP_ROWS = 1 << 13
#: A band ends where lengths fall below this part of its upper end.
BAND_RATIO = 0.9
BUCKET_ROWS = 1024
#: Buckets end where lengths fall below this part of their first row's.
BUCKET_RATIO = 0.9
#: Local thresholds from which coordinates prune more than their cost, and how many coordinates are looked at.
COORDINATE_FROM, COORDINATES = 0.6, 4


class Best:
    """The k best (score, id) for each query of a block, higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), ascending
        self.least = np.full(len(ids), -np.inf)  # k-th best score
        self.done = np.zeros(len(ids), bool)

    def bucket(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        """Take a bucket's rows into account; lengths don't rise from row to row or bucket to bucket."""
        reach = self.lengths * lengths[0]
        self.done |= self.least > reach * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, self.least / reach, -np.inf)
        pruned = ~self.done & (local >= COORDINATE_FROM)
        for q in np.flatnonzero(pruned):
            rows = self._by_coordinates(q, vectors, lengths)
            if len(rows):
                self._add(q, ids[rows], self._products(vectors[rows], self.vectors[q]))
        plain = np.flatnonzero(~self.done & ~pruned)
        if len(plain):
            # rows long enough for the least demanding query of these
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(self.lengths[plain] > 0, self.least[plain] / self.lengths[plain], -np.inf).min()
            n = int(np.searchsorted(-lengths, -needed * (1 - 1e-9), "right")) if needed > 0 else len(lengths)
            scores = self._products(self.vectors[plain], vectors[:n].T)
            for row, q in enumerate(plain):
                self._add(q, ids[:n], scores[row])

    def _by_coordinates(self, q: int, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        query = self.vectors[q].astype(np.float64) / self.lengths[q]
        least = np.minimum(self.least[q] / (self.lengths[q] * np.maximum(lengths, 1e-300)), 1.0)
        rows = np.flatnonzero(self.least[q] <= self.lengths[q] * lengths * (1 + 1e-9))
        for f in np.argsort(-np.abs(query))[: min(COORDINATES, len(query))]:
            t = least[rows]
            middle = query[f] * t
            spread = np.sqrt(np.maximum((1 - t * t) * (1 - query[f] ** 2), 0)) + 1e-9
            x = vectors[rows, f].astype(np.float64) / np.maximum(lengths[rows], 1e-300)
            # a row of cosine t or more has its coordinate in this range; one of a larger cosine may only have it nearer to the query's
            low = np.where(query[f] >= 0, middle - spread, -1 - 1e-9)
            high = np.where(query[f] >= 0, 1 + 1e-9, middle + spread)
            rows = rows[(x >= low) & (x <= high)]
        return rows

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles below 2**53, else in integers of any size."""
        if a.dtype == object or b.dtype == object:
            return a.astype(object) @ b.astype(object)
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, b.shape[0])
        if most < 2**53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a.astype(object) @ b.astype(object)

    def _add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.found[q]) >= self.k:
            keep = np.flatnonzero(scores >= self.found[q][-1][0] * -1)
        else:
            keep = np.arange(len(ids))
        keep = keep[ids[keep] != self.ids[q]]
        if not len(keep):
            return
        if len(keep) > 4 * self.k and scores.dtype != object:
            cut = np.partition(scores[keep], len(keep) - self.k)[len(keep) - self.k]
            keep = keep[scores[keep] >= cut]
        self.found[q] = sorted([*self.found[q], *((-int(scores[i]), int(ids[i])) for i in keep)])[: self.k]
        if len(self.found[q]) == self.k:
            self.least[q] = -self.found[q][-1][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for q, found in zip(self.ids, self.found, strict=True):
            for score, other in found:
                yield int(q), other, min(max(-score, -(1 << 63)), (1 << 63) - 1)


def buckets(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(lengths):
        end = min(start + BUCKET_ROWS, len(lengths))
        end = min(end, start + max(1, int(np.searchsorted(-lengths[start:end], -lengths[start] * BUCKET_RATIO, "right"))))
        yield start, end
        start = end


def _whole(values: list[list[float]], scale: float) -> np.ndarray:
    """floor(scale * x), one row a vector; integers of any size where they don't fit into 64 bits."""
    width = max(map(len, values), default=0)
    out = np.zeros((len(values), width))
    for row, value in enumerate(values):
        out[row, : len(value)] = value
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0) < 2**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object)


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=0) if a.shape[1] < width else a


def _searches(k: int, scale: float):
    """Rows ordered by task, queries before candidates, candidates by falling length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, queries, best = None, [], None

        def results() -> pa.RecordBatch:
            found = list(best.rows()) if best is not None else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            tasks = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end in _runs(tasks):
                if tasks[start] != task:
                    yield results()
                    task, queries, best = tasks[start], [], None
                part = batch.slice(start, end - start)
                kind = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                ids, values = part.column(2).to_numpy(), part.column(3).to_pylist()
                n = int(kind.sum())
                queries += zip(ids[:n].tolist(), values[:n], strict=True)
                if n == len(ids):
                    continue
                if best is None and queries:
                    best = Best(np.array([x for x, _ in queries], np.int64), _whole([x for _, x in queries], scale), k)
                if best is None:
                    continue
                vectors = _whole(values[n:], scale)
                width = max(vectors.shape[1], best.vectors.shape[1])
                vectors, best.vectors = _widened(vectors, width), _widened(best.vectors, width)
                lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
                order = np.argsort(-lengths, kind="stable")  # as they come, but for rounding
                for a, b in buckets(lengths[order]):
                    at = order[a:b]
                    best.bucket(ids[n:][at], vectors[at], lengths[at])
        yield results()

    return work


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _search(rows: DataFrame, asking: DataFrame, groups: DataFrame, k: int, scale: float) -> DataFrame:
    """query_id, vec_id, score: the best k of each group of the bands (groups: band, groups) that queries (asking: id, value, band, block) go to."""
    placed = asking.join(groups, "band")
    sent = placed.select("band", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "block", "id", "value")
    # as many numbers a band as there are blocks of queries, not one a query
    blocks = asking.groupBy("band").agg(F.collect_set("block").alias("blocks"))
    dealt = rows.join(groups, "band").withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int"))
    met = dealt.join(blocks, "band").select("band", "group", F.explode("blocks").alias("block"), "id", "value", "length")
    task = F.concat_ws(":", F.col("band").cast("string"), F.col("group").cast("string"), F.col("block").cast("string")).alias("task")
    both = sent.select(task, F.lit(True).alias("query"), "id", "value", F.lit(0.0).alias("length")).unionByName(met.select(task, F.lit(False).alias("query"), "id", "value", "length"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "task").sortWithinPartitions(F.col("task"), F.col("query").desc(), F.col("length").desc(), F.col("id"))
    return map_arrow(ordered.select("task", "query", "id", "value"), _searches(k, scale), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row for which `queries` holds."""
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & _sound(value)).select(F.col(id_col).cast("long").alias("id"), value.alias("value"), queries.alias("asks")).dropDuplicates(["id", "value"])
    whole = F.transform("value", lambda x: F.floor(x * scale).cast("double"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)))
    # zero, and lengths beyond a double, are the last and the first band
    band = F.when(F.col("length") == 0, 1_000_000).when(F.col("length") == float("inf"), -1_000_000).otherwise(F.floor(F.log("length") / math.log(BAND_RATIO)))
    rows = saved(rows.withColumn("band", band.cast("int")))
    # some 14,000 bands at most, whatever the table
    bands = sorted((r["band"], r["n"], r["asking"], r["most"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), F.max("length").alias("most")).collect())
    held, first = 0, 0
    while first < len(bands) and held < GROUP_ROWS:
        held += bands[first][1]
        first += 1
    sizes = spark.createDataFrame([(b, max(1, -(-n // GROUP_ROWS))) for b, n, _, _ in bands], "band int, groups int")
    blocks = max(1, -(-sum(x[2] for x in bands) // QUERY_ROWS))
    asking = rows.where("asks").select("id", "value", "length", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    to = lambda part: F.explode(F.from_json(F.lit(str([x[0] for x in part])), "array<int>")).alias("band")
    found = saved(_search(rows, asking.select("id", "value", "block", to(bands[:first])), sizes, k, scale))
    if first < len(bands):
        least = _ranked(found, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        ends = F.from_json(F.lit(str([{"band": b, "most": m} for b, _, _, m in bands[first:]]).replace("'", '"')), "array<struct<band:int,most:double>>")
        told = asking.join(least, asking["id"] == least["query_id"], "left")
        # the same slack as in Best
        near = F.filter(ends, lambda x: F.col("least").isNull() | (F.col("least") <= F.col("length") * x["most"] * (1 + 1e-9)))
        further = told.select("id", "value", "block", F.explode(F.transform(near, lambda x: x["band"])).alias("band"))
        found = found.union(_search(rows, further, sizes, k, scale))
    return _ranked(found, k)


#: The rows of op1, over all pairs of a query and a row.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([q.e[i] * v.e[i] for i in range(1, len(v.e) + 1)])::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ship(__name__)
