"""Hard negatives by k-means inverted lists with stored radii.

A vector's components x become floor(scale * x). Centroids are fitted on a sample of SAMPLE_ROWS rows or so (fewer if vectors are wide: SAMPLE_VALUES
numbers at most); every row is put into the list of its nearest centroid, and each list's radius, the largest distance of a row to the centroid, is
taken over all rows. By Cauchy-Schwarz no row of a list with centroid c and radius r has a product with a above a·c + |a|r, or below a·c - |a|r.

Each anchor visits lists by falling upper bound, in rounds of growing numbers of lists (ROUNDS). A list is skipped where it lies outside all of the anchor's
windows of scores, and an anchor stops where the bound falls strictly below its k-th score so far, which every round sends along; so the result is exact, ties
included. First each anchor's positives are found, the best rows of its label; their scores set the windows in which negatives, the best rows of other
labels, are searched. A long list is cut into chunks, each a row of its own, and anchors that visit a list go to its chunks in packs: a list of a third
of all rows is as many tasks. Nothing but centroids, radii and sizes reaches the driver: CENTROIDS rows at most.

Rows without an id, with a null label or a null vector, or with null or non-finite components take no part. Shorter vectors count as filled up with zeros.
A row is known by its id: rows with the anchor's id are neither its positives nor its negatives. Rows that are equal in id, label and vector count once;
an id with several labels or vectors is several candidates, and several anchors, whose results stand together. Ties go to the smaller id. Scores beyond a long are set to its ends. An anchor without
positives, and a positive without negatives in its window (always so if its score is negative), has no row. An empty table gives an empty one.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, saved
from quire.llm.vectors import LIST_ROWS, QUERY_ROWS, chunked, component_type, matrix, members, met, products, sampled, sound, whole
from quire.shipping import ship

CENTROIDS = 128
#: The sample on which centroids are fitted.
SAMPLE_ROWS, SAMPLE_VALUES = 16384, 1 << 21
STEPS = 8
#: How many lists an anchor has visited after each round, by falling bound; all after the last.
ROUNDS = (2, 12, 1 << 30)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Bounds are computed in doubles; products are whole.
_SLACK = 1e-9


def centroids_of(sample: np.ndarray, most: int) -> np.ndarray:
    """k-means on a sample, by Lloyd's steps from evenly spaced rows."""
    most = min(most, len(sample))
    if not most:
        return np.zeros((0, sample.shape[1]))
    found = sample[np.linspace(0, len(sample) - 1, most).astype(int)].copy()
    for _ in range(STEPS):
        near = nearest(sample, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=most)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and the distance."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (centroids**2).sum(axis=1) - 2 * rows @ centroids.T
        near = np.nan_to_num(apart, nan=np.inf).argmin(axis=1)
        return near, np.nan_to_num(np.sqrt(((rows - centroids[near]) ** 2).sum(axis=1)), nan=np.inf)


def _assigns(centroids: np.ndarray, scale: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.floor(matrix(batch.column("value"), centroids.shape[1]) * scale)
            near, far = nearest(rows, centroids) if len(rows) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "cluster", "far"])

    return work


def _visits(centroids: np.ndarray, radii: np.ndarray, scale: float, done: int, upto: int):
    """Adds `clusters`: the lists that an anchor visits in a round, after `done` lists and before `upto`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.floor(matrix(batch.column("value"), centroids.shape[1]) * scale)
            with np.errstate(over="ignore", invalid="ignore"):
                middle = rows @ centroids.T
                reach = np.sqrt((rows**2).sum(axis=1))[:, None] * radii
                slack = _SLACK * (np.abs(middle) + reach) + _SLACK
                above = np.nan_to_num(middle + reach + slack, nan=np.inf)
                below = np.nan_to_num(middle - reach - slack, nan=-np.inf)
            wins, out = batch.column("wins"), []
            for k in range(len(rows)):
                own = wins[k].values
                low, high, least = (own.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("low", "high", "least"))
                order = np.argsort(-above[k], kind="stable")[done:upto]
                # strictly below the k-th score ends the search; outside the window skips the list
                alive = (above[k, order][:, None] >= np.maximum(low, least)) & (below[k, order][:, None] <= high)
                out.append(order[alive.any(axis=1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "clusters"])

    return work


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(at) > 4 * k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return np.array(sorted(at, key=lambda i: (-scores[i], ids[i]))[:k], int)


def _searches(k: int, scale: float, same_label: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row in range(batch.num_rows):
                listed, asking = members(batch, "list", row), members(batch, "queries", row)
                ids, labels = (listed.field(f).to_numpy(zero_copy_only=False) for f in ("id", "label"))
                keys, own_ids, own_labels = (asking.field(f).to_numpy(zero_copy_only=False) for f in ("key", "id", "label"))
                scores = products(whole(matrix(asking.field("value")), scale), whole(matrix(listed.field("value")), scale))
                wins = asking.field("wins")
                for i in range(len(keys)):
                    fits = np.flatnonzero(((labels == own_labels[i]) == same_label) & (ids != own_ids[i]))
                    own = scores[i, fits]
                    for w in wins[i].as_py():
                        at = np.flatnonzero((own >= max(w["low"], w["least"])) & (own <= w["high"]))
                        for j in at[best(own[at], ids[fits[at]], k)]:
                            out.append((int(keys[i]), w["slot"], int(ids[fits[j]]), min(max(int(own[j]), _LEAST), _MOST)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "slot", "id", "score"])

    return work


class Lists:
    """The inverted lists of a table of vectors (id, label, value)."""

    def __init__(self, rows: DataFrame, scale: float):
        spark = rows.sparkSession
        self.scale = scale
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("value")), F.lit(0))).first()
        about = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // max(1, width)))
        sample = sampled(rows, ["id", "label"], about, n).select("id", "value").dropDuplicates().limit(2 * about).orderBy("id").toArrow()
        if n and not sample.num_rows:  # few different rows, repeated often
            sample = rows.select("id", "value").limit(1).toArrow()
        self.centroids = centroids_of(np.floor(matrix(sample["value"].combine_chunks(), width) * scale), min(CENTROIDS, max(1, SAMPLE_VALUES // 4 // max(1, width))))
        kind = rows.schema["value"].dataType.simpleString()
        schema = f"id long, label long, value {kind}, cluster int, far double"
        self.rows = saved(map_arrow(rows.dropDuplicates(["id", "label", "value"]), _assigns(self.centroids, scale), schema))
        # as many rows as there are centroids, at most
        found = self.rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        self.radii = np.zeros(len(self.centroids))
        for r in found:
            self.radii[r["cluster"]] = r["far"]
        self.sizes = spark.createDataFrame([(r["cluster"], -(-r["n"] // LIST_ROWS)) for r in found], "cluster int, chunks int")
        self.lists = saved(chunked(self.rows.drop("far"), self.sizes, ["cluster"], ["id", "label", "value"]))

    def search(self, asking: DataFrame, k: int, same_label: bool) -> DataFrame:
        """key, slot, id, score, rank: the k best of each window (slot, low, high, least) of each query (key, id, label, value, wins)."""
        asking = saved(asking)
        blocks = max(1, -(-asking.count() // QUERY_ROWS))
        kind = asking.schema["value"].dataType.simpleString()
        wins = "array<struct<slot:int,low:bigint,high:bigint,least:bigint>>"
        found, done = None, 0
        for upto in ROUNDS:
            if done >= len(self.centroids):
                break
            now = asking if found is None else self._told(asking, found, k)
            visits = map_arrow(now.select("key", "id", "label", "value", "wins"), _visits(self.centroids, self.radii, self.scale, done, upto), f"key long, id long, label long, value {kind}, wins {wins}, clusters array<int>")
            sent = visits.withColumn("cluster", F.explode("clusters")).drop("clusters")
            pairs = met(sent, self.lists, self.sizes, ["cluster"], ["key", "id", "label", "value", "wins"], blocks)
            more = map_arrow(pairs, _searches(k, self.scale, same_label), "key long, slot int, id long, score long")
            found = saved(_ranked(more if found is None else found.drop("rank").unionByName(more), k))
            done = upto
        return found if found is not None else _ranked(asking.selectExpr("key", "0 AS slot", "id", "0L AS score").limit(0), k)

    @staticmethod
    def _told(asking: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """asking, with the k-th score so far of each window that has k rows."""
        least = found.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        told = F.transform("wins", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("kth", w["slot"]), w["least"]).alias("least")))
        return asking.join(least, "key", "left").withColumn("wins", told).drop("kth")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for the rows for which `anchors` holds.

    A negative's score lies between window[0] and window[1] hundredths of the positive's, both included.
    """
    kind = component_type(vectors, vector_col)
    value = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & sound(value)).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), value.alias("value"), anchors.alias("asks"))
    lists = Lists(rows.drop("asks"), scale)
    window_of = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(_LEAST).alias("least"))
    asking = rows.where("asks").select("id", "label", "value").dropDuplicates().withColumn("key", F.xxhash64("id", "label", "value"))
    asking = saved(asking.withColumn("wins", F.array(window_of(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))))
    near = lists.search(asking, positives, same_label=True)
    near = near.select("key", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers between the window's ends; longer than a long while they are multiplied
    exact = F.col("positive_score").cast("decimal(38,0)")
    low = F.floor((exact * window[0] + 99) / 100).cast("long")
    high = F.floor(exact * window[1] / 100).cast("long")
    wins = near.where("positive_score >= 0").groupBy("key").agg(F.sort_array(F.collect_list(window_of(F.col("slot"), low, high))).alias("wins"))
    far = lists.search(asking.drop("wins").join(wins, "key"), negatives, same_label=False)
    named = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near, ["key", "slot"]).join(asking.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The rows of op11, over all pairs of an anchor and a row.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_sum([a.e[i] * v.e[i] for i in range(1, len(v.e) + 1)])::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM g JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""

ship(__name__)
