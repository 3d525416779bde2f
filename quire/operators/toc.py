"""Table of contents and chunking on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.saving import saved

#: Rows that one window of a running total sums.
BLOCK = 4096


def parents(headings: DataFrame, by: str, no: str, level: str, levels: int = 3) -> DataFrame:
    """headings with parent: the nearest earlier row of a smaller level, null for none."""
    before = Window.partitionBy(by).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    nearest: Column = F.lit(None)
    for k in range(2, levels + 1):
        nearest = F.when(F.col(level) == k, F.max(F.when(F.col(level) < k, F.col(no))).over(before)).otherwise(nearest)
    return headings.withColumn("parent", nearest)


def play_order(points: DataFrame, by: str, position: str, href: str) -> DataFrame:
    """points with play_order: the rank of each href by where it first stands."""
    first = F.min(position).over(Window.partitionBy(by, href))
    return points.withColumn("_first", first).withColumn("play_order", F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))).drop("_first")


def running_total(rows: DataFrame, by: str, no: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over a group's rows up to each, by `no` (different whole numbers from 0): in blocks of numbers, and over the blocks' sums."""
    dealt = rows.withColumns({"_block": F.floor(F.col(no) / BLOCK), "_value": value})
    ahead = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(by, "_block").agg(F.sum("_value").alias("_value")).select(by, "_block", F.coalesce(F.sum("_value").over(ahead), F.lit(0)).alias("_before"))
    inner = F.sum("_value").over(Window.partitionBy(by, "_block").orderBy(no).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inner", inner).join(blocks, [by, "_block"]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_block", "_value", "_before", "_inner")


def _first_above(values: DataFrame, asked: DataFrame, cell: int) -> DataFrame:
    """doc_id, no, found: the first of values (doc_id, no, x; x doesn't fall as no rises) whose x is greater than that of each row asked (doc_id, no, x).

    Both are dealt over cells of x, so that no task holds a reading; where a row's own cell has none, the next cell that has any gives its first.
    """
    at = F.floor(F.col("x") / cell).alias("cell")
    given = values.select("doc_id", at, "x", F.lit(0).alias("asks"), F.col("no").alias("target"), F.lit(None).cast("long").alias("no"))
    asks = asked.select("doc_id", at, "x", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("target"), F.col("no").cast("long").alias("no"))
    both = given.withColumn("target", F.col("target").cast("long")).unionByName(asks)
    after = lambda *by: Window.partitionBy(*by).rowsBetween(1, Window.unboundedFollowing)
    here = both.withColumn("_here", F.min("target").over(after("doc_id", "cell").orderBy("x", "asks")))
    cells = both.groupBy("doc_id", "cell").agg(F.min("target").alias("_first")).select("doc_id", "cell", F.min("_first").over(after("doc_id").orderBy("cell")).alias("_later"))
    return here.where("asks = 1").join(cells, ["doc_id", "cell"]).select("doc_id", "no", F.coalesce("_here", "_later").alias("found"))


def chunks(pieces: DataFrame, soft: int, hard: int, key_type: str = "long") -> DataFrame:
    """doc_id, no, chunk: pieces (doc_id, no from 0, size, heading, start) dealt greedily: a chunk ends before a piece that would take it over
    hard, or before a heading once it is over soft. start is what the first chunk holds already.

    Each piece points to the piece that would open the next chunk if it opened one itself: the first one whose running total passes a bound. Which pieces are reached
    from the first one is found by doubling the pointers: in as many rounds as the number of chunks has binary digits.
    """
    rows = pieces.select(F.col("doc_id").cast(key_type).alias("doc_id"), F.col("no").cast("long").alias("no"), F.col("size").cast("long").alias("size"), "heading", "start")
    rows = saved(running_total(rows, "doc_id", "no", F.col("size"), "total"))
    held = F.col("total") - F.col("size") - F.when(F.col("no") == 0, F.col("start")).otherwise(0)
    over_hard = _first_above(rows.select("doc_id", "no", F.col("total").alias("x")), rows.select("doc_id", "no", (held + hard).alias("x")), hard)
    heads = rows.where("heading and no > 0").select("doc_id", "no", (F.col("total") - F.col("size")).alias("x"))
    over_soft = _first_above(heads, rows.select("doc_id", "no", (held + soft).alias("x")), hard)
    own = F.col("no")
    # a piece that alone passes the bound points to the next one, if there is one
    last = rows.groupBy("doc_id").agg(F.max("no").alias("_last"))
    ends = over_hard.where("found is not null").withColumn("found", F.greatest("found", own + 1)).unionByName(over_soft.where("found is not null"))
    jumps = ends.groupBy("doc_id", "no").agg(F.min("found").alias("next")).join(last, "doc_id").where("next <= _last").select("doc_id", "no", "next")
    jumps, opening = saved(jumps), rows.where("no = 0").select("doc_id", "no")
    while True:
        further = opening.join(jumps, ["doc_id", "no"]).select("doc_id", F.col("next").alias("no"))
        if further.isEmpty():
            break
        opening = saved(opening.unionByName(further))
        jumps = saved(jumps.join(jumps.select("doc_id", F.col("no").alias("next"), F.col("next").alias("beyond")), ["doc_id", "next"]).select("doc_id", "no", F.col("beyond").alias("next")))
    marked = rows.select("doc_id", "no").join(opening.withColumn("_opens", F.lit(1)), ["doc_id", "no"], "left")
    numbered = running_total(marked, "doc_id", "no", F.coalesce("_opens", F.lit(0)), "chunk")
    return numbered.select("doc_id", F.col("no").cast("int").alias("no"), (F.col("chunk") - 1).cast("int").alias("chunk"))


def first_markers(marks: DataFrame, by: str, page: str, *position: str) -> DataFrame:
    """The first place where each page's mark stands."""
    return marks.withColumn("_nth", F.row_number().over(Window.partitionBy(by, page).orderBy(*position))).where("_nth = 1").drop("_nth")
