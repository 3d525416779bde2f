"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in order of their id's md5, are dealt into blocks of `block` documents. Weights are whole numbers: the blocks a
source gives to each round. In a round of n blocks, block j (from 0) of a source that gives c is released at slot floor(j n / c) and due
at ceil((j + 1) n / c); each slot goes to the released block that is due first (ties: the source listed first). So every source
is less than one block from its weight's share at any slot. When a source runs out, the others go on in their own
proportions: rounds are alike but for the sources that still have blocks, so there are at most two kinds of rounds for each source, and
only one round of each kind is scheduled. No document is dropped or repeated.

Sources not in the weights, null included, are pooled as one source with the weight `other`, so the schedule's size depends on the weights
alone. Documents are ranked in bins of a source, by their md5's first digits, never a whole source in one task. Rows without an id come last
in their bin; rows of one id stand side by side in the order of a hash of the whole row, so that a task that is run again deals the same places. Weights below 1 are
refused: a source without a weight would have no place. A very long text is carried along as it is. Other columns, whatever their names, pass through unchanged, but for those of the result's names, which are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 16
OTHER = "(other)"
#: Rows of a source that are ranked together, about.
BIN_ROWS = 1024
_DIGITS = 7
#: Bins of a source whose sizes are added up in one task.
BIN_GROUP = 1024


def round_kinds(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """blocks: what each source has. (first round, first slot, blocks of each source in such a round), in order of rounds."""
    marks = sorted({0} | {b for s, w in weights.items() for b in (blocks[s] // w, blocks[s] // w + 1)})
    out, slot = [], 0
    for mark, until in zip(marks, [*marks[1:], None], strict=True):
        gives = [w if mark < blocks[s] // w else blocks[s] % w if mark == blocks[s] // w else 0 for s, w in weights.items()]
        if not sum(gives):
            break
        out.append((mark, slot, gives))
        slot += sum(gives) * ((until or mark) - mark)
    return out


def _scheduled(gives: Column) -> Column:
    """For each slot of a round, the place (from 0) of the source that gets it: earliest deadline first among what is released."""
    total = F.aggregate(gives, F.lit(0).cast("long"), lambda a, x: a + x)

    def slot(done: Column, t: Column) -> Column:
        def window(c: Column, i: Column) -> Column:
            j = F.get(done, i)
            ready = (j < c) & (F.floor(j * total / F.greatest(c, F.lit(1))) <= t)
            return F.when(ready, F.struct(F.ceil((j + 1) * total / F.greatest(c, F.lit(1))).alias("due"), i.alias("source")))

        return F.array_min(F.transform(gives, window))["source"]

    def step(state: Column, t: Column) -> Column:
        return F.struct(
            F.transform(state["done"], lambda x, i: x + F.when(i == slot(state["done"], t), 1).otherwise(0)).alias("done"), F.concat(state["slots"], F.array(slot(state["done"], t))).alias("slots")
        )

    zero = F.struct(F.transform(gives, lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("slots"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), zero, step, lambda state: state["slots"])


def schedule(spark: SparkSession, kinds: list[tuple[int, int, list[int]]]) -> DataFrame:
    """kind, source (place from 0), nth (block of the source in the round, from 0), at (slot in the round)."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.array(*(F.lit(x).cast("long") for x in gives)).alias("gives")) for k, (_, _, gives) in enumerate(kinds)))
    slots = spark.range(1).select(F.inline(rows)).select("kind", F.posexplode(_scheduled(F.col("gives"))).alias("at", "source"))
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "source").orderBy("at")) - 1)


def _tie(docs: DataFrame) -> Column:
    """A hash of the row, of all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with mix_source, mix_block (from 0, in its source), mix_slot (the block's place in the mix, from 0) and mix_place (in its block)."""
    spark = docs.sparkSession
    weights = weights | {OTHER: other}
    if bad := {s: w for s, w in weights.items() if w < 1}:
        raise ValueError(f"weights must be whole numbers from 1 on: {bad}")
    names = list(weights)
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_place")
    source = F.when(F.col(source_col).isin(*(x for x in names if x != OTHER)), F.col(source_col)).otherwise(F.lit(OTHER))
    digest = F.md5(F.col(id_col).cast("string").cast("binary"))
    counts = {r["mix_source"]: r["n"] for r in docs.groupBy(source.alias("mix_source")).agg(F.count("*").alias("n")).collect()}
    blocks = {s: -(-counts.get(s, 0) // block) for s in names}
    if not sum(blocks.values()):
        empty = {"mix_source": "string", "mix_block": "long", "mix_slot": "long", "mix_place": "long"}
        return docs.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()}).where("false")
    kinds = round_kinds(blocks, weights)
    bins = max(1, -(-sum(counts.values()) // BIN_ROWS))
    # ascending with the digest, so that bins follow one another in its order
    in_bin = F.coalesce(F.floor(F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") * bins / 16**_DIGITS), F.lit(bins - 1).cast("long"))
    rows = docs.select(source.alias("mix_source"), digest.alias("_digest"), in_bin.alias("_bin"), _tie(docs).alias("_tie"), F.struct("*").alias("_doc"))
    sizes = docs.select(source.alias("mix_source"), in_bin.alias("_bin")).groupBy("mix_source", "_bin").agg(F.count("*").alias("n"))
    # running sums over groups of bins, then within each: no task has all bins of a source
    sizes = sizes.withColumn("_group", F.floor(F.col("_bin") / BIN_GROUP))
    sums = sizes.groupBy("mix_source", "_group").agg(F.sum("n").alias("n"))
    starts = sums.select("mix_source", "_group", (F.sum("n").over(Window.partitionBy("mix_source").orderBy("_group")) - F.col("n")).alias("_start"))
    within = sizes.withColumn("_within", F.sum("n").over(Window.partitionBy("mix_source", "_group").orderBy("_bin")) - F.col("n"))
    before = within.join(starts, ["mix_source", "_group"]).select("mix_source", "_bin", (F.col("_start") + F.col("_within")).alias("_before"))
    in_order = Window.partitionBy("mix_source", "_bin").orderBy(F.col("_digest").asc_nulls_last(), "_tie")
    ranked = rows.join(before, ["mix_source", "_bin"]).withColumn("_rank", F.col("_before") + F.row_number().over(in_order) - 1)
    weight = F.coalesce(*(F.when(F.col("mix_source") == s, F.lit(w)) for s, w in weights.items()))
    firsts, slots, lengths = (F.array(*(F.lit(x).cast("long") for x in column)) for column in ([x[0] for x in kinds], [x[1] for x in kinds], [sum(x[2]) for x in kinds]))
    number = F.floor(F.col("_rank") / block)
    turn = F.floor(F.col("mix_block") / weight)
    placed = ranked.withColumns({"mix_block": number, "mix_place": F.col("_rank") - number * block}).withColumn("_round", turn)
    placed = placed.withColumns({"_kind": F.size(F.filter(firsts, lambda x: x <= F.col("_round"))) - 1, "_nth": (F.col("mix_block") - F.col("_round") * weight).cast("int")})
    # as many rows as all kinds of rounds have slots: bounded by the weights, whatever the documents
    table = schedule(spark, kinds).select(F.col("kind").alias("_kind"), F.get(F.array(*(F.lit(x) for x in names)), F.col("source")).alias("mix_source"), F.col("nth").alias("_nth"), "at")
    joined = placed.join(F.broadcast(table), ["_kind", "mix_source", "_nth"])
    slot = F.get(slots, F.col("_kind")) + (F.col("_round") - F.get(firsts, F.col("_kind"))) * F.get(lengths, F.col("_kind")) + F.col("at")
    return joined.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns), "mix_source", "mix_block", slot.cast("long").alias("mix_slot"), "mix_place")


def oracle_sql(weights: dict[str, int], other: int = 1, block: int = BLOCK) -> str:
    """The rows of op4: the same schedule, slot by slot."""
    weights = weights | {OTHER: other}
    listed = ", ".join(f"('{s}', {w}, {k})" for k, (s, w) in enumerate(weights.items()))
    return f"""
WITH RECURSIVE weights(s, w, k) AS (VALUES {listed}),
d AS (SELECT doc_id, CASE WHEN source IN (SELECT s FROM weights) THEN source ELSE '{OTHER}' END AS s, md5(doc_id::VARCHAR) AS digest FROM documents),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY digest) - 1 AS rank FROM d),
had AS (SELECT weights.*, (SELECT (count(*) + {block - 1}) // {block} FROM d WHERE d.s = weights.s) AS m FROM weights),
marks AS (SELECT DISTINCT mark FROM (SELECT 0 AS mark UNION ALL SELECT m // w FROM had UNION ALL SELECT m // w + 1 FROM had)),
gives AS (SELECT mark, k, s, w, CASE WHEN mark < m // w THEN w WHEN mark = m // w THEN m % w ELSE 0 END AS c FROM marks, had),
kinds AS (SELECT mark, list(c ORDER BY k) AS c, sum(c) AS n, lead(mark) OVER (ORDER BY mark) AS until FROM gives GROUP BY mark),
live AS (SELECT mark, c, n, until, coalesce(sum(n * (coalesce(until, mark) - mark)) OVER (ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot FROM kinds WHERE n > 0),
run AS (
  SELECT mark, c, n, 0::BIGINT AS t, [0::BIGINT for x in c] AS done, NULL::BIGINT AS pick FROM live
  UNION ALL
  SELECT mark, c, n, t + 1, [done[i] + CASE WHEN i = p THEN 1 ELSE 0 END for i in range(1, len(c) + 1)], p FROM (
    SELECT *, list_sort([[ceil((done[i] + 1) * n / c[i]), i] for i in range(1, len(c) + 1) if done[i] < c[i] and floor(done[i] * n / greatest(c[i], 1)) <= t])[1][2]::BIGINT AS p FROM run WHERE t < n)
),
slots AS (SELECT mark, t - 1 AS at, pick - 1 AS k, row_number() OVER (PARTITION BY mark, pick ORDER BY t) - 1 AS nth FROM run WHERE pick IS NOT NULL),
placed AS (SELECT r.*, k, rank // {block} AS b, (rank // {block}) // w AS turn, (rank // {block}) % w AS nth FROM r JOIN weights USING (s))
SELECT p.doc_id, p.s AS mix_source, p.b::BIGINT AS mix_block, (l.first_slot + (p.turn - l.mark) * l.n + q.at)::BIGINT AS mix_slot, (p.rank % {block})::BIGINT AS mix_place
FROM placed p JOIN live l ON p.turn >= l.mark AND (l.until IS NULL OR p.turn < l.until) JOIN slots q ON q.mark = l.mark AND q.k = p.k AND q.nth = p.nth
"""
