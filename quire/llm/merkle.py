"""A Merkle manifest of a table of documents, with a proof for each row.

A row's leaf is the SHA-256 of its fields. Per source, leaves stand in the order of their ids; every FANOUT consecutive ones are hashed into a node, and
so on until one is left, the source's subroot; subroots in the order of their sources likewise give the root.

Places are found without a global sort, as in a radix trie over the ids: a histogram counts the rows of each cell (ids without their last CELL_BITS bits), coarser
histograms of DIGIT_BITS bits less each are summed from it, and offsets run down again, level by level, by sums within one parent: of 2**DIGIT_BITS
cells at most. A row's rank is its cell's offset and its place within the cell. Equal rows are counted, not listed, until then; a cell that
holds more than CELL_MOST different rows (many texts under one id, or none) is cut by the leading digits of its leaves. No window or
group holds more than 2**DIGIT_BITS rows of a histogram, or a cell's rows, however many rows a source has.
The digits of the rank to the base FANOUT are the row's key in the tree: the nodes of a level are the groups of the longest prefix shared by FANOUT rows. On the way down each node gives its
children its own path, so that a row meets only its own run of FANOUT rows, and texts are read once and never shuffled.

Null fields are hashed as "-"; rows without an id come first in their source, rows without a source are a source that comes before all others. Equal ids stand in the
order of their leaves; repeated rows are leaves of their own with the same id, and each gives a row. Empty texts are "0:". A long text is hashed whole. An empty table gives an empty one. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved

FANOUT = 16
CELL_BITS, DIGIT_BITS = 12, 16
CELL_MOST = 1 << 16
#: Copies of one row that a task lists at a time.
COPIES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """Hash of a row's fields."""
    return F.sha2(F.concat(*(field(x) for x in fields)).cast("binary"), 256)


def _hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ranked(rows: DataFrame, group: list[str], number: str, tie: str, count: str = "n") -> DataFrame:
    """rows (no two of one group equal in `number` and `tie`, a string of hexadecimal digits) with `rank`: how many copies (`count`) come before a row in its group, by number (nulls first), then tie."""
    cell = F.when(F.col(number).isNotNull(), F.shiftright(number, CELL_BITS))
    own = [*group, "_cell"]
    rows = saved(rows.withColumn("_cell", cell))
    counts = saved(rows.groupBy(*own).agg(F.sum(count).alias("copies"), F.count("*").alias("different")))
    # overfull cells are cut by the tie's leading digits
    over = counts.where(F.col("different") > CELL_MOST).select(*own, F.lit(True).alias("_over"))
    cut = _joined(rows, over, own, "left").withColumns({"_number": F.when(F.col("_over"), F.col(number)), "_part": F.when(F.col("_over"), F.substring(tie, 1, DIGIT_BITS // 4))}).drop("_over")
    parts = cut.where("_part is not null").groupBy(*own, "_number", "_part").agg(F.sum(count).alias("copies"))
    before = lambda by, order: F.sum("copies").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*own, "_number", "_part", before(own, [F.asc_nulls_first("_number"), "_part"]).alias("_before_part"))

    # levels of coarser and coarser cells
    levels = [counts.select(*group, F.col("_cell").alias("at"), "copies")]
    for _ in range(-(-(64 - CELL_BITS) // DIGIT_BITS) - 1):
        up = levels[-1].groupBy(*group, F.shiftright("at", DIGIT_BITS).alias("at")).agg(F.sum("copies").alias("copies"))
        levels.append(up)
    # offsets, from the coarsest level down
    top = levels.pop()
    offsets = top.select(*group, "at", F.coalesce(before(group, [F.asc_nulls_first("at")]), F.lit(0)).alias("offset"))
    while levels:
        down = levels.pop().withColumn("_parent", F.shiftright("at", DIGIT_BITS))
        within = down.withColumn("_within", F.coalesce(before([*group, "_parent"], [F.asc_nulls_first("at")]), F.lit(0)))
        offsets = _joined(within, offsets.withColumnRenamed("at", "_parent"), [*group, "_parent"], "inner").select(*group, "at", (F.col("offset") + F.col("_within")).alias("offset"))
    placed = _joined(cut, offsets.withColumnRenamed("at", "_cell"), own, "inner")
    placed = _joined(placed, parts, [*own, "_number", "_part"], "left")
    copies = F.sum(count).over(Window.partitionBy(*own, "_number", "_part").orderBy(F.asc_nulls_first(number), tie).rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("offset") + F.coalesce("_before_part", F.lit(0)) + F.coalesce(copies, F.lit(0))
    return placed.withColumn("rank", rank.cast("long")).drop("_cell", "_number", "_part", "_before_part", "offset")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which nulls equal nulls; keys of the left."""
    right = right.withColumnsRenamed({k: f"{k}__" for k in keys})
    on = [left[k].eqNullSafe(right[f"{k}__"]) for k in keys]
    return left.join(right, on, how).drop(*(f"{k}__" for k in keys))


def listed(rows: DataFrame, count: str = "n") -> DataFrame:
    """Each row as many times as it counts, `rank` rising by one; a task lists COPIES of one row at most."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES)))
    blocks = rows.withColumn("_block", block)
    blocks = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block") * COPIES, F.least(F.col(count), (F.col("_block") + 1) * COPIES) - 1)))
    return blocks.withColumn("rank", F.col("rank") + F.col("_copy")).drop("_block", "_copy", count)


def node_of(run: Column, children: Column) -> Column:
    """What a run comes to: the hash of its nodes; a group's only node stays as it is."""
    return F.when(_lone(run, children), children[0]["hash"]).otherwise(_hashed(F.array_join(F.transform(children, lambda c: c["hash"]), "")))


def _lone(run: Column, children: Column) -> Column:
    """Runs fill up in order: one node in the first run is all that the group has."""
    return (run == 0) & (F.size(children) == 1)


def levels_of(nodes: DataFrame, group: list[str], carry: list[str]) -> list[DataFrame]:
    """group, run, children (rank, hash; on the lowest level also `carry`) for each level, from nodes (group, rank, hash, carry) up to one run a group."""
    levels: list[DataFrame] = []
    while True:
        runs = nodes.groupBy(*group, F.shiftright("rank", FANOUT.bit_length() - 1).alias("run"))
        levels.append(saved(runs.agg(F.sort_array(F.collect_list(F.struct("rank", "hash", *carry))).alias("children"))))
        if levels[-1].where("run > 0").isEmpty():
            return levels
        nodes, carry = levels[-1].select(*group, F.col("run").alias("rank"), node_of(F.col("run"), F.col("children")).alias("hash")), []


def top_of(levels: list[DataFrame], group: list[str]) -> DataFrame:
    """group, hash: what is left of each group."""
    return levels[-1].select(*group, node_of(F.col("run"), F.col("children")).alias("hash"))


def down(levels: list[DataFrame], group: list[str], paths: DataFrame) -> DataFrame:
    """The nodes of the lowest level: the columns of paths and of the nodes, `path` the siblings left and right of each step from a node to the root.

    paths: group, path (of what is left of the group) and further columns.
    """
    paths = paths.withColumn("run", F.lit(0).cast("long"))
    for runs in reversed(levels):
        met = runs.join(paths, [*group, "run"])
        met = met.withColumn("_hashes", F.transform("children", lambda c: c["hash"])).withColumn("_lone", _lone(F.col("run"), F.col("children")))
        each = met.select("*", F.posexplode("children").alias("_at", "_node")).drop("children", "run")
        left = F.array_join(F.slice("_hashes", 1, F.col("_at")), "")
        right = F.array_join(F.slice("_hashes", F.col("_at") + 2, FANOUT), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        each = each.withColumn("path", F.when(F.col("_lone"), F.col("path")).otherwise(F.concat(step, "path")))
        paths = each.withColumn("run", F.col("_node.rank")).drop("_hashes", "_lone", "_at")
        if runs is not levels[0]:
            paths = paths.drop("_node")
    return paths.select(*(c for c in paths.columns if c not in ("_node", "run")), "_node.*")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda hash, step: _hashed(F.concat(step["left"], hash, step["right"])))


def proof_of(path: Column) -> Column:
    """Hash of all siblings, from the leaf's run up."""
    return _hashed(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs (FIELDS).

    folded_root is computed from the row as it is now: where `tampered` holds its text is `changed`, and the siblings are as they were.
    """
    fields = [F.col(c) for c in FIELDS]
    now = F.when(F.coalesce(tampered, F.lit(False)), leaf_of([*fields[:-1], changed]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", field(F.col("source")).alias("own"), leaf_of(fields).alias("hash"), now.alias("now"))
    equal = rows.groupBy("own", "source", "doc_id", "hash", "now").agg(F.count("*").alias("n"))
    places = saved(listed(ranked(equal, ["own"], "doc_id", "hash")))
    levels = levels_of(places.select("own", "rank", "hash", "doc_id", "now"), ["own"], ["doc_id", "now"])

    # the first seven bytes as a number, then all of them
    start = F.conv(F.substring(F.rpad(F.hex(F.encode("source", "UTF-8")), 14, "0"), 1, 14), 16, 10).cast("long")
    sources = places.select("own", "source").distinct().join(top_of(levels, ["own"]), "own")
    sources = sources.select("own", "hash", start.alias("first"), F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("")).alias("bytes"), F.lit(1).cast("long").alias("n"))
    upper = levels_of(ranked(sources, [], "first", "bytes").select("rank", "hash", "own"), [], ["own"])
    root = top_of(upper, []).first()  # one row
    none = F.from_json(F.lit("[]"), "array<struct<left:string,right:string>>")
    top = docs.sparkSession.range(1).select(none.alias("path"))
    paths = down(upper, [], top).select("own", F.col("hash").alias("subroot"), "path")

    found = down(levels, ["own"], paths).withColumn("root", F.lit(root["hash"] if root else None))
    found = found.withColumn("folded_root", folded(F.coalesce("now", "hash"), F.col("path")))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels_sql(name: str, nodes: str, group: str, levels: int) -> str:
    """CTEs name_0 (runs of nodes: group, rank, hash) up to name_{levels}."""
    parts = []
    for k in range(levels):
        source = nodes if k == 0 else f"(SELECT {group}, run AS rank, CASE WHEN run = 0 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS hash FROM {name}_{k - 1})"
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT {group}, rank // {FANOUT} AS run, list(hash ORDER BY rank) AS hs FROM {source} GROUP BY {group}, rank // {FANOUT})")
    return ",\n".join(parts)


def _steps_sql(name: str, start: str, out: str, group: str, rank: str, levels: int) -> str:
    """CTEs out_1 up to out_{levels}: start with the proof longer and the fold higher by a level each."""
    parts = []
    for k in range(levels):
        at = f"({rank} // {FANOUT**k} % {FANOUT})"
        lone = "(r.run = 0 AND len(r.hs) = 1)"
        rest = f"array_to_string(r.hs[:{at}], ''), array_to_string(r.hs[{at} + 2:], '')"
        parts.append(
            f"{out}_{k + 1} AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN {lone} THEN d.proof ELSE concat(d.proof, {rest}) END AS proof, CASE WHEN {lone} THEN d.fold ELSE sha256(concat(array_to_string(r.hs[:{at}], ''), d.fold, array_to_string(r.hs[{at} + 2:], ''))) END AS fold)\n"
            f"  FROM {start if k == 0 else f'{out}_{k}'} d JOIN {name}_{k} r ON r.{group} = d.{group} AND r.run = d.{rank} // {FANOUT ** (k + 1)})"
        )
    return ",\n".join(parts)


def oracle_sql(divisor: int = 5, levels: int = 5, upper: int = 3) -> str:
    """The rows of op12, for sources of FANOUT**levels rows and FANOUT**upper sources at most."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    crc = "xor(list_reduce([4294967295] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    top = f"(SELECT own, CASE WHEN run = 0 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS hash FROM t_{levels - 1})"
    return f"""
WITH d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % {divisor} = 0 THEN {leaf(lowered)} END AS now, CASE WHEN source IS NULL THEN '-' ELSE concat('+', source) END AS own FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY own ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
{_levels_sql("t", "(SELECT own, rank, leaf AS hash FROM l)", "own", levels)},
s AS MATERIALIZED (SELECT own, hash, 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM {top} JOIN (SELECT DISTINCT own, source FROM l) USING (own)),
{_levels_sql("u", "(SELECT one, place AS rank, hash FROM s)", "one", upper)},
w_0 AS (SELECT l.doc_id, l.leaf, l.own, l.rank, s.place, s.one, s.hash AS subroot, '' AS proof, coalesce(l.now, l.leaf) AS fold FROM l JOIN s USING (own)),
{_steps_sql("t", "w_0", "w", "own", "rank", levels)},
{_steps_sql("u", f"w_{levels}", "x", "one", "place", upper)},
r AS (SELECT CASE WHEN len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS root FROM u_{upper - 1})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM x_{upper} CROSS JOIN r
"""
