"""N-gram Jaccard join: links between documents whose shingle sets overlap enough, found with prefix trees.

1. One pass makes each document's set of word shingles (64-bit hashes), its size and set id, and notes shingles that are common already
   within a batch. Documents with equal sets are one node from here on.
2. All shingles have one global order: those of a fixed part of the hash space (`sampled`) by their exact number of rows in the corpus, then the
   others by hash, then the common ones by their counts, the most common last. Two sets of similarity t share one of the first n - ceil(t n) + 1
   shingles of each (prefix filter). The part is as large as a prefix and a quarter more, so that a second pass ships and counts that part of each set only, and
   most prefixes consist of shingles that no other set has: these lead nowhere and are dropped where they are counted. Sets below SMALL shingles, and those
   above that may link with them, also meet in an order of their own, with all their shingles counted, as a small set's share of a part varies much.
3. The nodes that meet at a shared prefix shingle, sorted by size, are chained while sizes allow a link; at a common shingle, whose rows are
   dealt by node and never gathered, each hangs on the least node of its size class. That is a row or two per node, whatever the group's size.
   Connected nodes make blocks, and any link lies in one block.
4. Each block's whole sets, ordered by falling global count and hash, go to a prefix tree, which is searched with every set of the block until all are
   reached; subtrees are left by remaining-length bounds. A block over BLOCK_SHINGLES or BLOCK_SETS is cut into chunks, each of which meets a few
   sets of the block as pivots. What then hangs together need not meet again: only the sets outside the block's largest group meet one another and that
   group's chunks. So a group of near copies, of any size, takes one task a chunk.
5. The links found (a spanning forest) give the components.

Hashes of sets and shingles have 64 bits: with n different sets, any two of them collide with a chance of about n**2 / 2**65.

Null and empty texts and texts without words have empty sets and link with nothing. Texts of fewer words than a shingle
have their whole sequence as the only shingle. Repeated rows and equal texts share a component. A row without id shares the component
of equal sets and links with no other. Different texts may bear one id. Of equal ranks the smaller hash comes first. Long texts are hashed whole, one at a time. An
empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, saved
from quire.llm.components import components
from quire.llm.prefix_trie import linked
from quire.llm.wordhash import WordHasher, grams, mixed
from quire.shipping import ship

#: Shingles of a set below which all of them are counted.
SMALL = 128
#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: A shingle is noted as common if this part of a batch's sets, and so many, have it.
COMMON_PART, COMMON_LEAST = 64, 8
#: Entries of the table of common shingles that goes to every worker: 16 bytes each. Others are counted like any shingle.
COMMON_MOST = 1 << 18
#: Tasks that a common shingle's rows are dealt to.
SALTS = 63
#: A block's chunk: shingles and sets; pivots of a block.
BLOCK_SHINGLES, BLOCK_SETS, PIVOTS = 1 << 20, 2048, 4


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The column in runs of rows of at most so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield column.slice(start, end - start)
        start = end


def shingle_sets(column: pa.Array, hasher: WordHasher, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    for part in slices(column):
        words, at = hasher.words(part)
        runs = grams(words, n)
        for i in range(len(part)):
            count = at[i + 1] - at[i]
            if count >= n:
                yield np.unique(runs[at[i] : at[i + 1] - n + 1])
            else:
                yield grams(words[at[i] : at[i + 1]], int(count)) if count else np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    return int(mixed(np.array([mixed(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0].astype(np.int64))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sampled_by(num: int, den: int) -> int:
    """Shingles whose hash this divides are counted."""
    return max(1, 4 * den // (5 * max(den - num, 1)))


class Common:
    """The common shingles' global order: rank 0 for the most common one, len(table) for all that aren't in the table."""

    def __init__(self, raw: bytes):
        falling = np.frombuffer(raw, np.uint64)
        self.order = np.argsort(falling)
        self.known = falling[self.order]

    def ranks(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.order[at], len(self.known))

    def __len__(self) -> int:
        return len(self.known)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, text_hash, size, node) of documents, and rows (token, times) of shingles that are common within a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def row(n: int, **known: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([known.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))

        for batch in batches:
            kinds = {"id": batch.schema.field(0).type, "text_hash": pa.int64(), "size": pa.int32(), "node": pa.int64(), "token": pa.int64(), "times": pa.int64()}
            sizes, nodes, distinct = [], [], {}
            for shingles in shingle_sets(batch.column(1), hasher, n):
                sizes.append(len(shingles))
                nodes.append(set_id(shingles) if len(shingles) else None)
                if len(shingles):
                    distinct[nodes[-1]] = shingles
            yield row(len(sizes), id=batch.column(0), text_hash=batch.column(2), size=pa.array(sizes, pa.int32()), node=pa.array(nodes, pa.int64()))
            least = max(COMMON_LEAST, len(distinct) // COMMON_PART)
            if len(distinct) >= least:
                tokens, times = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                tokens, times = tokens[times >= least], times[times >= least]
                yield row(len(tokens), token=pa.array(tokens.view(np.int64)), times=pa.array(times.astype(np.int64)))

    rows = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, work, f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, size int, node long, token long, times long")


def _common(scanned: DataFrame) -> bytes:
    """The most common shingles, most common first: at most COMMON_MOST of them, whatever the corpus."""
    rows = scanned.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(COMMON_MOST)
    return rows.select("token").toArrow().column("token").to_numpy().astype(np.int64).tobytes()


def _prefix_tokens(docs: DataFrame, n: int, table, num: int, den: int) -> DataFrame:
    """Of each distinct set of a task (node), for each order it takes part in (role 0: small sets, 1: others): its counted shingles (salt 0), and what its
    prefix has beyond them: others (-1) and common ones (from 1 on). size and counted tell how many shingles and counted ones the set has."""
    part = np.uint64(sampled_by(num, den))

    def roles(size: int) -> list[int]:
        return [0] if size < SMALL else [0, 1] if num * size <= den * SMALL else [1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, common, seen = WordHasher(), Common(table.value), set()
        for batch in batches:
            tokens, salts, info = [], [], []
            for shingles in shingle_sets(batch.column(0), hasher, n):
                if not len(shingles) or (node := set_id(shingles)) in seen:
                    continue
                seen.add(node)  # at most the documents of one task
                ranks = common.ranks(shingles)
                plain = ranks == len(common)
                hot = np.flatnonzero(~plain)
                hot = shingles[hot[np.argsort(-ranks[hot])]]
                for role in roles(len(shingles)):
                    counted = plain & (shingles % part == 0) if role else plain
                    own, others = shingles[counted], shingles[plain & ~counted]  # ascending
                    more = max(prefix_length(len(shingles), num, den) - len(own), 0)
                    kept = own, others[:more], hot[: max(more - len(others), 0)]
                    tokens += kept
                    salts.append(np.repeat(np.array([0, -1, 1 + node % SALTS], np.int32), [len(x) for x in kept]))
                    info.append((node, role, len(shingles), len(own), len(salts[-1])))
            if info:
                node, role, size, own, k = (np.array(x, np.int64) for x in zip(*info, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.repeat(x.astype(kind), k)) for x, kind in ((node, np.int64), (role, np.int32))), pa.array(np.concatenate(salts)), *(pa.array(np.repeat(x.astype(np.int32), k)) for x in (size, own))],
                    names=["token", "node", "role", "salt", "size", "counted"],
                )

    return map_arrow(docs.select("text"), work, "token long, node long, role int, salt int, size int, counted int")


def _size_class(size: Column) -> Column:
    """Sets that can link are in one class or in two that follow one another, for similarities from 1/2 up."""
    return F.floor(F.log2(size.cast("double"))).cast("int")


def _meetings(docs: DataFrame, n: int, table, num: int, den: int) -> DataFrame:
    """Pairs of nodes (a, b) whose connected groups hold every two nodes that share a prefix shingle and may link by size."""
    here = Window.partitionBy("token", "role", "salt")
    rows = _prefix_tokens(docs, n, table, num, den).withColumns({"times": F.count("*").over(here), "alone": F.min("node").over(here) == F.max("node").over(here)})
    kind = F.when(F.col("salt") > 0, 2).otherwise(F.abs("salt"))
    shared = rows.where("salt > 0 OR NOT alone").select("node", "role", "size", "counted", F.struct(kind.alias("kind"), F.when(kind == 0, F.col("times")).otherwise(0).alias("times"), "token").alias("t"))
    sets = shared.groupBy("node", "role").agg(F.first("size").alias("size"), F.first("counted").alias("counted"), F.array_sort(F.collect_set("t")).alias("ts"))
    own = F.size(F.filter("ts", lambda t: t["kind"] == 0))
    prefix = F.col("size") - F.ceil(F.col("size") * num / den).cast("int") + 1
    # counted shingles that no other set has come first in the order
    sets = sets.withColumn("need", F.least(prefix - F.col("counted") + own, F.size("ts"))).where("need > 0")
    # two sets with the same first shingle meet there, and need not elsewhere
    sets = saved(sets.select("node", "role", "size", "need", "ts"))
    met = sets.select("node", "role", "size", F.col("ts")[0]["token"].alias("lead"), F.explode(F.slice("ts", F.lit(1), F.col("need"))).alias("t")).select("node", "role", "size", "lead", "t.token", "t.kind")
    order = Window.partitionBy("token", "role").orderBy("size", "node")
    before = {c: F.lag(c).over(order).alias(f"{c}0") for c in ("node", "size", "lead")}
    chained = met.where("kind < 2").select("token", "node", "size", "lead", *before.values())
    told = (F.col("lead") == F.col("lead0")) & (F.col("lead") != F.col("token"))
    pairs = chained.where((F.col("node") != F.col("node0")) & (den * F.col("size0").cast("long") >= num * F.col("size").cast("long")) & ~told).select(F.col("node0").alias("a"), F.col("node").alias("b"))
    level = _size_class(F.col("size"))
    hot = met.where("kind = 2").select("token", "role", "node", F.explode(F.array(level, level + 1)).alias("level"))
    least = hot.groupBy("token", "role", "level").agg(F.min("node").alias("a"))
    hung = hot.join(least, ["token", "role", "level"]).select("a", F.col("node").alias("b"))
    return saved(pairs.union(hung).distinct())


def _member_sets(docs: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """docs: id, text; tasks: id, node, chunks, keys. node, chunks, keys and shingles (a binary) of each node that takes part."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = list(shingle_sets(batch.column(0), hasher, n))
            own = pa.array([len(x) > 0 and set_id(x) == node for x, node in zip(found, batch.column(1).to_pylist(), strict=True)], pa.bool_())  # another text may bear the same id
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "chunks", "keys", "shingles"]).filter(own)

    texts = docs.join(tasks.select("id", "node", "chunks", "keys").hint("shuffle_hash"), "id").select("text", "node", "chunks", "keys")
    return map_arrow(texts, sets, "node long, chunks long, keys array<string>, shingles binary")


def _links(sets: DataFrame, table, num: int, den: int) -> DataFrame:
    """sets: node, keys of the tasks to take part in, shingles. Links found in the tasks' trees."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(table.value)

        def solved(nodes: list[int], held: list[bytes]) -> pa.RecordBatch:
            found = linked([np.frombuffer(x, np.uint64) for x in held], num, den, common.ranks)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"])

        key, nodes, held = None, [], []
        for batch in batches:
            for k, node, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield solved(nodes, held)
                    key, nodes, held = k, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    held.append(raw)
        if len(nodes) > 1:
            yield solved(nodes, held)

    rows = sets.select(F.explode("keys").alias("key"), "node", "shingles")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(rows.repartition(parts, "key").sortWithinPartitions("key", "node"), trees, "a long, b long")


def _chunks(weight: Column, sets: Column) -> Column:
    return F.ceil(F.greatest(weight / BLOCK_SHINGLES, sets / BLOCK_SETS)).cast("long")


def _to(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.filter(F.sequence(F.lit(0).cast("long"), n), lambda x: x < n)


def _tasks(placed: DataFrame) -> DataFrame:
    """placed: node, id, size, root (its block). The tasks (keys) where each node takes part: its chunk's, and for pivots those of all chunks of the block."""
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).getField("node") for i in range(PIVOTS)]
    weights = placed.groupBy("root").agg(F.sum("size").alias("weight"), F.count("*").alias("sets"), F.array(*pivots).alias("pivots"))
    known = placed.join(weights.select("root", _chunks(F.col("weight"), F.col("sets")).alias("chunks"), "pivots"), "root")
    key = lambda k: F.concat_ws(":", F.col("root").cast("string"), k.cast("string"))
    own = F.array(key(F.pmod(F.xxhash64("node"), "chunks")))
    keys = F.when((F.col("chunks") > 1) & F.array_contains("pivots", F.col("node")), F.transform(_to(F.col("chunks")), key)).otherwise(own)
    return known.select("root", "id", "node", "size", "chunks", keys.alias("keys"))


def _rest(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """The tasks for what the chunks of a block leave open: sets outside its largest group meet one another and that group, by chunks."""
    known = tasks.where("chunks > 1").join(found.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = known.groupBy("root", "part").agg(F.sum("size").alias("weight"), F.count("*").alias("sets"))
    largest = parts.groupBy("root").agg(F.max(F.struct("sets", "weight", "part")).alias("top"), F.sum("weight").alias("weight"), F.sum("sets").alias("sets"))
    open_ones = largest.where(F.col("sets") > F.col("top.sets")).select(
        "root", F.col("top.part").alias("top"), _chunks(F.col("weight") - F.col("top.weight"), F.col("sets") - F.col("top.sets")).alias("few"), _chunks(F.col("top.weight"), F.col("top.sets")).alias("many")
    )
    placed = known.join(open_ones, "root")
    key = lambda *x: F.concat_ws(":", F.col("root").cast("string"), *(y if isinstance(y, str) else y.cast("string") for y in x))
    i, j = F.pmod(F.xxhash64("node"), "few"), F.pmod(F.xxhash64("node"), "many")
    outside = F.concat(F.transform(_to(F.col("few")), lambda x: key(F.lit("r"), F.least(i, x), F.greatest(i, x))), F.transform(_to(F.col("many")), lambda y: key(F.lit("g"), i, y)))
    inside = F.transform(_to(F.col("few")), lambda x: key(F.lit("g"), x, j))
    return placed.select("node", F.when(F.col("part") == F.col("top"), inside).otherwise(outside).alias("keys"))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (its set's size), component_id (the smallest id that links lead to, its own included).

    Two documents link if their shingle sets (n words) have an intersection of at least num/den of the union.
    """
    placed = _placed(docs, n, num, den, id_col, text_col)
    names = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("name"))
    return placed.join(names, "root", "left").select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"))


def _placed(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, size, node and root (a node that stands for the component; null for an empty set) of each row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    scanned = saved(_scan(docs, n))
    table = spark.sparkContext.broadcast(_common(scanned))
    rows = scanned.where("token is null").select("id", "text_hash", "size", "node")
    blocks = components(_meetings(docs, n, table, num, den))
    nodes = rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    tasks = saved(_tasks(blocks.join(nodes, "node")))
    sets = saved(_member_sets(docs, tasks, n))
    links = saved(_links(sets, table, num, den))
    if not tasks.where("chunks > 1").isEmpty():
        rest = saved(_rest(tasks, components(links)))
        if not rest.isEmpty():
            links = links.union(saved(_links(sets.where("chunks > 1").select("node", "shingles").join(rest.select("node", "keys"), "node"), table, num, den)))
    return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def representatives(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of the smallest id, in their own columns.

    If rows of that id have several texts in the component, one of them stays; a text of theirs in another component stands for that. Of rows of equal id and text
    one stays. Rows without an id stay: nothing tells them apart.
    """
    placed = saved(_placed(docs, n, num, den, id_col, text_col)).where("id is not null")
    one = placed.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("kept")).select("kept.id", "kept.text_hash")
    kept = one.union(placed.where("root is null").select("id", "text_hash")).distinct().select(F.col("id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    known = docs.where(F.col(id_col).isNotNull()).withColumn("_row_hash", F.xxhash64(text_col))
    once = known.join(kept, (F.col(id_col) == F.col("_kept_id")) & (F.col("_row_hash") == F.col("_kept_hash")), "left_semi").dropDuplicates([id_col, "_row_hash"])
    return once.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))


#: The rows of op3: all pairs that share a shingle, counted, and what links lead to.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, ways.b FROM reached JOIN ways ON ways.a = reached.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) r USING (doc_id)
"""

ship(__name__)
