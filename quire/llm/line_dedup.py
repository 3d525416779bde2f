"""Line dedup by winnowing, in DataFrame operations only.

1. A window is a run of lines that holds `words` words and would not without its first or without its last line; blank lines don't count.
   In each window the line with the smallest hash (the last of equal ones) is selected; it is a fingerprint once, however many windows select it.
   No other line goes further. Every run of at least `words` words is a union of windows, so wherever it stands again the same lines are selected.
2. Fingerprints are counted by their line's hash. Those whose line is selected nowhere else are done with.
3. The others are joined with the first place of their line (in order of id, text hash and line) and extended both ways by comparing
   line hashes, as far as the fingerprint's windows go. What lies in a window that the extension covers is repeated.
4. A window that goes on differently at the line's first place may stand at another earlier one: such windows, and they alone, are joined
   with the first place of their line's hash and their own hash, so no earlier place is left out, and none is met twice.
5. Each document's repeated windows are merged into runs, which are deleted; the first place stays.

A window that overlaps its own first place in the same text isn't repeated: of one line over and over, a window's worth stays. Every deleted
line stands at an earlier place that stays.

A line that a third of all documents hold is one hash: its counts are summed before they are shuffled, and joins meet one first place a key, so
they can be split. No two of its places are paired.

Single lines below `words` words, however frequent, are never deleted unless they lie in such a run. Blank lines inside a deleted run go
with it. Null and empty texts stay as they are, and an empty table gives an empty one. Rows with equal id and text are one document and get the same
result. Of places of equal id the smaller text hash comes first; rows without an id come first of all. A very long text is one row, whose lines are sorted and
may spill. Other columns, whatever their names, pass through unchanged, but for those of the result's names, which are replaced.
Hashes have 64 bits; two windows that meet in step 4 agree in both of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.llm.common import saved

WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, id, pos (from 0), h, words, idx (from 1, among lines with words), s and e (words before and after it) of each line with words."""
    parts = docs.where(F.col(text_col).isNotNull()).select(_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = parts.select("k", "id", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).where("words > 0")
    order = Window.partitionBy("k").orderBy("pos")
    once = rows.withColumn("again", F.lag("pos").over(order).eqNullSafe(F.col("pos"))).where("not again").drop("again")
    return once.withColumns({"idx": F.row_number().over(order).cast("long"), "e": F.sum("words").over(order)}).withColumn("s", F.col("e") - F.col("words"))


def _windows(lines: DataFrame, words: int) -> DataFrame:
    """k, id, first and last line (pos, end_pos, idx, end_idx), selected line (at, h) and all line hashes (lines) of each window."""
    opens = _window(Window.partitionBy("k").orderBy("s").rangeBetween(0, words - 1), F.lit(0))
    # a run that its first line opens is no window of its last line's once more
    closes = _window(Window.partitionBy("k").orderBy("e").rangeBetween(1 - words, 0), F.col("words"))
    found = lines.select("k", "id", opens.alias("opens"), closes.alias("closes")).select("k", "id", F.explode(F.array("opens", "closes")).alias("w"))
    return found.where(F.col("w.held") >= words).select("k", "id", "w.pos", "w.end_pos", "w.idx", "w.end_idx", F.col("w.least.h").alias("h"), (-F.col("w.least.back")).alias("at"), "w.lines")


def _window(run: WindowSpec, less: Column) -> Column:
    """A struct of the run of lines; its words are counted without so many."""
    least = F.min(F.struct("h", (-F.col("idx")).alias("back"))).over(run)
    ends = [f(c).over(run).alias(p + c) for c in ("pos", "idx") for f, p in ((F.min, ""), (F.max, "end_"))]
    return F.struct(*ends, least.alias("least"), F.collect_list("h").over(run).alias("lines"), (F.sum("words").over(run) - less).alias("held"))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, id, at (line, from 1 among lines with words), h (its hash), before and after (hashes of the lines around it, as far as its
    windows reach) and windows of every selected line."""
    before = F.col("at") - F.col("idx")
    found = _windows(_lines(docs, id_col, text_col), words).select(
        "k", "id", "at", "h", "idx", "end_idx", F.slice("lines", F.lit(1), before).alias("before"), F.slice("lines", before + 2, F.size("lines")).alias("after"), F.struct("idx", "end_idx", "pos", "end_pos").alias("window")
    )
    return found.groupBy("k", "id", "at").agg(F.min("h").alias("h"), F.min_by("before", "idx").alias("before"), F.max_by("after", "end_idx").alias("after"), F.collect_list("window").alias("windows"))


def _agree(a: Column, b: Column) -> Column:
    """How many leading values of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def _overlaps(window: Column | None = None) -> Column:
    """Whether a window overlaps its first place."""
    end, start = (F.col("end_idx"), F.col("idx")) if window is None else (window["end_idx"], window["idx"])
    return (F.col("k") == F.col("first.k")) & (F.col("at") - F.col("first.at") <= end - start)


def repeated_windows(marks: DataFrame) -> DataFrame:
    """k, first and last (line numbers from 0) of what stands at an earlier place too, from fingerprints()."""
    place = F.struct("id", "k", "at")
    shared = marks.groupBy("h").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("h", "first")
    met = saved(marks.join(shared, "h"))
    is_first = (F.col("k") == F.col("first.k")) & (F.col("at") == F.col("first.at"))
    firsts = met.where(is_first).select("h", F.col("before").alias("before0"), F.col("after").alias("after0"))
    low = F.col("at") - _agree(F.reverse("before"), F.reverse("before0"))
    high = F.col("at") + _agree(F.col("after"), F.col("after0"))
    extended = met.where(~is_first).join(firsts, "h").withColumns({"low": low, "high": high})
    inside = lambda w: (w["idx"] >= F.col("low")) & (w["end_idx"] <= F.col("high"))
    parted = extended.select(
        "h", "k", "id", "at", "before", "after", F.filter("windows", lambda w: inside(w) & ~_overlaps(w)).alias("along"), F.filter("windows", lambda w: ~inside(w)).alias("other")
    )
    parted = saved(parted.where((F.size("along") > 0) | (F.size("other") > 0)))
    along = parted.where(F.size("along") > 0).select("k", F.array_min("along.pos").alias("first"), F.array_max("along.end_pos").alias("last"))
    around = F.concat("before", F.array("h"), "after")
    others = parted.select("h", "k", "id", "at", around.alias("around"), (F.col("at") - F.size("before")).alias("from"), F.inline("other"))
    others = others.select("h", "k", "id", "at", "idx", "end_idx", "pos", "end_pos", F.xxhash64(F.slice("around", F.col("idx") - F.col("from") + 1, F.col("end_idx") - F.col("idx") + 1)).alias("whole"))
    again = others.groupBy("h", "whole").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("h", "whole", "first")
    elsewhere = others.join(again, ["h", "whole"]).where(~_overlaps()).select("k", F.col("pos").alias("first"), F.col("end_pos").alias("last"))
    return along.union(elsewhere)


def repeated_runs(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k (hash of id and text) and runs, an ascending array of disjoint structs (first, last) of line numbers to delete."""
    ranges = repeated_windows(saved(fingerprints(docs, words, id_col, text_col)))
    order = Window.partitionBy("k").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("opens", F.when(F.coalesce(F.col("first") > reach + 1, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("opens").over(order))
    merged = islands.groupBy("k", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated runs deleted from the text, and _n_lines, _n_deleted (long; 0 for null texts) and _runs besides."""
    docs = docs.drop("_n_lines", "_n_deleted", "_runs")
    runs = repeated_runs(docs, words, id_col, text_col)
    joined = docs.select(_key(id_col, text_col).alias("k"), F.struct("*").alias("doc")).join(runs, "k", "left")
    text = F.col("doc").getField(text_col)
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    deleted = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + (r["last"] - r["first"] + 1).cast("long"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    own = [F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return joined.select(*own, n_lines.alias("_n_lines"), F.coalesce(deleted, F.lit(0).cast("long")).alias("_n_deleted"), F.col("runs").alias("_runs"))


def without_emptied(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs after the deletion, in their own columns; those of which nothing but blank lines is left go, as their text stands elsewhere."""
    out = dedup_lines(docs, words, id_col, text_col)
    return out.where((F.col("_n_deleted") == 0) | F.col(text_col).rlike(WORD)).select(*docs.columns)


#: The rows of op10: line numbers are compared by their text, windows by the list of their lines.
ORACLE_SQL = f"""
WITH parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM parts),
lines AS (SELECT doc_id, pos, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS s FROM counted WHERE words > 0),
windows AS (SELECT doc_id, pos, idx, list(line) OVER w AS whole, sum(words) OVER w AS held, max(pos) OVER w AS end_pos, max(idx) OVER w AS end_idx FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)),
placed AS (SELECT *, first_value(doc_id) OVER w AS doc0, first_value(idx) OVER w AS idx0 FROM windows WHERE held >= {WORDS} WINDOW w AS (PARTITION BY whole ORDER BY doc_id, idx)),
matched AS (SELECT doc_id, pos, end_pos, end_idx, doc0, idx - idx0 AS shift FROM placed WHERE doc_id <> doc0 OR idx - idx0 > end_idx - idx),
steps AS (SELECT m.*, a.idx AS j, a.pos AS jpos, a.line = b.line AS same FROM matched m JOIN lines a ON a.doc_id = m.doc_id AND a.idx > m.end_idx AND a.idx <= m.end_idx + {WORDS} LEFT JOIN lines b ON b.doc_id = m.doc0 AND b.idx = a.idx - m.shift),
tails AS (SELECT doc_id, end_pos, jpos, bool_and(coalesce(same, false)) OVER (PARTITION BY doc_id, doc0, shift, end_idx, pos ORDER BY j) AS whole FROM steps),
gone AS (
  SELECT DISTINCT doc_id, p AS pos FROM (SELECT doc_id, unnest(range(pos, end_pos + 1)) AS p FROM matched)
  UNION SELECT doc_id, unnest(range(end_pos + 1, jpos + 1)) FROM tails WHERE whole),
filled AS (SELECT c.doc_id, c.pos, c.line, g.pos IS NOT NULL AS gone FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos)
SELECT d.doc_id, coalesce(f.n_lines, 0)::BIGINT AS n_lines, coalesce(f.n_deleted, 0)::BIGINT AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(f.text, '')) END AS text_md5
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text FROM filled GROUP BY doc_id) f USING (doc_id)
"""
