"""Lists of readings: order, duplicates, counters, sizes, edits. All native; nothing but counts comes to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import page_range, plain_text
from quire.shipping import ship

#: Fixed values.
LOW_CONFIDENCE, OVERHEAD, STREAM_ABOVE, UNDO_SECONDS = 70, 200_000, 150 * 1024 * 1024, 9


@dataclass(frozen=True)
class BundleSettings:
    title: str = "Weekly readings"
    author: str = ""
    language: str = "en"
    ocr_language: str = "eng"
    page_markers: bool = True
    sections_in_toc: bool = True
    kepub: bool = False
    file_name: str | None = None


def done(readings: DataFrame) -> DataFrame:
    return readings.where("status = 'done'")


def ordered(readings: DataFrame) -> DataFrame:
    """readings with place (from 0) and grouped: by course in order of first appearance, if there are several courses.

    A list of readings is a user's; it is numbered in one task.
    """
    key = F.trim(F.coalesce("course", F.lit("")))
    everything = Window.partitionBy(F.lit(0))
    several = F.size(F.collect_set(F.when(key != "", key)).over(everything)) > 1
    first = F.min("seq").over(Window.partitionBy(key))
    marked = readings.withColumns({"grouped": several, "_first": first})
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("grouped"), F.col("_first")).otherwise(F.lit(0)), "seq")) - 1
    return marked.withColumn("place", place).drop("_first")


def courses(readings: DataFrame) -> DataFrame:
    """Distinct courses by first appearance."""
    return readings.groupBy(F.trim("course").alias("course")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


def duplicates(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Later copies of a reading: the same source key, else the same type, name and number of pages."""
    counts = pages.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("_pages"))
    key = F.coalesce("source_key", F.concat_ws("|", "file_type", "file_name", F.coalesce(F.col("_pages").cast("string"), F.lit("?"))))
    copies = Window.partitionBy("_key").orderBy("seq", "id")
    return readings.join(counts, "id", "left").withColumn("_key", key).withColumn("_nth", F.row_number().over(copies)).where("_nth > 1").drop("_key", "_nth", "_pages")


def counters(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: total, done, waiting, failed, review (done readings with a doubtful page)."""
    doubtful = pages.where(F.col("confidence") < LOW_CONFIDENCE).select(F.col("doc_id").alias("id")).distinct().withColumn("_low", F.lit(True))
    status = F.col("status")
    return readings.join(doubtful, "id", "left").agg(
        F.count("*").alias("total"), F.count_if(status == "done").alias("done"), F.count_if(status.isin("queued", "processing")).alias("waiting"), F.count_if(status == "error").alias("failed"), F.count_if((status == "done") & F.col("_low")).alias("review")
    )


def size_estimate(blocks: DataFrame, notes: DataFrame, images: DataFrame) -> DataFrame:
    """One row: bytes, an estimate of the bundle's size from its text as JSON, its images and a fixed share."""
    text = lambda df: df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("n"))
    used = blocks.where("kind = 'figure'").select(F.col("image").alias("id")).distinct()
    pictures = images.join(used, "id", "left_semi").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n"))
    parts = text(blocks).select((F.col("n") / 6).alias("n")).union(text(notes).select(F.col("n") / 6)).union(pictures)
    return parts.agg(F.floor(F.sum("n") + OVERHEAD + 0.5).cast("long").alias("bytes"))


def review_groups(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document and page its blocks in order, pages without blocks included; blocks without a page come first, as page -1."""
    own = blocks.groupBy("doc_id", F.coalesce("page", F.lit(-1)).alias("page")).agg(F.sort_array(F.collect_list(F.struct("block_no", "kind", plain_text(F.col("content")).alias("text")))).alias("blocks"))
    every = pages.select("doc_id", "page").union(own.select("doc_id", "page")).distinct()
    return every.join(own, ["doc_id", "page"], "left")


def low_confidence_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("confidence") < LOW_CONFIDENCE)


def page_ranges(pages: DataFrame) -> DataFrame:
    """doc_id, range: "pp. 47–71" from the first and last printed label; '' without any."""
    known = F.col("label") != ""
    ends = pages.groupBy("doc_id").agg(F.min_by("label", F.when(known, F.col("page"))).alias("a"), F.max_by("label", F.when(known, F.col("page"))).alias("b"))
    return ends.select("doc_id", page_range(F.col("a"), F.col("b")).alias("range"))


def used_images(blocks: DataFrame, images: DataFrame, place: Column | None = None) -> DataFrame:
    """Images that figures show, with their number by first use: that of the least place (document and block by default); these uses are numbered by document and block."""
    use = F.struct("doc_id", "block_no")
    first = blocks.where("kind = 'figure' and image is not null").groupBy("image").agg(F.min_by(use, use if place is None else place).alias("at"))
    shown = images.join(first, images["id"] == first["image"]).drop("image")
    return shown.withColumn("number", F.row_number().over(Window.orderBy("at"))).drop("at")


def garbage(stored: DataFrame, *live: DataFrame) -> DataFrame:
    """stored (key) without what any of live (key) names."""
    names = live[0]
    for more in live[1:]:
        names = names.union(more)
    return stored.join(names, "key", "left_anti")


def label_lookup(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (doc_id, page) with the page's printed label, else its ordinal."""
    found = rows.join(pages.select("doc_id", "page", F.col("label").alias("_label")), ["doc_id", "page"], "left")
    return found.withColumn("label", F.coalesce(F.when(F.col("_label") != "", F.col("_label")), (F.col("page") + 1).cast("string"))).drop("_label")


def next_queued(readings: DataFrame) -> DataFrame:
    """The first reading that waits."""
    return readings.where("status = 'queued'").orderBy("seq").limit(1)


def selected_between(readings: DataFrame, anchor: int, row: int) -> DataFrame:
    """The readings from one place to another, whichever comes first."""
    return readings.where(F.col("seq").between(min(anchor, row), max(anchor, row)))


def appended(readings: DataFrame, new: DataFrame) -> DataFrame:
    return readings.unionByName(new, allowMissingColumns=True)


# Edits: each gives the table as it is afterwards.


def restored(readings: DataFrame) -> DataFrame:
    """Readings after a restart: what was under way waits again."""
    return readings.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def patched(readings: DataFrame, ids: list[str], **values) -> DataFrame:
    hit = F.col("id").isin(ids)
    return readings.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def course_set(readings: DataFrame, ids: list[str], course: str) -> DataFrame:
    return patched(readings, ids, course=course)


def moved(readings: DataFrame, start: int, to: int) -> DataFrame:
    """readings with the one at seq `start` put to seq `to`; those between move by one."""
    seq = F.col("seq")
    shift = -1 if start < to else 1
    between = seq.between(min(start, to), max(start, to))
    return readings.withColumn("seq", F.when(seq == start, to).when(between, seq + shift).otherwise(seq).cast("int"))


def retried(readings: DataFrame, rotations: DataFrame, ids: list[str], turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """The readings queued again, and rotations (id, quarter turns) with theirs turned further."""
    again = patched(patched(readings, ids, status="queued", progress=0.0), ids, message=None)
    turned = rotations.withColumn("turns", F.when(F.col("id").isin(ids), F.pmod(F.col("turns") + turn, F.lit(4))).otherwise(F.col("turns")))
    return again, turned


def removed(readings: DataFrame, ids: list[str], now: Column) -> DataFrame:
    """Soft delete: removed_at marks rows that undo() can bring back until they expire."""
    own = F.col("removed_at") if "removed_at" in readings.columns else F.lit(None).cast("timestamp")
    return readings.withColumn("removed_at", F.when(F.col("id").isin(ids), now).otherwise(own))


def undone(readings: DataFrame, ids: list[str]) -> DataFrame:
    return patched(readings, ids, removed_at=None)


def finalized(readings: DataFrame, now: Column) -> DataFrame:
    """Without rows whose time to undo is over."""
    return readings.where(F.col("removed_at").isNull() | (F.col("removed_at") + F.expr(f"INTERVAL {UNDO_SECONDS} SECONDS") > now))


def present(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("removed_at").isNull())


def merged_results(readings: DataFrame, results: DataFrame) -> DataFrame:
    """readings after processing: results (id, new_title, new_author, auto_title, n_blocks, error).

    A title that the user changed stays, as does an author; without blocks or with an error the reading failed.
    """
    both = readings.join(results, "id", "left")
    processed = F.col("n_blocks").isNotNull() | F.col("error").isNotNull()
    failed = F.col("error").isNotNull() | (F.col("n_blocks") == 0)
    title = F.when((F.col("title") == F.col("auto_title")) & F.col("new_title").isNotNull(), F.col("new_title")).otherwise(F.col("title"))
    message = F.when(processed, F.coalesce("error", F.when(F.col("n_blocks") == 0, "No text was found in this file."))).otherwise(F.col("message"))
    values = {
        "title": title,
        "author": F.coalesce(F.when(F.col("author") != "", F.col("author")), "new_author", F.lit("")),
        "message": message,
        "progress": F.when(processed & ~failed, 1.0).otherwise(F.col("progress")),
        "status": F.when(processed & failed, "error").when(processed, "done").otherwise(F.col("status")),
    }
    return both.withColumns(values).select(*readings.columns)


def renumbered(pages: DataFrame, doc_id: str, first: int) -> DataFrame:
    return pages.withColumn("label", F.when(F.col("doc_id") == doc_id, (F.col("page") + first).cast("string")).otherwise(F.col("label")))


def block_kind_set(blocks: DataFrame, doc_id: str, block_no: int, kind: str, level: int | None = None) -> DataFrame:
    """blocks with one made a heading, paragraph or quote, or, with kind "remove", without it."""
    hit = (F.col("doc_id") == doc_id) & (F.col("block_no") == block_no)
    if kind == "remove":
        return blocks.where(~hit)
    style = F.lit("quote" if kind == "quote" else None).cast("string")
    return blocks.withColumns(
        {"kind": F.when(hit, "paragraph" if kind == "quote" else kind).otherwise(F.col("kind")), "level": F.when(hit, F.lit(level).cast("int")).otherwise(F.col("level")), "style": F.when(hit, style).otherwise(F.col("style"))}
    )


def replaced(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with all rows of the keys in new replaced by new's."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


ship(__name__)
