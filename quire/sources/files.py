"""Files as rows: scan, kind, fingerprint, and the intake rules that keep known files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.hashing import fingerprint, source_key
from quire.functions.text import kind_of, natural_key, stable_id, title_from_file_name


def scan(spark: SparkSession, path: str) -> DataFrame:
    """source_id, name, content, length, fingerprint, kind of every file below path."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def described(files: DataFrame) -> DataFrame:
    """The same from a binaryFile source, batch or stream."""
    return files.select(
        stable_id(F.col("path")).alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length", fingerprint(F.col("content")).alias("fingerprint"), kind_of(F.col("path")).alias("kind")
    )


def known_fingerprints(readings: DataFrame) -> DataFrame:
    """Every fingerprint in the readings' source keys; pass removed but undoable readings along."""
    return readings.where(F.col("source_key").isNotNull()).select(F.explode(F.split("source_key", ";")).alias("fingerprint")).distinct()


def classify_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch (seq, name, kind, fingerprint) with outcome: repeat, skipped, known, photo or reading, in that order of precedence."""
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq"))
    marked = batch.withColumn("_nth", first).join(known.select("fingerprint", F.lit(True).alias("_known")), "fingerprint", "left")
    outcome = F.when(F.col("_nth") > 1, "repeat").when(F.col("kind").isNull(), "skipped").when(F.col("_known"), "known").when(F.col("kind") == "image", "photo").otherwise("reading")
    return marked.withColumn("outcome", outcome).drop("_nth", "_known")


def new_readings(classified: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (id, seq, title, author, course, file_name, file_type, source_key, status) for a classified batch.

    Photos make one reading, the last, named for the first in natural order. All take over the last reading's course.
    """
    base = readings.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"), F.coalesce(F.max_by("course", "seq"), F.lit("")).alias("course"))
    own = classified.where("outcome = 'reading'").select(F.col("seq").alias("_order"), F.col("name").alias("file_name"), F.col("kind").alias("file_type"), F.col("fingerprint").alias("source_key"))
    photos = classified.where("outcome = 'photo'").agg(
        F.lit(2**31 - 1).alias("_order"), F.min_by("name", F.struct(natural_key(F.col("name")), "seq")).alias("file_name"), F.lit("image").alias("file_type"), source_key(F.collect_list("fingerprint")).alias("source_key")
    )
    both = own.unionByName(photos.where(F.col("file_name").isNotNull()))
    # one batch of picked files, not the corpus: its rows may be numbered in one task
    numbered = both.withColumn("_n", F.row_number().over(Window.orderBy("_order"))).join(F.broadcast(base))
    return numbered.select(
        stable_id(F.col("source_key"), F.col("_n")).alias("id"), (F.col("_last") + F.col("_n")).cast("int").alias("seq"), title_from_file_name(F.col("file_name")).alias("title"),
        F.lit("").alias("author"), "course", "file_name", "file_type", "source_key", F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit(None).cast("string").alias("message"),
    )


def photo_order(photos: DataFrame) -> DataFrame:
    """photos (reading_id, name) with their place (from 0) in natural order."""
    return photos.withColumn("place", F.row_number().over(Window.partitionBy("reading_id").orderBy(natural_key(F.col("name")), "name")) - 1)
