"""A stream of files: each new content is taken in once, whatever its name and however often it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.files import described

#: What Spark's binaryFile source gives.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """The described files below path as they appear, without contents seen before. The state is one fingerprint a file."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(path)
    return described(files).where(F.col("kind").isNotNull()).dropDuplicates(["fingerprint"])


def intake(spark: SparkSession, path: str, state: str, checkpoint: str) -> StreamingQuery:
    """Take all files there now into the Parquet table at state, batch by batch; a batch that is done again adds nothing twice.

    What the state holds already (also from other runs) is left out by an anti-join on fingerprints.
    """

    def take(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["fingerprint"])
        try:
            known = batch.sparkSession.read.parquet(state).where(F.col("batch") != number).select("fingerprint")
            once = once.join(known, "fingerprint", "left_anti")
        except Exception as e:  # the table doesn't exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        once.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)

    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(path)
    return described(files).where(F.col("kind").isNotNull()).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
