"""What the operators of this subpackage share: reading, checkpoints, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.saving import saved
from quire.shipping import ship

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a run of long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def filter_arrow(df: DataFrame, column: str, keeps: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows of df for which what keeps() makes, once a task, says true of the column's values. No shuffle; df's columns stay as they are."""
    place = df.columns.index(column)
    names = [f"_{k}" for k in range(len(df.columns))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = keeps()
        for batch in batches:
            yield batch.filter(pa.array(said(batch.column(place)), pa.bool_()))

    numbered = df.toDF(*names)
    return map_arrow(numbered, work, numbered.schema).toDF(*df.columns)


def bucket_of(column: str, by: int, remainder: int) -> Column:
    """Whether crc32 of the column as text leaves this remainder; false where it is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by == remainder, F.lit(False))


__all__ = ["bounded_batches", "bucket_of", "filter_arrow", "map_arrow", "saved", "table"]

ship(__name__)
