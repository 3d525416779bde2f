"""Vectors in Arrow batches, and packs of them: rows of a table that hold a bounded number of vectors, so that a pack of queries meets a pack of candidates in one product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quire.shipping import ship

#: Candidates and queries of a pack, about: packs are dealt by hashes.
LIST_ROWS, QUERY_ROWS = 4096, 1024


def component_type(df: DataFrame, vector_col: str) -> str:
    """float where the vectors are of floats, else double."""
    kind = df.schema[vector_col].dataType
    return "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"


def sound(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """One row a vector, as doubles; shorter ones filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == most).all():
        return flat.reshape(len(lengths), most)
    out = np.zeros((len(lengths), most))
    out[np.arange(most) < lengths[:, None]] = flat
    return out


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); integers of any size where they don't fit into 64 bits."""
    out = np.floor(values * scale)
    if np.abs(out).max(initial=0) < 2**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, all rows by all rows: in doubles below 2**53, else in integers of any size."""
    width = min(a.shape[1], b.shape[1])  # the shorter ones' missing components are zero
    a, b = a[:, :width], b[:, :width]
    if a.dtype != object and b.dtype != object and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def members(batch: pa.RecordBatch, column: str, row: int) -> pa.StructArray:
    """The structs that one row's pack holds."""
    return batch.column(column)[row].values


def sampled(rows: DataFrame, by: list[str], about: int, n: int) -> DataFrame:
    """The rows whose hash falls below a bound: about `about` of n, the same ones at every run."""
    if n <= about:
        return rows
    return rows.where(F.xxhash64(*by).bitwiseAND((1 << 62) - 1) < int((1 << 62) * about / n))


def chunked(rows: DataFrame, sizes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, chunk, list: the rows of each key in packs of LIST_ROWS or so, however many rows a key has. sizes: keys, chunks; a small table."""
    dealt = rows.join(F.broadcast(sizes), keys).withColumn("chunk", F.pmod(F.xxhash64("id", "value"), F.col("chunks")).cast("int"))
    return dealt.groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*fields)).alias("list"))


def met(visits: DataFrame, lists: DataFrame, sizes: DataFrame, keys: list[str], fields: list[str], blocks: int) -> DataFrame:
    """keys, chunk, list, queries: each pack of candidates beside the packs of queries that visit its key."""
    sent = visits.join(F.broadcast(sizes), keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    packs = sent.groupBy(*keys, "chunk", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*fields)).alias("queries"))
    return packs.join(lists, [*keys, "chunk"]).select("list", "queries")


ship(__name__)
