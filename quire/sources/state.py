"""State between runs: versions of a few tables, below one folder that all executors share.

A table's rows lie in buckets by the hash of their document's key, as Parquet below `data`. A version is a manifest: one small file that says for each table
and bucket in which folder its rows are. It is written last, as one file, so a version is there as a whole, for all its tables, or not at all: a write that
fails or is killed leaves the version before, and folders that no manifest names (see unused()). An edit writes only the buckets of the keys it touches;
all others stay in the folders where they are. There is one writer at a time; readers need not wait.

Rows without a key share one bucket. Repeated rows stay. Tables that were never saved, and emptied ones, are read as empty. Columns that are not of a
table's schema are not kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import bundle
from quire.operators.bundle import BundleSettings

TABLES = {"readings": schemas.READINGS, "pages": schemas.PAGES, "blocks": schemas.BLOCKS, "notes": schemas.NOTES, "images": schemas.IMAGES, "sources": schemas.SOURCES}
#: The column by which a table's rows are dealt.
KEYS = {"readings": "id", "pages": "doc_id", "blocks": "doc_id", "notes": "doc_id", "images": "id", "sources": "source_id"}
#: Buckets of a table. Manifests have a row for each, and only they pass the driver, so its work does not grow with the data.
BUCKETS = 64
#: A table that lies in so many folders is written anew with its next edit, so that reading stays one scan of a few folders.
FOLDERS_MOST = 16

_MANIFEST = "version int, name string, bucket int, folder string, buckets int"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all manifests."""
    return _read(spark, f"{path}/manifest", _MANIFEST)


def latest(spark: SparkSession, path: str) -> int | None:
    return versions(spark, path).agg(F.max("version")).first()[0]


def save(tables: dict[str, DataFrame], path: str, version: int, buckets: int = BUCKETS) -> None:
    """Write tables as a new version; tables that aren't given are empty in it. They may be read from older versions."""
    spark = next(iter(tables.values())).sparkSession
    if versions(spark, path).where(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} is there already")
    placed = {}
    for name, df in tables.items():
        folder, filled = _write(df, path, name, buckets)
        placed[name] = dict.fromkeys(filled, folder)
    _commit(spark, path, version, placed, buckets)


def load(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """A table as it was saved; an empty one if it never was. Readings that were under way wait again."""
    placed, _ = _placed(spark, path, version)
    df = _rows(spark, name, placed.get(name, {}))
    return bundle.restored(df) if name == "readings" else df


def edit(spark: SparkSession, path: str, edits: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> int:
    """Make a new version from the latest by edits of tables, all in one; its number.

    An edit is the keys that it touches (a table with the column KEYS[name]) and a function that gets the rows of their buckets, and gives them as they shall be.
    Rows with other keys in these buckets must be given back; rows of other buckets must not be made.
    """
    version = latest(spark, path)
    if version is None:
        raise ValueError("nothing is saved yet")
    placed, buckets = _placed(spark, path, version)
    for name, (keys, change) in edits.items():
        own = placed.setdefault(name, {})
        touched = {r[0] for r in keys.select(_bucket(F.col(KEYS[name]), buckets)).distinct().collect()}
        if not touched:
            continue
        made = change(_rows(spark, name, {b: f for b, f in own.items() if b in touched}))
        if len(set(own.values())) >= FOLDERS_MOST:
            made = made.unionByName(_rows(spark, name, {b: f for b, f in own.items() if b not in touched}))
            touched |= own.keys()
        folder, filled = _write(made, path, name, buckets)
        if strange := sorted(set(filled) - touched):
            raise ValueError(f"the edit of {name} made rows of buckets it does not touch: {strange[:5]}")
        placed[name] = {b: f for b, f in own.items() if b not in touched} | dict.fromkeys(filled, folder)
    _commit(spark, path, version + 1, placed, buckets)
    return version + 1


def unused(spark: SparkSession, path: str, least: int) -> DataFrame:
    """folder: those that no version from least on names, left by older versions or by writes that failed. To be asked, and acted on, by the writer alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/data").select("path")
    folders = listed.select(F.regexp_extract("path", "/data/([^/]+/[^/]+)/", 1).alias("folder")).distinct()
    named = versions(spark, path).where(F.col("version") >= least).select(F.regexp_extract("folder", "/data/([^/]+/[^/]+)$", 1).alias("folder"))
    return folders.join(named, "folder", "left_anti").select(F.concat(F.lit(f"{path}/data/"), "folder").alias("folder"))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def _placed(spark: SparkSession, path: str, version: int) -> tuple[dict[str, dict[int, str]], int]:
    """Per table the folder of each bucket that has rows; the number of buckets."""
    placed: dict[str, dict[int, str]] = {}
    buckets = BUCKETS
    for r in versions(spark, path).where(F.col("version") == version).collect():
        buckets = r["buckets"]
        if r["name"] is not None:
            placed.setdefault(r["name"], {})[r["bucket"]] = r["folder"]
    return placed, buckets


def _rows(spark: SparkSession, name: str, placed: dict[int, str]) -> DataFrame:
    """The rows of these buckets; other partitions of their folders are not read."""
    out = spark.createDataFrame([], schemas.struct(TABLES[name]))
    for folder in sorted(set(placed.values())):
        own = [b for b, f in placed.items() if f == folder]
        out = out.unionByName(spark.read.schema(f"{TABLES[name]}, in_bucket int").parquet(folder).where(F.col("in_bucket").isin(own)).drop("in_bucket"))
    return out


def _write(df: DataFrame, path: str, name: str, buckets: int) -> tuple[str, list[int]]:
    """Write rows to a folder of their own; it and the buckets that have rows. Large buckets are split over tasks and files, small ones put together in one task."""
    folder = f"{path}/data/{name}/{uuid.uuid4().hex}"
    kept = [c for c in schemas.struct(TABLES[name]).names if c in df.columns]
    dealt = df.select(*kept, _bucket(F.col(KEYS[name]), buckets).alias("in_bucket"))
    dealt.hint("rebalance", F.col("in_bucket")).write.partitionBy("in_bucket").parquet(folder)
    filled = df.sparkSession.read.schema(f"{TABLES[name]}, in_bucket int").parquet(folder).select("in_bucket").distinct()
    return folder, [r[0] for r in filled.collect()]


def _commit(spark: SparkSession, path: str, version: int, placed: dict[str, dict[int, str]], buckets: int) -> None:
    rows: Iterable[tuple] = [(name, b, folder, buckets) for name, own in placed.items() for b, folder in own.items()]
    # a version without any row is one too
    made = spark.createDataFrame(rows or [(None, None, None, buckets)], "name string, bucket int, folder string, buckets int")
    made.coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def cleared(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows: what save() takes to start over. Settings stay."""
    return {name: spark.createDataFrame([], schemas.struct(ddl)) for name, ddl in TABLES.items()}


def settings_from(stored: dict) -> BundleSettings:
    """Settings as stored, with defaults for what older states lack; what isn't known any more is left out."""
    known = {f.name for f in fields(BundleSettings)}
    return BundleSettings(**(asdict(BundleSettings()) | {k: v for k, v in stored.items() if k in known}))


def without_garbage(stored: DataFrame, key: str, live: DataFrame) -> DataFrame:
    """stored without rows whose key none of live (key) names."""
    return stored.join(live.select(key).distinct(), key, "left_semi")
