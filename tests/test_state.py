import pytest
from pyspark.sql import functions as F

from quire.schemas import BLOCKS, NOTES, struct
from quire.sources import state


@pytest.fixture
def blocks(spark):
    empty = spark.createDataFrame([], struct(BLOCKS))
    made = spark.range(200).select(F.when(F.col("id") % 100 != 99, (F.col("id") % 100).cast("string")).alias("doc_id"), F.col("id").cast("int").alias("block_no"), F.lit("paragraph").alias("kind"), F.lit("clash").alias("in_bucket"))
    return empty.unionByName(made.drop("in_bucket"), allowMissingColumns=True).withColumn("in_bucket", F.lit("clash"))


def kinds(df):
    return sorted((r["doc_id"] or "", r["block_no"], r["kind"]) for r in df.collect())


def folders(spark, path, version):
    return state._placed(spark, path, version)[0]["blocks"]


def touch(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "doc_id string")


def as_quote(doc):
    return lambda b: b.withColumn("kind", F.when(F.col("doc_id") == doc, "quote").otherwise(F.col("kind")))


def test_edits_write_their_buckets_alone(spark, blocks, tmp_path):
    path = str(tmp_path)
    state.save({"blocks": blocks}, path, 1, buckets=8)
    assert state.edit(spark, path, {"blocks": (touch(spark, "5"), as_quote("5"))}) == 2
    was, now = folders(spark, path, 1), folders(spark, path, 2)
    assert len(was) == 8 and sum(was[b] != now[b] for b in was) == 1
    assert kinds(state.load(spark, path, "blocks", 1)) == kinds(blocks)
    assert kinds(state.load(spark, path, "blocks", 2)) == kinds(as_quote("5")(blocks))
    # the null key has a bucket too; a document is taken away
    state.edit(spark, path, {"blocks": (touch(spark, None, "6"), lambda b: b.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != "6")))})
    assert kinds(state.load(spark, path, "blocks", state.latest(spark, path))) == kinds(as_quote("5")(blocks.where("doc_id <> '6'")))


def test_what_fails_leaves_the_version_before(spark, blocks, tmp_path):
    path = str(tmp_path)
    state.save({"blocks": blocks}, path, 1, buckets=4)
    notes = spark.createDataFrame([("5", 0, "n", "1", [], 0)], struct(NOTES))
    broken = lambda n: n.unionByName(notes.withColumn("marker", F.raise_error(F.lit("killed")).cast("string")))
    with pytest.raises(Exception, match="killed"):
        state.edit(spark, path, {"blocks": (touch(spark, "5"), as_quote("5")), "notes": (touch(spark, "5"), broken)})
    assert state.latest(spark, path) == 1 and kinds(state.load(spark, path, "blocks", 1)) == kinds(blocks)
    # the blocks' folder was written, and no version names it
    lost = [r["folder"] for r in state.unused(spark, path, 1).collect()]
    assert any("/blocks/" in f for f in lost) and not set(lost) & set(folders(spark, path, 1).values())
    state.edit(spark, path, {"blocks": (touch(spark, "5"), as_quote("5")), "notes": (touch(spark, "5"), lambda n: n.unionByName(notes))})
    assert state.load(spark, path, "notes", 2).count() == 1
    with pytest.raises(ValueError, match="does not touch"):
        state.edit(spark, path, {"blocks": (touch(spark, "5"), lambda b: b.withColumn("doc_id", F.col("block_no").cast("string")))})
    with pytest.raises(ValueError, match="already"):
        state.save({"blocks": blocks}, path, 2)


def test_many_edits_are_put_together(spark, blocks, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FOLDERS_MOST", 3)
    path = str(tmp_path)
    state.save({"blocks": blocks}, path, 1, buckets=16)
    want = blocks
    for doc in "12345":
        last = state.edit(spark, path, {"blocks": (touch(spark, doc), as_quote(doc))})
        want = as_quote(doc)(want)
        assert len(set(folders(spark, path, last).values())) <= 4
    assert kinds(state.load(spark, path, "blocks", last)) == kinds(want)


def test_empty_states(spark, blocks, tmp_path):
    path = str(tmp_path)
    assert state.latest(spark, path) is None and state.load(spark, path, "blocks", 1).count() == 0
    with pytest.raises(ValueError, match="nothing"):
        state.edit(spark, path, {})
    state.save({"blocks": blocks.limit(0)}, path, 1)
    assert state.latest(spark, path) == 1 and state.load(spark, path, "blocks", 1).count() == 0
    state.edit(spark, path, {"blocks": (touch(spark, "5"), lambda b: b.unionByName(blocks.where("doc_id = '5'").drop("in_bucket")))})
    assert state.load(spark, path, "blocks", 2).count() == 2
