import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from against_sql import SF, same

import corpus_pipeline
from quire.llm import decontaminate, registry
from quire.llm.common import table
from quire.llm.ngram_join import ngram_components

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_ten_queries():
    assert sorted(int(x[2:].split("_")[0]) for x in registry.queries()) == list(range(1, 11))


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    got = registry.op5_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.95 * got.count() > 0


def ranked_right(good, bad):
    """The share of pairs of a good and a bad row in which the good one has the higher score; ties count half."""
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(LARGER).exists(), reason="no tables here")
def test_held_out_quality(spark):
    """On a table that holds enough held-out rows of both kinds."""
    labels = table(spark, LARGER, "labels").select("doc_id", "quality")
    got = registry.op6_quality_classifier(spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in got if r["quality"] == k] for k in (1, 0))
    assert len(good) > 300 and len(bad) > 50
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.9 * len(bad)
    assert ranked_right([r["score"] for r in good], [r["score"] for r in bad]) >= 0.99


def test_verbatim_benchmark_items_are_found(spark):
    docs = table(spark, SF, "documents").collect()
    items = table(spark, SF, "benchmark").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if b["text"] in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op2_benchmark_decontamination(spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2


def test_reordered_and_edited_benchmark_passages_are_found(spark):
    """Every item with its sentences or halves in another order, or with single words replaced, set into a document."""
    rng = random.Random(11)
    docs = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect() if r["text"] and len(r["text"].split()) > 40]
    items = [(r["item_id"], r["text"].split()) for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) >= 20]
    rows, want = [], set()
    for k, (item, words) in enumerate(items):
        third = len(words) // 3
        moved = words[2 * third :] + ["and", "then"] + words[:third] + ["or", "else"] + words[third : 2 * third]
        edited = [f"edit{k}x{j}" if j % 12 == 11 else w for j, w in enumerate(words)]
        for way, passage in enumerate((moved, edited)):
            around = docs[(2 * k + way) % len(docs)].split()
            at = rng.randrange(len(around))
            rows.append((10_000 + 2 * k + way, " ".join([*around[:at], *passage, *around[at:]])))
            want.add((rows[-1][0], item))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(made, table(spark, SF, "benchmark")).collect()}
    found = len(want & got) / len(want)
    print(f"recall of reordered and edited passages: {found:.3f} of {len(want)}")
    assert found >= 0.98


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        seen.append(docs)
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[3] == ids[4]
    scored = {r["doc_id"] for r in registry.op6_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert ids[0] == scored
    assert seen[1].where(F.length("text") != F.col("n_chars")).count() == 0
    parts = ngram_components(seen[1]).collect()
    assert ids[2] == {r["component_id"] for r in parts} and len(ids[2]) < len(ids[1])
    leaking = {r["text"] for r in table(spark, SF, "benchmark").collect()}
    assert not any(t in r["text"] for r in seen[3].collect() for t in leaking)
    whole = Counter((r["doc_id"], r["text"], r["mix_slot"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == Counter((r["doc_id"], r["text"], r["mix_slot"]) for r in seen[4].collect())


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = table(spark, SF, name)
        (df.limit(0) if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (n == 0) == (empty == "documents")
