import re
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from against_sql import SF

from quire.plans import catalog, registry

BENCHMARK = "item_id long, text string"


@pytest.fixture
def run(spark, tmp_path):
    """The rows of a query over a benchmark of these texts, by item."""

    def rows(name, *texts):
        spark.createDataFrame(list(enumerate(texts)), BENCHMARK).write.parquet(str(tmp_path / "benchmark.parquet"))
        return {r[0]: r[1] for r in registry.queries()[name](spark, str(tmp_path)).collect()}

    return rows


@pytest.fixture
def items(spark):
    if not Path(SF).exists():
        pytest.skip("no tables here")
    return {r["item_id"]: r["text"] for r in catalog.table(spark, SF, "benchmark").collect()}


def norm(text):
    bare = re.sub(r"\b[ivxlcdm]+\b", "", re.sub(r"[0-9]+", "", text.lower()), flags=re.A)
    return " ".join("".join(c if unicodedata.category(c).startswith("L") else " " for c in bare).split())


def similarity(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a.lower(), b.lower()))
    return 1.0 if a.lower() == b.lower() else 2 * (x & y).total() / (x.total() + y.total())


def test_headers_are_normalised_whole(spark, run, items):
    long = "word " * 30
    got = run("header_normalise", "ÉTUDES XII Größe 47", long + "Ende iv 9", "Überblick über Ökonomie", None)
    assert got == {0: "études größe", 1: long + "ende", 2: "überblick über ökonomie", 3: None}
    whole = registry.queries()["header_normalise"](spark, SF).collect()
    assert {r["item_id"]: r["norm"] for r in whole} == {k: norm(t) for k, t in items.items()} and len(whole) == len(items)


def test_similarity_of_whole_texts(spark, run, items):
    head = "a long beginning that both of the texts have in common, "
    got = run("dice_similarity", head + "and then the first", head + "but not this other ending", head + "BUT not this other ending")
    assert got[1] == pytest.approx(similarity(head + "and then the first", head + "but not this other ending")) and got[1] < 1 == got[2]
    whole = {r["item_id"]: r["similarity"] for r in registry.queries()["dice_similarity"](spark, SF).collect()}
    assert whole == pytest.approx({k: similarity(items[k], items[k - 1]) for k in items if k - 1 in items})


def test_file_names_of_whole_texts(run):
    got = run("safe_file_base", "n" * 200, "ab " * 60, "x" * 100 + " é: end")
    assert got == {0: "n" * 120, 1: ("ab " * 40).strip(), 2: "x" * 100 + " e end x"}
