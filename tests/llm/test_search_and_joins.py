import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import decontaminate, ngram_join, topk
from quire.llm.components import components
from quire.llm.prefix_trie import PrefixTree, linked
from quire.llm.wordhash import NOT_SPACE, LOWER, WordHasher, grams

import pyarrow as pa

VECTORS = "vec_id long, embedding array<double>, label int"


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def shingles(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


# top k


def brute_top(rows, k):
    out = []
    for q, qv in rows:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_top_k_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(k, (centre + spread * rng.normal(size=8)).tolist(), 0) for k in range(900)] + [(1000 + k, [0.5] * 8, 0) for k in range(30)] + [(2000, [0.0] * 8, 0)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, k=10, scale=64.0)
    whole = [(i, np.floor(np.array(v) * 64).astype(int).tolist()) for i, v, _ in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(whole, 10)


def test_top_k_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [2.0], 1), (6, [], 1), (None, [9.0, 9.0], 1), (7, [1e300, 0.0], 1), (8, [-1e300, 0.0], 1), (9, [2.0, 5.0], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("query_id", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, scale=1.0).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 2**63 - 1), (0, 2, 5, 2), (0, 3, 9, 2), (0, 4, 6, 0), (0, 5, 8, -(2**63))]


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 0)], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


# n-gram join


def test_word_hashes_follow_words():
    texts = ["Ab cd\tab", None, "", "  x  ", "ab CD ab x", "é É " + "w" * 50]
    for piece in (8, 1 << 10):
        hashes, at = WordHasher(NOT_SPACE, LOWER, piece).words(pa.array(texts))
        seen = {}
        for k, text in enumerate(texts):
            own = words_of(text)
            assert at[k + 1] - at[k] == len(own)
            for w, h in zip(own, hashes[at[k] : at[k + 1]].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    sliced = pa.array(texts).slice(3, 2)
    assert WordHasher().words(sliced)[0].tolist() == WordHasher().words(pa.array(texts[3:5]))[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=14, unique=True))
def test_prefix_tree_finds_all_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def joined(pairs):
        for k in range(len(sets)):
            parent[k] = k
        for a, b in pairs:
            parent[root(a)] = root(b)
        return {frozenset(k for k in range(len(sets)) if root(k) == root(j)) for j in range(len(sets))}

    for num, den in ((4, 5), (1, 2)):
        links = [(a, b) for a in range(len(sets)) for b in range(a) if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        found = linked(arrays, num, den)
        assert all(den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) for a, b in found)
        assert joined(found) == joined(links) and len(found) == len(sets) - len(joined(links))


def test_search_prunes_but_misses_nothing():
    rng = random.Random(5)
    base = [frozenset(rng.sample(range(200), 40)) for _ in range(20)]
    sets = list({frozenset(x ^ frozenset(rng.sample(range(200), rng.randint(0, 5)))) for x in base for _ in range(6)})
    tree = PrefixTree([np.array(sorted(s), np.int32) for s in sets])
    for k, s in enumerate(sets):
        want = sorted(j for j, o in enumerate(sets) if 5 * len(s & o) >= 4 * len(s | o))
        assert sorted(tree.search(k, 4, 5)) == want


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(vocabulary, k=12))
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(1, 12))
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 4, 5, 6, 9, 40, 90, 150))))
        rows.append((k, text + (" " + common if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(documents, seed, monkeypatch):
    if seed == 2:  # blocks cut into chunks
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    rows = corpus(seed)
    got = ngram_join.ngram_components(documents(*rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_components_of_odd_rows(documents, odd):
    got = ngram_join.ngram_components(odd.withColumn("size", F.lit("clash")).withColumn("node", F.lit(1))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and by[7] == [(1, 7)]
    assert by[5] == [(977, 5)] * 2 and by[None] == [(2, None)]
    twice = documents((1, "a b c d e f g"), (1, "quite another text that shares nothing"), (2, "a b c d e f g"))
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(twice).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_components_of_an_empty_table(documents):
    assert ngram_join.ngram_components(documents()).count() == 0


def test_one_of_each_component_stays(documents):
    rows = corpus(4)
    want = {root for _, root in brute_components(rows).values()}
    kept = ngram_join.representatives(documents(*rows, rows[0], (None, "no id")))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*want, None])


def test_large_group_of_near_copies_is_linear(documents):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        words = base.copy()
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    assert {r["component_id"] for r in ngram_join.ngram_components(documents(*rows)).collect()} == {0}
    calls = 0
    sets = [np.unique(grams(WordHasher().words(pa.array([t]))[0], 5)) for _, t in rows]
    search = PrefixTree.search

    def counted(self, *args):
        nonlocal calls
        calls += 1
        return search(self, *args)

    PrefixTree.search = counted
    try:
        assert len(linked(sets)) == 399
    finally:
        PrefixTree.search = search
    assert calls <= 3


def test_component_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(5, 5), (100, 101), (101, 100), (-3, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[100] == got[101] == got[-3] == -3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


ITEM = "the quick brown fox jumps over the lazy dog while seven small cats watch from a warm red roof in the evening sun today"


def test_tiles_are_greedy_and_disjoint():
    code = lambda text: np.array([hash(w) & (2**63 - 1) for w in text.split()], np.uint64)
    found = decontaminate.tiles(code("a b c d e f x g h i j k y a b c d e f"), code("g h i j k a b c d e f"), 3)
    assert found == [(0, 5, 6), (7, 0, 5)]
    assert decontaminate.tiles(code("a a a a a a"), code("a a a"), 2) == [(0, 0, 3)]
    assert decontaminate.tiles(code("a b"), code("c d"), 1) == []


def test_long_texts_are_tiled_in_seconds():
    words = np.random.default_rng(4).integers(0, 1 << 62, 200_000).astype(np.uint64)
    begun = time.process_time()
    assert decontaminate.tiles(words, words, 5) == [(0, 0, 200_000)]
    swapped = np.concatenate([words[120_000:], words[:120_000]])
    assert decontaminate.tiles(words, swapped, 5) == [(0, 80_000, 120_000), (120_000, 0, 80_000)]
    assert time.process_time() - begun < 30


def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of places."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and free_doc[p + n] and free_item[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n > best[2]:
                    best = (p, q, n)
        if best[2] < least:
            return out
        out.append(best)
        for k in range(best[2]):
            free_doc[best[0] + k] = free_item[best[1] + k] = False


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=14), st.integers(1, 4))
def test_tiles_equal_brute_force(doc, item, least):
    code = lambda x: np.array([k * 7919 + 11 for k in x], np.uint64)
    assert decontaminate.tiles(code(doc), code(item), least) == brute_tiles(doc, item, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), min_size=1, max_size=14), st.integers(1, 4))
def test_words_that_no_tile_can_hold_are_left_out(doc, item, least):
    code = lambda x: np.array([k * 7919 + 11 for k in x], np.uint64)
    short = decontaminate._near(code(doc), code(item), least)
    assert [x[1:] for x in decontaminate.tiles(short, code(item), least)] == [x[1:] for x in brute_tiles(doc, item, least)]


def test_leaks(spark, documents):
    w = ITEM.split()
    moved = " ".join(w[12:] + ["interlude", "of", "words"] + w[:12])
    half = " ".join(w[:10]) + " other words follow here"
    docs = documents((1, "Before. " + ITEM.upper().replace(" ", ", ") + " after"), (2, "pre " + moved + " post"), (3, half), (4, "nothing alike at all in this one"), (5, None), (6, ""), (7, "big apple"), (None, ITEM), (8, ITEM), (8, ITEM))
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "big apple"), (14, ITEM)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["coverage"], 2), r["n_tiles"]) for r in decontaminate.leaks(docs.withColumn("item", F.lit(0)), bench).collect())
    one = lambda d, n: [(d, 10, 1.0, n), (d, 14, 1.0, n)]
    assert got == sorted(one("1", 1) + one("2", 2) + [("7", 13, 1.0, 1)] + one("8", 1) * 2 + one("None", 1))
    kept = decontaminate.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    in_blocks = decontaminate.leaks(docs, bench, block_bytes=200)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in in_blocks.collect()) == [x[:2] for x in got]


def test_leaks_of_empty_tables(spark, documents, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.leaks(odd, none).count() == 0 and decontaminate.leaks(documents(), some).count() == 0
    assert decontaminate.clean(odd, none).count() == odd.count() and decontaminate.leaks(odd, some).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """A chain of 300 over 64 partitions: each round's tables have as many parts as the edges need, not as the session has."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.range(300).repartition(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        stars = found.where("node <> root")
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(301)}
        assert stars.where("root = 0").select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
