import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle
from quire.llm.common import bucket_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at=None, own=None):
    """The root of a list of nodes, the siblings of the node `at`, and the root with that node's hash replaced."""
    siblings = []
    while len(nodes) > 1:
        if at is not None:
            start = at // 16 * 16
            run = nodes[start : start + 16]
            siblings += [x for k, x in enumerate(run) if k != at - start]
            own = h(*(own if k == at - start else x for k, x in enumerate(run)))
            at //= 16
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], siblings, own


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    sources = {}
    for doc_id, text, lang, source, n in rows:
        now = leaf(doc_id, source, lang, n, lowered(text)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else None
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), now))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rows_of in sources.values():
        rows_of.sort(key=lambda r: r[:3])
    tops = [climb([r[2] for r in sources[s]])[0] for s in order]
    root = climb(tops)[0]
    out = []
    for place, s in enumerate(order):
        leaves = [r[2] for r in sources[s]]
        for at, (known, doc_id, own, now) in enumerate(sources[s]):
            top, low, fold = climb(leaves, at, now or own)
            _, high, fold = climb(tops, place, fold)
            out.append((doc_id if known else None, own, top, root, h(*low, *high), fold, fold == root))
    return sorted(out, key=str)


def found(df):
    got = merkle.manifest(df, bucket_of("doc_id", 5, 0), merkle.lower_ascii(F.col("text")))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(n, sources, seed=0):
    rng = random.Random(seed)
    return [(rng.randrange(-(1 << 62), 1 << 62) if k % 9 == 0 else k * 37, f"Text {k} É", "en", rng.choice(sources), k) for k in range(n)]


def test_equals_brute_force(spark):
    rows = rows_of(900, ["a", "a", "a", "b", "é", "Z", "src1", "src10", ""]) + [(5_000_000, "lone", None, "one", 4)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, DOCS)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_many_sources(spark):
    rows = rows_of(700, [f"source number {k:03d}" for k in range(300)], 2)
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CELL_MOST", 3)
    monkeypatch.setattr(merkle, "COPIES", 4)
    rows = rows_of(60, ["s", None])
    rows += [(None, f"no id {k}", "en", "s", None) for k in range(40)] + [(None, None, None, None, None)] * 3  # many texts without an id
    rows += [(7, f"one id, text {k}", "en", "s", 3) for k in range(25)] + [(8, "Same", "en", "s", 4)] * 30  # one id, and repeated rows
    rows += [(9, "", "en", "s", 0), (10, "Long " * 100_000, "en", "s", 500_000), (-1, "under zero", "en", "s", 1), ((1 << 63) - 1, "x", "en", "s", 1), (-(1 << 63), "y", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("rank", "hash", "own", "run", "path", "n", "leaf", "root")})
    assert found(df) == brute(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_one_source(spark, n):
    rows = [(k, f"T{k}", "en", "s", k) for k in range(n)]
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
