import random
from collections import defaultdict

import pytest

from quire.llm import line_dedup


def brute_deleted(rows, words=50):
    """Lines of each document that lie in a run of at least so many words that stands at an earlier place which it doesn't overlap."""
    docs = [(k, [(p, line, len(line.split())) for p, line in enumerate(t.split("\n")) if line.split()]) for k, t in rows]
    before, out = defaultdict(list), defaultdict(set)
    for k, lines in docs:
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(x[2] for x in lines[i:j]) >= words:
                    key = tuple(x[1] for x in lines[i:j])
                    if any(k0 != k or i0 + j - i <= i for k0, i0 in before[key]):
                        out[k].update(range(lines[i][0], lines[j - 1][0] + 1))
                    before[key].append((k, i))
    return out


def test_ends_of_runs_whose_start_stands_earlier_elsewhere(documents):
    a, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 60), ("c", 30)))
    docs = documents((1, a + "\none"), (2, f"{a}\n{c}\ntwo"), (3, f"{a}\n{c}\nthree"))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: a + "\none", 2: c + "\ntwo", 3: "three"}


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_equals_brute_force(documents, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice((1, 2, 8, 20, 30, 55)))) for _ in range(25)]
    rows = []
    for k in range(40):
        lines = [rng.choice(["", *pool]) for _ in range(rng.randint(1, 8))]
        if rows and rng.random() < 0.6:
            other = rng.choice(rows)[1].split("\n")
            lines[rng.randint(0, len(lines)) : 0] = other[rng.randint(0, 2) :]
        rows.append((k, "\n".join(lines)))
    want = brute_deleted(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(*rows)).collect()}
    assert got == {k: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[k]) for k, t in rows}


def brute_marks(text, words, hashes):
    """Lines (from 1) that have the smallest hash, the last of equal ones, of a run that holds so many words but not without one of its ends."""
    lines = [(hashes[x], len(x.split())) for x in text.split("\n") if x.split()]
    out = set()
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            held = sum(x[1] for x in lines[i : j + 1])
            if held >= words > min(held - lines[i][1], held - lines[j][1]):
                out.add(min((lines[m][0], -m) for m in range(i, j + 1))[1] * -1 + 1)
    return out


def test_only_minima_of_windows_are_joined(documents, spark):
    rng = random.Random(9)
    rows = [(k, "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((0, 3, 7, 12)))) for _ in range(60))) for k in range(20)]
    lines = sorted({x for _, t in rows for x in t.split("\n")})
    hashes = {r["line"]: r["h"] for r in spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "xxhash64(line) AS h").collect()}
    got = defaultdict(set)
    marks = line_dedup.fingerprints(documents(*rows), words=50)
    for r in marks.collect():
        got[r["id"]].add(r["at"])
        assert len(r["before"]) <= 50 and len(r["after"]) <= 50
    assert got == {k: brute_marks(t, 50, hashes) for k, t in rows}
    assert sum(map(len, got.values())) < sum(len([x for x in t.split("\n") if x]) for _, t in rows) / 2
