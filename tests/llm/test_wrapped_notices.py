import random

from quire.llm import license_scan

BSD = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that\n */"
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as published"
APART = "Redistribution and use in source and binary forms, with or without\n" + "other words " * 20 + "\nmodification are permitted"


def test_notices_that_wrap_over_lines(documents):
    found = license_scan.scan_licenses(documents((1, BSD), (2, GPL), (3, APART), (4, None), (5, "all rights\n\nreserved")))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.digest(found).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("gpl", 1.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("all-rights-reserved", 1.0)}
    assert license_scan.scan_licenses(documents((1, BSD))).first()["blocks"] == []


def test_runs_equal_brute_force(documents):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abcdefghxy") + rng.choice("  \n") for _ in range(rng.randint(0, 30)))) for k in range(150)]
    templates = {"p": ["a b c d e"], "q": ["c d e f g h c"], "r": ["h"]}
    got = {r["doc_id"]: {x["label"]: x["share"] for x in r["runs"]} for r in license_scan.scan_licenses(documents(*rows), templates, 0.7).collect()}
    for k, text in rows:
        words, want = text.split(), {}
        for label, (t,) in templates.items():
            own, n = set(t.split()), len(t.split())
            share = max((len(own & set(words[i : i + n])) / len(own) for i in range(len(words))), default=0)
            if share >= 0.7:
                want[label] = share
        assert got[k] == want


def wrapped(text, rng):
    """As comments of source code have it: capitals, marks, and line ends anywhere."""
    out = "/*\n * "
    for word in text.split():
        out += (word.capitalize() if rng.random() < 0.2 else word) + rng.choice((" ", " ", " ", ", ", "\n * ", ". "))
    return out + "\n */"


def test_whole_notices_that_wrap(documents):
    rng = random.Random(3)
    longest = {label: max(texts, key=len) for label, texts in license_scan.TEMPLATES.items()}
    rows = [(k, "int x;\n" + wrapped(text, rng) + "\nint main() {}") for k, text in enumerate(longest.values())]
    cut = [(100 + k, wrapped(" ".join(w for j, w in enumerate(text.split()) if j % 3), rng)) for k, text in enumerate(longest.values()) if len(text.split()) > 100]
    found = {r["doc_id"]: {x["label"]: x["share"] for x in r["runs"]} for r in license_scan.scan_licenses(documents(*rows, *cut)).collect()}
    for k, label in enumerate(longest):
        assert found[k][label] == 1.0
    assert cut and all(label not in found[k] or found[k][label] >= 0.8 for k, _ in cut for label in longest)


def test_no_share_is_lost_to_rounding(documents):
    for n in (149, 158):
        words = [f"w{k}" for k in range(n)]
        needed = license_scan._needed(n, 0.8)
        docs = documents((1, " ".join(words[:needed])), (2, " ".join(words[: needed - 1])))
        got = {r["doc_id"]: [x["label"] for x in r["blocks"]] for r in license_scan.scan_licenses(docs, {"t": [" ".join(words)]}).collect()}
        assert got == {1: ["t"], 2: []}
