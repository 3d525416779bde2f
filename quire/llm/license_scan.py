"""License scans: exact containment join of text blocks with license templates, in DataFrame operations only.

Template and block are sets of words (runs of letters and digits after lower-casing A-Z). A block meets a template of n words if it holds at
least `containment` of them, that is `needed` words; counts are compared, so nothing is lost to rounding. Blocks are the lines of a text, and, for notices
that wrap over lines, its runs of as many words as the template's text has.

1. One pass over the texts keeps, of each, the places of words that templates or phrases have, and each line's set of them. Everything
   below works on these; no text is read again.
2. Template words are ordered by the number of documents that hold them, the rarest first, counted over the whole corpus.
3. Each line's set and each run around a word is exploded to (block, word, place in its block's own order). The rows of prefix words are joined with the table
   of the templates' prefixes, their n - needed + 1 first words, on the word.
4. Length filter: a block has `needed` words of the vocabulary at least. Positional filter: with the first shared word at place i of the
   template and j of the block's m, at most min(n - i, m - j) words are shared, which must be enough.
5. What is left is verified by intersection. Of the runs that hold a word, the best one counts.

Besides, fixed phrases are looked for anywhere in a text, also across lines.

Null and empty texts have no words. Texts are scanned whole, whatever their length; a very long one is one row. Repeated rows stay repeated rows, rows without an id keep
their null. Words of equal counts are ordered by themselves; of equal shares one stands for all. An empty table gives an empty one. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved

#: Phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

CONTAINMENT = 0.8
#: Notices by which licenses are commonly referred to, and the texts of short ones.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0"],
    "gpl": ["licensed under the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "all-rights-reserved": ["all rights reserved"],
}
#: Full notices, as they stand in files of source code.
TEMPLATES["apache"].append(
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
TEMPLATES["mit"].append(
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
TEMPLATES["isc"] = [
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software"
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but letters and digits, and of these the line feed last.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 10)


def _needed(n: int, containment: float) -> int:
    """Words of a template of n that a block must hold."""
    whole = int(containment * n)
    return whole if whole >= containment * n else whole + 1


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _hit(place: Column, w: Column) -> Column:
    """A word's place in its text and its number in the vocabulary, as one long."""
    return F.shiftleft(place.cast("long"), 16).bitwiseOR(w.cast("long"))


def _place(hit: Column) -> Column:
    return F.shiftright(hit, 16)


def _word(hit: Column) -> Column:
    return hit.bitwiseAND(F.lit(0xFFFF)).cast("int")


def hits(docs: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """docs: id, text. Per row: row (a number), id, n_words, hits (the words of the vocabulary, in order, see _hit) and lines (array of (line, ws): the
    numbers of the vocabulary's words, from 1, of each line that holds `least` of them)."""
    plain = F.translate(F.coalesce("text", F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    number = lambda w: F.array_position(known, w).cast("int")
    split = docs.select(F.monotonically_increasing_id().alias("row"), "id", F.transform(F.split(plain, "\n"), lambda line: F.array_remove(F.split(line, " "), "")).alias("lines"))
    worded = split.select("row", "id", F.flatten("lines").alias("words"), "lines")
    found = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    held = F.filter(F.transform("lines", lambda ws, i: F.struct(i.alias("line"), F.array_intersect(ws, known).alias("ws"))), lambda x: F.size(x["ws"]) >= least)
    return worded.select(
        "row",
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.transform(found, lambda x: _hit(x["place"], number(x["w"]))).alias("hits"),
        F.transform(held, lambda x: F.struct(x["line"].alias("line"), F.transform(x["ws"], number).alias("ws"))).alias("lines"),
    )


def document_counts(found: DataFrame) -> dict[int, int]:
    """Documents that hold each word of the vocabulary. At most as many rows as it has words come to the driver."""
    held = found.select(F.explode(F.array_distinct(F.transform("hits", _word))).alias("w"))
    return {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (array of word places of phrases), blocks (array<struct<line, label, share>>: lines, from 0, that meet a template) and
    runs (array<struct<label, share, place>>: the templates that some run of as many words meets, wherever lines end, with the best run's share and first word)."""
    every = [(label, text.split()) for label, texts in templates.items() for text in texts]
    vocabulary = sorted({w for _, words in every for w in words} | {w for phrase in PHRASES for w in phrase.split()})
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    needed = [_needed(len(set(words)), containment) for _, words in every]
    found = saved(hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, min(needed)))
    counts = document_counts(found)
    rank = {k: place for place, k in enumerate(sorted(number.values(), key=lambda k: (counts.get(k, 0), vocabulary[k - 1])))}
    ordered = [sorted((number[w] for w in set(words)), key=rank.__getitem__) for _, words in every]
    rows = [
        {"w": own[i], "template": t, "label": label, "i": i, "n": len(own), "needed": least, "length": len(words), "own": own}
        for t, ((label, words), own, least) in enumerate(zip(every, ordered, needed, strict=True))
        for i in range(len(own) - least + 1)
    ]
    kinds = "array<struct<w:int,template:int,label:string,i:int,n:int,needed:int,length:int,own:array<int>>>"
    # as many rows as all templates have words at most, whatever the documents
    prefixes = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kinds))))
    first = _numbers(sorted({r["w"] for r in rows}))
    ranks = _numbers([rank[k] for k in sorted(number.values())])
    rank_of = lambda w: F.get(ranks, w - 1)
    met = _met_lines(found, prefixes, first, rank_of).unionByName(_met_runs(found, prefixes, first, rank_of, max((len(w) for _, w in every), default=1)))
    by_row = met.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "label", "share")))).alias("blocks"),
        F.array_sort(F.collect_list(F.when(F.col("line").isNull(), F.struct("label", "share", "place")))).alias("runs"),
    )
    places = F.concat(*(F.transform(_places(F.col("hits"), [number[w] for w in phrase.split()]), _labelled(label)) for phrase, label in PHRASES.items()))
    based = found.select("row", "id", "n_words", places.alias("places"))
    return based.join(by_row, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "places", F.coalesce("blocks", _no("struct<line:int,label:string,share:double>")).alias("blocks"), F.coalesce("runs", _no("struct<label:string,share:double,place:long>")).alias("runs")
    )


def _filtered(blocks: DataFrame, prefixes: DataFrame, rank_of: Callable[[Column], Column]) -> DataFrame:
    """blocks: ws (the vocabulary's words of a block), w (one of them) and what tells them apart. Pairs with templates that have w in their prefix,
    by the length and the positional filter. The latter holds for a pair's first shared word, if it meets; rows of others need not stay."""
    order = F.array_sort(F.transform("ws", rank_of))
    placed = blocks.withColumns({"m": F.size("ws"), "j": F.array_position(order, rank_of(F.col("w"))).cast("int") - 1})
    joined = placed.join(prefixes, "w")
    return joined.where((F.col("m") >= F.col("needed")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("needed")))


def _met_lines(found: DataFrame, prefixes: DataFrame, first: Column, rank_of: Callable[[Column], Column]) -> DataFrame:
    """Lines that meet a template: row, line, label, share, place (null)."""
    blocks = found.select("row", F.inline("lines")).select("row", "line", "ws", F.explode(F.array_intersect("ws", first)).alias("w"))
    shared = F.size(F.array_intersect("own", "ws"))
    pairs = _filtered(blocks, prefixes, rank_of).where(shared >= F.col("needed"))
    checked = pairs.select("row", "line", "template", "label", (shared / F.col("n").cast("double")).alias("share")).distinct()
    return checked.select("row", "line", "label", "share", F.lit(None).cast("long").alias("place"))


def _met_runs(found: DataFrame, prefixes: DataFrame, first: Column, rank_of: Callable[[Column], Column], longest: int) -> DataFrame:
    """Templates that a run meets: row, line (null), label, share, place (of the best run's first word)."""
    heads = F.filter(F.transform("hits", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: F.array_contains(first, _word(h["x"])))

    def near(h: Column) -> Column:
        # as many hits as any run with this word can hold, before and after it
        start = F.greatest(h["i"] - longest + 2, F.lit(1))
        return F.struct(_word(h["x"]).alias("w"), _place(h["x"]).alias("here"), F.slice("hits", start, h["i"] + longest - start + 1).alias("near"))

    around = found.select("row", F.inline(F.transform(heads, near)))
    within = F.filter("near", lambda x: (_place(x) > F.col("here") - longest) & (_place(x) < F.col("here") + longest))
    # the stretch holds every run with this word, so what is bound for it is bound for them
    blocks = around.withColumn("near", within).withColumn("ws", F.array_distinct(F.transform("near", _word)))
    pairs = _filtered(blocks, prefixes, rank_of).where(F.size(F.array_intersect("own", "ws")) >= F.col("needed"))
    mine = F.filter("near", lambda x: F.array_contains("own", _word(x)))
    starts = F.filter("mine", lambda x: (_place(x) <= F.col("here")) & (_place(x) > F.col("here") - F.col("length")))

    def run(x: Column) -> Column:
        held = F.filter("mine", lambda y: (y >= x) & (_place(y) < _place(x) + F.col("length")))
        return F.struct(F.size(F.array_distinct(F.transform(held, _word))).alias("shared"), (-_place(x)).alias("back"))

    best = F.array_max(F.transform(starts, run))
    runs = pairs.withColumn("mine", mine).select("row", "template", "label", "n", "needed", best.alias("best")).where(F.col("best.shared") >= F.col("needed"))
    most = runs.groupBy("row", "template", "label", "n").agg(F.max("best").alias("best"))
    return most.select("row", F.lit(None).cast("int").alias("line"), "label", (F.col("best.shared") / F.col("n").cast("double")).alias("share"), (-F.col("best.back")).alias("place"))


def _labelled(label: str):
    return lambda x: F.struct(x.cast("long").alias("place"), F.lit(label).alias("label"))


def _places(hits: Column, phrase: list[int]) -> Column:
    """Where the words of a phrase stand one after the other."""
    at = F.filter(F.transform(hits, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: _word(h["x"]) == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = F.filter(at, _follows(hits, k, w))
    return F.transform(at, lambda h: _place(h["x"]))


def _follows(hits: Column, k: int, w: int):
    return lambda h: F.get(hits, h["i"] + k) == _hit(_place(h["x"]) + k, F.lit(w))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels from scan_licenses()."""
    labels = F.transform("places", lambda x: x["label"])
    more = F.concat("blocks.label", "runs.label")
    shares = F.concat("blocks.share", "runs.share")
    place = F.transform("places", lambda x: x["place"])
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"),
    )


def oracle_sql(containment: float = CONTAINMENT) -> str:
    """The rows of op9, without any filter before the comparison."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sets = [(label, sorted(set(text.split()))) for label, texts in TEMPLATES.items() for text in texts]
    met = ", ".join(f"('{label}', {words!r}, {_needed(len(words), containment)}, {len(words)})" for label, words in sets)
    phrases = ", ".join(f"({p.split()!r}, {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words FROM d),
phrase(parts, n, label) AS (VALUES {phrases}),
template(label, words, needed, n) AS (VALUES {met}),
held AS (SELECT doc_id, unnest(range(len(words))) AS place, words FROM w WHERE len(list_intersect(words, ['license', 'cc'])) > 0),
base AS (SELECT doc_id, place, label FROM held JOIN phrase ON words[place + 1] = parts[1] AND words[place + 1 : place + n] = parts),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
line AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)),
meets AS (SELECT doc_id, label, len(list_intersect(line.words, template.words)) / n::DOUBLE AS share FROM line JOIN template ON len(list_intersect(line.words, template.words)) >= needed),
every AS (SELECT doc_id, label, share FROM meets UNION ALL SELECT doc_id, label, 1.0 FROM base),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""
