"""Language ID by rank-order profiles.

A profile is a text's n-grams (1 to 3 characters of its lower-cased letters, words set off by one space) by falling frequency, the
first PROFILE of them; ties go to the smaller n-gram. A text is put down to the language whose profile has the smallest
out-of-place distance: the sum, over the text's profile, of how far each n-gram's rank is from its rank there, or PROFILE if it isn't there.

Language profiles count every n-gram of every training text; each task adds up its own counts before they are shuffled by language and n-gram.
Profiles (PROFILE n-grams a language) go to the workers in blocks of BLOCK_LANGUAGES languages, and every text is compared with block after block, so any number of
languages is told apart and neither the driver nor a worker holds more than a block's.

Null texts and texts without a letter get the language `und` and score 0. The score is 1 - best / second distance, with a
single language 1 - best / largest possible distance. Ties between languages go to the first by name. Without any training text all are `und`.
Texts are read whole, very long ones too. Repeated rows stay repeated rows; rows without an id keep their null. An empty table gives an empty one. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow
from quire.shipping import ship

ORDERS = 3
PROFILE = 300
#: Languages whose profiles a worker compares at once: some 10 MB.
BLOCK_LANGUAGES = 4096
UNKNOWN = "und"
_BITS = 21  # of a code point
_SPACE = 32
#: Characters that are worked on at once while counting.
PIECE = 1 << 21


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as single spaces, with one at each end; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = table[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    padded = np.concatenate([[_SPACE], np.where(is_letter, codes, _SPACE), [_SPACE]]).astype(np.int64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    return padded[keep]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """All runs of 1 to ORDERS characters as one number each, without those of spaces alone and those with a space inside."""
    out = [codes[codes != _SPACE]]
    if len(codes) >= 2:
        out.append(codes[:-1] << _BITS | codes[1:])
    if len(codes) >= 3:
        out.append((codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:])[codes[1:-1] != _SPACE])
    return np.concatenate(out)


def profile(grams: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent, most frequent first."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:n]


class Profiles:
    """Languages' profiles as one table: a row of ranks for each n-gram that any of them has."""

    def __init__(self, ranked: dict[str, list[int]], n: int = PROFILE):
        self.names = sorted(ranked)
        self.n = n
        self.grams = np.unique(np.concatenate([np.array(ranked[x], np.int64) for x in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(ranked[name], np.int64)), k] = np.arange(len(ranked[name]))

    def two_nearest(self, own: np.ndarray) -> list[tuple[int, str]]:
        """Distance and name of the nearest language, and of the next one if there are two."""
        at = np.minimum(np.searchsorted(self.grams, own), max(len(self.grams) - 1, 0))
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        places = np.arange(len(own), dtype=np.int32)[:, None]
        distance = np.where(ranks >= 0, np.abs(ranks - places), self.n).sum(axis=0)
        return [(int(distance[k]), self.names[k]) for k in np.argsort(distance, kind="stable")[:2]]


def decided(found: list[tuple[int, str]], most: int) -> tuple[str, float]:
    """The language and its score, from the nearest ones of all blocks and the largest possible distance."""
    (best, name), *others = sorted(found)
    other = others[0][0] if others else most
    return name, 1.0 - best / other if other else 0.0


def train(docs: DataFrame, n: int = PROFILE, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK_LANGUAGES) -> list[Broadcast]:
    """The profile of each non-null language of docs, in blocks of languages: name to n-grams, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            values, counts = totals.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_buffer()
                if raw is None:
                    continue
                grams = ngrams(letters(raw.to_pybytes().decode(), table))
                held.setdefault(lang, []).append(grams)
                sizes[lang] = sizes.get(lang, 0) + len(grams)
                if sizes[lang] > PIECE:
                    _add(totals, lang, held.pop(lang))
                    sizes[lang] = 0
            for lang, parts in held.items():
                _add(totals, lang, parts)
            for lang in [x for x, (values, _) in totals.items() if len(values) > PIECE]:
                yield rows(lang)
        for lang in list(totals):
            yield rows(lang)

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = map_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= n)
    spark, blocks, held = docs.sparkSession, [], {}
    for row in ranked.orderBy("lang", "rank").toLocalIterator():
        if row["lang"] not in held and len(held) == block:
            blocks.append(spark.sparkContext.broadcast(held))
            held = {}
        held.setdefault(row["lang"], []).append(row["gram"])
    return [*blocks, spark.sparkContext.broadcast(held)] if held else blocks


def _add(totals: dict, lang: str, parts: list[np.ndarray]) -> None:
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    if lang in totals:
        before, n = totals[lang]
        values, place = np.unique(np.concatenate([before, values]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n, counts]).astype(np.float64)).astype(np.int64)
    totals[lang] = values, counts.astype(np.int64)


def predict(docs: DataFrame, profiles: list[Broadcast], n: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, the columns of keep, lang_pred, score."""
    keep = keep or {}
    extra = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        only = Profiles(profiles[0].value, n) if len(profiles) == 1 else None
        for batch in batches:
            own: list[np.ndarray | None] = []
            for value in batch.column(batch.num_columns - 1):
                raw = value.as_buffer()
                codes = letters(raw.to_pybytes().decode(), table) if raw is not None else ()
                own.append(profile(ngrams(codes), n) if len(codes) and profiles else None)
            near: list[list[tuple[int, str]]] = [[] for _ in own]
            for block in profiles:
                known = only or Profiles(block.value, n)
                for k, grams in enumerate(own):
                    if grams is not None:
                        near[k] += known.two_nearest(grams)
            found = [decided(x, n * len(grams)) if x else (UNKNOWN, 0.0) for x, grams in zip(near, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", *extra, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, work, f"{kinds}, lang_pred string, score double").withColumnRenamed("id", id_col)


#: The rows of op5. CRC-32 by its bits: a byte is mixed in, then eight shifts; n-grams of fewer characters sort first, as their numbers do.
ORACLE_SQL = rf"""
WITH r AS (SELECT doc_id, lang, lower(text) AS text,
    xor(list_reduce([4294967295] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 3 = 1 AS held_out
  FROM documents),
t AS (SELECT *, CASE WHEN regexp_matches(text, '\p{{L}}') THEN ' ' || trim(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')) || ' ' END AS t FROM r),
g AS (SELECT doc_id, lang, held_out, unnest(
    list_filter([substr(t, i, 1) for i in range(1, length(t) + 1)], lambda x: x <> ' ') || [substr(t, i, 2) for i in range(1, length(t))] || list_filter([substr(t, i, 3) for i in range(1, length(t) - 1)], lambda x: substr(x, 2, 1) <> ' ')) AS g
  FROM t WHERE t IS NOT NULL),
trained AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, length(g), g) - 1 AS place FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < {PROFILE}),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, length(g), g) - 1 AS place FROM g GROUP BY doc_id, g QUALIFY place < {PROFILE}),
k AS (SELECT doc_id, {PROFILE} * count(*) AS most FROM own GROUP BY doc_id),
met AS (SELECT doc_id, lang, sum({PROFILE} - abs(own.place - trained.place)) AS nearer FROM own JOIN trained USING (g) GROUP BY doc_id, lang),
d AS (SELECT k.doc_id, l.lang, most, most - coalesce(nearer, 0) AS distance FROM k CROSS JOIN (SELECT DISTINCT lang FROM trained) l LEFT JOIN met ON met.doc_id = k.doc_id AND met.lang = l.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS rank, coalesce(lead(distance) OVER (PARTITION BY doc_id ORDER BY distance, lang), most) AS next FROM d)
SELECT r.doc_id, r.held_out, coalesce(o.lang, '{UNKNOWN}') AS lang_pred, CASE WHEN o.lang IS NULL OR next = 0 THEN 0.0 ELSE 1.0::DOUBLE - distance::DOUBLE / next::DOUBLE END AS score FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND o.rank = 1
"""

ship(__name__)
