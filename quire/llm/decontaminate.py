"""Benchmark decontamination by greedy string tiling.

Runs of `seed` words of the benchmark are looked up among each document's runs; a document and a test item that share one are a
candidate pair. For such a pair the longest common run of unmarked words is sought by Karp-Rabin hashes, marked on both
sides, and so on down to `seed` words. Tiles may lie in any order, so a passage whose sentences were moved is covered
like one in place. The pair counts if the tiles cover at least `coverage` of the item's words.

Words are runs of letters and digits after lower-casing. The benchmark goes to the workers in blocks of at most BLOCK_BYTES of
text, one pass over the documents for each block, so a large one costs passes, not memory; where documents are filtered, what one of several blocks leaves is saved
before the next one. A pair's tiles take memory in proportion to its two texts, also if one word is repeated throughout.

Null or empty documents match nothing. Very long texts are compared whole. Equal documents match alike. Items without words match nothing; an item shorter than a seed is
matched as a whole. Items with equal texts are separate items. Without documents or items there are no rows. Rows without an id take part and keep their null. Further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import filter_arrow, map_arrow, saved
from quire.llm.wordhash import LETTER_OR_DIGIT, RunHashes, WordHasher, grams
from quire.shipping import ship

SEED, COVERAGE = 5, 0.6
BLOCK_BYTES = 32 << 20


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in doc, place in item, length), longest first.

    Among common runs of one length the first in doc, then the first in item, are marked first.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    of_doc, of_item = RunHashes(doc), RunHashes(item)
    out = []

    def unmarked(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of doc and of item: places where unmarked runs of this length begin, and the runs' hashes."""
        out = []
        for hashes, free in ((of_doc, free_doc), (of_item, free_item)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[length:] == taken[:-length]) if length <= len(free) else np.zeros(0, np.int64)
            out += [at, hashes.of(at, length)]
        return tuple(out)

    def common(length: int) -> bool:
        _, a, _, b = unmarked(length)
        return bool(np.isin(a, b).any())

    def mark(length: int) -> bool:
        """Mark common runs of this length, in order; no list of pairs is made. Whether there was any."""
        at, runs, item_at, item_runs = unmarked(length)
        order = np.argsort(item_runs, kind="stable")
        keys, item_at = item_runs[order], item_at[order]
        low, high = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
        before, left = len(out), int(free_item.sum())
        for i in np.flatnonzero(high > low).tolist():
            if left < length:
                break
            p = int(at[i])
            if not free_doc[p] or not free_doc[p + length - 1]:  # what is marked here is at least as long
                continue
            for q in item_at[low[i] : high[i]].tolist():
                if free_item[q] and free_item[q + length - 1] and (doc[p : p + length] == item[q : q + length]).all():
                    free_doc[p : p + length] = free_item[q : q + length] = False
                    out.append((p, q, length))
                    left -= length
                    break
        return len(out) > before

    longest = min(len(doc), len(item))
    while longest >= least and common(least):
        low, high = least, longest  # the longest length that still has a common run
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        longest = low if mark(low) else low - 1  # else only hashes collided
    return out


class Benchmark:
    """A block of test items, with the places of their seeds."""

    def __init__(self, items: pa.Array, texts: pa.Array, seed: int):
        words, at = WordHasher(LETTER_OR_DIGIT, np.arange(256, dtype=np.uint8)).words(pc.utf8_lower(texts))
        self.ids = items.to_pylist()
        self.words = [words[at[k] : at[k + 1]] for k in range(len(self.ids))]
        self.short = {len(x) for x in self.words if 0 < len(x) < seed}
        seeds = [np.unique(grams(own, min(seed, len(own)))) if len(own) else own for own in self.words]
        keys, owner = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.known = np.unique(self.keys)
        self.fine = np.zeros(1 << 20, bool)
        self.fine[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def owners(self, runs: np.ndarray) -> set[int]:
        found = np.unique(runs)
        low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        return {int(k) for a, b in zip(low, high, strict=True) for k in self.owner[a:b]}

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Places in runs that are seeds."""
        k = np.flatnonzero(self.fine[(runs >> np.uint64(44)).astype(np.int64)])
        return k[np.isin(runs[k], self.known)] if len(k) else k


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, seed: int, block_bytes: int) -> Iterator[tuple[Broadcast, pa.DataType]]:
    """The benchmark in parts of at most about block_bytes, each sent to the workers, with the type of the item's id."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    for block in range(blocks):
        part = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)).toArrow()
        if part.num_rows:
            ids = part.column("item").combine_chunks()
            yield spark.sparkContext.broadcast(cloudpickle.dumps(Benchmark(ids, part.column("text").combine_chunks(), seed))), ids.type


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of documents and test items: id, item, coverage (share of the item's words), n_tiles, longest_tile (words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, coverage double, n_tiles long, longest_tile long"
    found = None
    for data, item_type in _blocks(benchmark, item_col, text_col, seed, block_bytes):
        one = map_arrow(rows, _pairs(data, seed, coverage, item_type), schema)
        found = one if found is None else found.union(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that leak a test item, with their columns. Each block of the benchmark is one pass without a shuffle."""
    left = None
    for data, _ in _blocks(benchmark, item_col, text_col, seed, block_bytes):
        # a worker holds one block at a time
        left = filter_arrow(docs if left is None else saved(left), text_col, _clean_ones(data, seed, coverage))
    return docs if left is None else left


def _clean_ones(data: Broadcast, seed: int, coverage: float):
    def keeps():
        find = _finder(data, seed, coverage)

        def said(texts: pa.Array) -> list[bool]:
            leaked = {x[0] for x in find(texts)[1]}
            return [k not in leaked for k in range(len(texts))]

        return said

    return keeps


def _finder(data: Broadcast, seed: int, coverage: float):
    """A function from texts to the block of the benchmark and (row, place of the item, coverage, tiles, longest tile)."""
    bench: Benchmark = cloudpickle.loads(data.value)
    hasher = WordHasher(LETTER_OR_DIGIT, np.arange(256, dtype=np.uint8))

    def find(texts: pa.Array) -> tuple[Benchmark, list[tuple[int, int, float, int, int]]]:
        words, at = hasher.words(pc.utf8_lower(texts))
        candidates: dict[int, set[int]] = {}
        for n in (seed, *sorted(bench.short)):
            runs = grams(words, n)
            hits = bench.hits(runs)
            # only runs within one text count
            row = np.searchsorted(at, hits, "right") - 1
            inside = hits + n <= at[row + 1]
            hits, row = hits[inside], row[inside]
            edges = np.flatnonzero(np.diff(row)) + 1
            for first, own in zip(row[np.concatenate([[0], edges])] if len(row) else (), np.split(hits, edges), strict=False):
                candidates.setdefault(int(first), set()).update(bench.owners(runs[own]))
        out = []
        for row, owners in sorted(candidates.items()):
            doc = words[at[row] : at[row + 1]]
            for k in sorted(owners):
                item = bench.words[k]
                least = min(seed, len(item))
                found = tiles(_near(doc, item, least), item, least)
                covered = sum(x[2] for x in found)
                if covered and covered >= coverage * len(item):
                    out.append((row, k, covered / len(item), len(found), max(x[2] for x in found)))
        return bench, out

    return find


def _pairs(data: Broadcast, seed: int, coverage: float, item_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(data, seed, coverage)
        for batch in batches:
            bench, out = find(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([bench.ids[x[1]] for x in out], item_type), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64())],
                names=["id", "item", "coverage", "n_tiles", "longest_tile"],
            )

    return work


def _near(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """doc without the words that lie in no common run of `least` words: no tile can hold them.

    What is left out between two kept stretches is stood for by one word that no item has.
    """
    hits = np.flatnonzero(np.isin(grams(doc, least), grams(item, least)))
    keep = np.zeros(len(doc) + 1, bool)
    for shift in range(least):
        keep[hits + shift] = True
    keep = keep[:-1]
    gap = ~keep
    gap[1:] &= keep[:-1]
    out = np.where(keep, doc, np.uint64(0))
    return out[keep | gap]


ship(__name__)
