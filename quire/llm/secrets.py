"""Secret scans: fixed patterns, and guess costs of the values that stand where credentials do.

A value's guess cost is the smallest total over all ways to cut it into dictionary words, dates, repeats, keyboard
walks and brute-force spans, by dynamic programming over its characters, as log10 of the guesses:
- word: its rank in the dictionary, doubled if characters stand for letters; a little more if its case isn't lower;
- date: day, month and year, or year, month and day, with one sign or none between; days and months of one digit (with a sign between) or two, months by
  name, years of two or four digits; or a year of this or the last century;
- repeat: a unit, of any length, three times or more: the unit by brute force, times the repeats;
- walk: three neighbours or more on a keyboard row, either way;
- brute force: each character by its class.
Every span of every kind, wherever it starts and ends, is a candidate. Walks and repeats are kept as the stretches in which all their spans lie. Within
one, a start that is once as cheap as a later one stays so, since costs grow with the logarithm of the length: so the cheapest start is the top of a
stack, and a value of n characters takes about n log n steps. Values above a threshold are reported as spans of kind `cred`, besides the pattern's own spans.

The dictionary is the fixed list of words that guessers try first, and then the pieces of a vocabulary file that follow a space, in its order. That order
is the merges' and follows the frequency of words only by and large, and some pieces (`th`, `wh`) begin words but are none. It goes to the workers once;
its size is the file's. Words of one letter are left to brute force, which costs less than any rank of theirs.

Null texts count as empty: no spans. Texts are scanned whole, and so are values, however long. Of two ways to cut a value at equal cost either gives the same
result. Repeated rows stay repeated rows; rows without an id keep their null. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow
from quire.shipping import ship

#: Kinds in the order of their listing, patterns, least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "cred")

#: Credential contexts beyond the assign pattern's own. The value goes up to the matching quote in its line; else it is any run without space or quote.
KEY = r"(?:pass(?:word|wd|phrase)|pwd|secret|token|credentials?|(?:api|auth|private|access|secret|encryption|master|signing)[_-]?key)(?:[_-]?(?:access|secret|key|token|value)){0,3}"
CONTEXT = KEY + r"""["']?\x20*[:=]\x20*(?:"((?:[^"\\\r\n]|\\.)+)"|'((?:[^'\\\r\n]|\\.)+)'|["']?([^\s"'<>,;]+))"""
#: log10 of the guesses from which a value is taken for a real secret.
STRONG = 8.0

#: Words that guessers try first, most frequent first.
WORDS = (
    "password pass admin root user login welcome secret letmein qwerty monkey dragon master shadow sunshine princess football "
    "baseball superman batman trustno hello freedom whatever computer internet service access test testing guest default changeme "
    "example sample dummy your here token key value null none true false string love iloveyou money summer winter spring autumn "
    "monday friday january june july august october december company office server data base database system public private my the"
).split()
#: Rows of a keyboard.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
#: Letters that other characters stand for.
LEET = str.maketrans("4@310$57", "aaeiosst")

_STEPS = {x for row in KEYBOARD for line in (row, row[::-1]) for x in zip(line, line[1:], strict=False)}

def _dates() -> tuple[list[re.Pattern], re.Pattern]:
    """Patterns of dates, each of which can match in one way at most from a place on, and that of a year."""
    names = "january february march april may june july august september october november december".split()
    name = "(?:" + "|".join([*names, *(x[:3] for x in names), "sept"]) + ")"
    day, month, sign = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"([-/._\x20])"
    any_day, any_month = rf"(?:[1-9]|{day})", rf"(?:[1-9]|{month})"
    out = []
    for year in (r"(?:19|20)\d\d", r"\d\d"):
        out += [day + month + year, month + day + year, year + month + day]
        out += [rf"{any_day}{sign}{any_month}\2{year}", rf"{any_month}{sign}{any_day}\2{year}", rf"{any_day}{sign}?{name}(?(2)\2){year}"]
        for some in ("[1-9]", day):  # ends of their own
            out += [rf"{year}{sign}{any_month}\2{some}", rf"{year}{sign}?{name}(?(2)\2){some}", rf"{name}{sign}?{some}(?(2)\2){year}"]
    return [re.compile(f"(?=({x}))", re.A) for x in out], re.compile(r"(?=((?:19|20)\d\d))", re.A)


_DATES, _YEAR = _dates()
_SEGMENT = math.log10(2)
_A_DATE, _A_YEAR = math.log10(365 * 120), math.log10(120)
#: Least repeats of a unit, and steps of a walk.
REPEATS, WALK = 3, 3
#: Least letters of a word: one costs less by brute force.
WORD_LEAST = 2


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def vocabulary(path: str) -> list[str]:
    """The pieces of a tokenizer's vocabulary file (.json) that follow a space, lower-cased, in its order: words, most frequent first by and large, and some beginnings of words."""
    known = json.loads(Path(path).read_text())["model"]["vocab"]
    words = (k[1:].lower() for k in sorted(known, key=known.get) if k[:1] == "\u0120")
    return [w for w in words if len(w) >= WORD_LEAST and w.isascii() and w.isalpha()]


class Cheapest:
    """The least of cost + log10(x - i) over starts (i, cost), added in order of i, for x that only grows.

    Of two starts the older grows more slowly, so once it is as cheap as the later it stays so. The stack holds, from the top, the cheapest
    start and those that will replace it, each with the x from which the one beneath is as cheap.
    """

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []

    def add(self, i: int, cost: float, x: int) -> None:
        self._expire(x)
        while self.stack:
            older, its, until = self.stack[-1]
            ahead = (cost - its) * math.log(10)
            from_then = math.inf if ahead <= 0 else i + (i - older) / math.expm1(min(ahead, 700))
            if from_then <= x:
                return
            if from_then < until:
                self.stack.append((i, cost, from_then))
                return
            self.stack.pop()
        self.stack.append((i, cost, math.inf))

    def at(self, x: int) -> float:
        self._expire(x)
        i, cost, _ = self.stack[-1]
        return cost + math.log10(x - i)

    def _expire(self, x: int) -> None:
        while self.stack[-1:] and self.stack[-1][2] <= x:
            self.stack.pop()


class Guesser:
    """Guess costs with the fixed words and those of a dictionary, most frequent first."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.rank: dict[str, int] = {}
        for w in (*WORDS, *words):
            self.rank.setdefault(w, len(self.rank) + 1)
        # what words end in, with letters for what stands for them: a search from an end goes on while it is in one of these
        self.whole = {w.translate(LEET) for w in self.rank}
        self.ends = {w[k:] for w in self.whole for k in range(len(w))}

    def word_cost(self, word: str, low: str, plain: str) -> float | None:
        """The cost of a word as it stands, lower-cased, and with letters for what stands for them; None if it is none."""
        rank = min(self.rank.get(low, math.inf), 2 * self.rank.get(plain, math.inf))
        return math.log10(rank + 1) + (0 if word == low else _SEGMENT) if rank < math.inf else None

    def cost(self, value: str) -> float:
        """log10 of the guesses for value by its cheapest segmentation; 0 for an empty one."""
        n, low = len(value), value.lower()
        if len(low) != n:  # letters whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        sums = [0.0]
        for c in value:
            sums.append(sums[-1] + _char_cost(c))
        walk, dates = walk_starts(low), date_lengths(low)
        begin: dict[int, list[tuple[int, int, int, dict[int, Cheapest]]]] = {}
        for a, b, u in periodic(value):
            begin.setdefault(a + REPEATS * u, []).append((a, b, u, {}))
        repeats: list[tuple[int, int, int, dict[int, Cheapest]]] = []
        walked, from_walk = -1, Cheapest()
        brute = math.inf  # the cheapest that ends within a brute-force span
        onward = [0.0]  # what a further segment costs from a place on
        least = 0.0
        for j in range(1, n + 1):
            brute = least = min(brute, onward[j - 1]) + sums[j] - sums[j - 1]
            i = j - 1
            while i >= 0 and (end := plain[i:j]) in self.ends:
                if end in self.whole and j - i >= WORD_LEAST and (c := self.word_cost(value[i:j], low[i:j], end)) is not None:
                    least = min(least, onward[i] + c)
                i -= 1
            if lengths := dates.get(j):
                least = min(least, min(onward[j - k] + (_A_YEAR if k == 4 else _A_DATE) for k in lengths))
            if walk[j] != walked:
                walked, from_walk = walk[j], Cheapest()
            if j - walked >= WALK:
                from_walk.add(j - WALK, onward[j - WALK], j)
                least = min(least, from_walk.at(j) + math.log10(40) + _SEGMENT)
            repeats += begin.get(j, ())
            ended = False
            for a, b, u, kept in repeats:
                times, phase = divmod(j - a, u)
                by_times = kept.setdefault(phase, Cheapest())
                by_times.add(times - REPEATS, onward[j - REPEATS * u], times)
                least = min(least, by_times.at(times) + sums[j] - sums[j - u])
                ended |= j == b
            if ended:
                repeats = [x for x in repeats if x[1] > j]
            onward.append(least + _SEGMENT)
        return least


def date_lengths(low: str) -> dict[int, set[int]]:
    """For each end of dates and years their lengths: 4 for a year, more for a date."""
    out: dict[int, set[int]] = {}
    for pattern in (*_DATES, _YEAR):
        for m in pattern.finditer(low):
            start, end = m.span(1)
            if end in out:
                out[end].add(end - start)
            else:
                out[end] = {end - start}
    return out


def walk_starts(low: str) -> list[int]:
    """For each end (from 0) the first place from which all characters up to it follow one another on a keyboard."""
    out, start = [0], 0
    for j in range(1, len(low) + 1):
        if j > 1 and (low[j - 2], low[j - 1]) not in _STEPS:
            start = j - 1
        out.append(start)
    return out


def _alike(codes: np.ndarray, at: int, u: int, step: int) -> int:
    """How many characters from at on, in direction step, equal the ones u places on; compared in blocks that double."""
    n, done, size = len(codes) - u, 0, 8
    while True:
        size = min(size, n - at - done if step > 0 else at - done + 1)
        if size <= 0:
            return done
        lo = at + done if step > 0 else at - done - size + 1
        off = codes[lo : lo + size] != codes[lo + u : lo + u + size]
        if off.any():
            return done + int((off if step > 0 else off[::-1]).argmax())
        done += size
        size *= 2


def periodic(value: str) -> Iterator[tuple[int, int, int]]:
    """All longest stretches (start, end, u) of value that repeat a unit of u characters REPEATS times or more.

    In such a stretch each character equals the one u places on, REPEATS - 1 times u in a row; so a whole unit from a multiple of u on does. Only these
    are compared, by running hashes, and followed both ways where those are equal. A unit that itself repeats a shorter one is left out: the shorter one never
    costs more.
    """
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
    hashes = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1], dtype=np.uint64)])
    found: list[tuple[int, int, int]] = []  # those longer than u
    for u in range(1, n // REPEATS + 1):
        found = [x for x in found if x[1] - x[0] > u]
        within = [x for x in found if u % x[2] == 0]
        if any(b - a == n for a, b, _ in within):
            continue
        alike = codes[0 : n - u : u] == codes[u:n:u]
        at = np.flatnonzero(alike[1:] & alike[:-1]) * u
        for a, b, _ in within:
            lo, hi = np.searchsorted(at, (a, b - u))
            at = np.concatenate([at[:lo], at[hi:]])
        if not len(at):
            continue
        at = at[(hashes[at + u] - hashes[at]) * powers[u] == hashes[at + 2 * u] - hashes[at + u]]
        done = -1
        for m in at.tolist():
            if m < done:
                continue
            a = m - _alike(codes, m, u, -1) + 1
            done = m + _alike(codes, m, u, 1)
            if done - a >= (REPEATS - 1) * u:
                found.append((a, done + u, u))
                yield found[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns' matches, in code points."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out)


def cred_spans(text: str, strong: float, cost_of: Callable[[str], float]) -> tuple[list[tuple[int, int, int]], float | None]:
    """Spans of values whose guess cost is at least strong; the highest cost of any value."""
    if "=" not in text and ":" not in text:
        return [], None
    out, most, at = [], None, 0
    while m := _CONTEXT.search(text, at):
        start, end = m.span(m.lastindex)
        # what stands in quotes may itself hold keys, if a quote was left open
        at = end if m.lastindex == 3 else start
        cost = cost_of(text[start:end])
        most = cost if most is None else max(most, cost)
        if cost >= strong:
            out.append((start, 3, end))
    return out, most


_ASSIGN, _CONTEXT = (re.compile(x, re.I | re.A) for x in (ASSIGN, CONTEXT.replace(r"\s", r"\x00-\x20")))
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)


def scan_secrets(docs: DataFrame, dictionary: str | None = None, strong: float = STRONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end>> in order of start, and max_guess_log10.

    dictionary: a vocabulary file, read by the driver.
    """
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(dictionary) if dictionary else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Guesser] = []  # with the first value, since most tasks may have none

        def cost_of(value: str) -> float:
            if not made:
                made.append(Guesser(words.value))
            return made[0].cost(value)

        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found, costs = [], []
            for value in batch.column(1):
                raw = value.as_buffer()
                text = raw.to_pybytes().decode() if raw is not None else ""
                more, most = cred_spans(text, strong, cost_of)
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base_spans(text) + more)])
                costs.append(most)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind)), pa.array(costs, pa.float64())], names=["id", "spans", "max_guess_log10"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind_of_id = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, work, f"id {kind_of_id}, spans array<struct<kind:string,start:long,end:long>>, max_guess_log10 double").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans from scan_secrets()."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        id_col,
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "max_guess_log10",
    )


ship(__name__)
