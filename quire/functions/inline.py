"""Inline content (quire.schemas.INLINE) on columns: runs of text made from lines, joined, and cut by references. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACES, WS
from quire.schemas import INLINE

#: A word that a hyphen breaks, and what may follow it.
BROKEN, GOES_ON = r"\p{L}-$", r"^\p{Ll}"


def empty(kind: str = INLINE) -> Column:
    return F.array().cast(f"array<{kind}>")


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inline(t: str, text: Column | None = None, like: Column | None = None, note: Column | None = None, page: Column | None = None) -> Column:
    """One piece of inline content; `like` is a span or run whose style it takes."""
    look = [(F.coalesce(like[c], F.lit(False)) if like is not None else F.lit(False)).alias(c) for c in ("i", "b", "sup")]
    null = F.lit(None)
    return F.struct(
        F.lit(t).alias("t"), (null.cast("string") if text is None else text).alias("text"), *look,
        (null.cast("string") if note is None else note).alias("note"), (null.cast("int") if page is None else page.cast("int")).alias("page"),
    )


def _same_look(a: Column, b: Column) -> Column:
    return (a["i"] == b["i"]) & (a["b"] == b["b"]) & (a["sup"] == b["sup"])


def merged_runs(runs: Column) -> Column:
    """Neighbouring runs of one style as one run; runs of text only."""

    def merged(runs: Column) -> Column:
        n = F.size(runs)

        def parted(starts: Column) -> Column:
            def one(start: Column, place: Column) -> Column:
                end = F.coalesce(F.get(starts, place + 1), n)
                whole = F.array_join(F.transform(F.slice(runs, start + 1, end - start), lambda r: r["text"]), "")
                return inline("text", whole, F.get(runs, start))

            return F.transform(starts, one)

        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | ~_same_look(F.get(runs, k), F.get(runs, k - 1)))
        return F.when(n <= 1, runs).otherwise(bound(starts, parted))

    return bound(runs, merged)


def line_runs(spans: Column) -> Column:
    """A line's spans as runs, without white space at either end and without empty runs; `head` is the first span's text."""
    n = F.size(spans)

    def stripped(s: Column, k: Column) -> Column:
        text = F.coalesce(s["text"], F.lit(""))
        text = F.when(k == 0, F.ltrim(text, F.lit(SPACES))).otherwise(text)
        return inline("text", F.when(k == n - 1, F.rtrim(text, F.lit(SPACES))).otherwise(text), s)

    def told(bare: Column) -> Column:
        return F.struct(F.coalesce(F.get(bare, F.lit(0))["text"], F.lit("")).alias("head"), merged_runs(F.filter(bare, lambda r: r["text"] != "")).alias("runs"))

    return bound(F.transform(spans, stripped), told)


def joined_lines(lines: Column) -> Column:
    """Content of lines in order (each as line_runs() gives it, none blank): a word that a hyphen breaks is made whole, else one space stands between lines."""

    def joined(lines: Column) -> Column:
        def one(line: Column, k: Column) -> Column:
            runs, n = line["runs"], F.size(line["runs"])
            last, following = F.get(runs, n - 1), F.get(lines, k + 1)["head"]
            text = last["text"]
            ended = (
                F.when(following.isNull() | text.rlike(f"{WS}$"), text)
                .when(text.rlike(BROKEN) & following.rlike(GOES_ON), F.substring(text, F.lit(1), F.length(text) - 1))
                .otherwise(F.concat(text, F.lit(" ")))
            )
            return F.concat(F.slice(runs, F.lit(1), n - 1), F.array(inline("text", ended, last)))

        return merged_runs(F.flatten(F.transform(lines, one)))

    return bound(lines, joined)


def joined_pages(pieces: Column) -> Column:
    """Content of a paragraph's pieces (page, content) on several pages, with a page break before each but the first.

    A word that the page end breaks is made whole before the break.
    """

    def step(done: Column, piece: Column) -> Column:
        rest = piece["content"]
        last, head = F.get(done, F.size(done) - 1), F.get(rest, F.lit(0))
        after_text, before_text = (F.coalesce(x["t"] == "text", F.lit(False)) for x in (last, head))
        ends = F.struct(F.rtrim(last["text"], F.lit(SPACES)).alias("bare"), F.ltrim(head["text"], F.lit(SPACES)).alias("begun"))

        def whole(x: Column) -> Column:
            word = F.when(after_text & before_text & x["bare"].rlike(BROKEN) & x["begun"].rlike(GOES_ON), F.regexp_extract(x["begun"], f"^(?:(?!{WS}).)+", 0))
            ending = F.coalesce(F.concat(F.substring(x["bare"], F.lit(1), F.length(x["bare"]) - 1), word), F.concat(x["bare"], F.lit(" ")))
            opening = F.coalesce(F.substring(x["begun"], F.length(word) + 1, F.length(x["begun"])), x["begun"])
            before = F.when(after_text, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(inline("text", ending, last)))).otherwise(done)
            after = F.when(before_text, F.concat(F.array(inline("text", opening, head)), F.slice(rest, F.lit(2), F.size(rest)))).otherwise(rest)
            return F.concat(before, F.array(inline("pb", page=piece["page"])), after)

        return bound(ends, whole)

    first = F.get(pieces, F.lit(0))["content"]
    return F.when(F.size(pieces) == 1, first).otherwise(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, step))


def places(text: Column, pattern: str) -> Column:
    """Where a pattern matches a text: begin, end (from 0, exclusive) and what it matched."""
    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("marks"))

    def told(x: Column) -> Column:
        total = lambda of, n: F.aggregate(F.slice(of, F.lit(1), n), F.lit(0), lambda a, y: a + F.length(y))

        def one(mark: Column, k: Column) -> Column:
            begin = total(x["parts"], k + 1) + total(x["marks"], k)
            return F.struct(begin.alias("begin"), (begin + F.length(mark)).alias("end"), mark.alias("mark"))

        return F.transform(x["marks"], one)

    return bound(both, told)


def with_references(run: Column, taken: Column) -> Column:
    """A run of text with references in place of parts of it (begin, end, note; in order), empty parts left out."""

    def one(place: Column, k: Column) -> Column:
        after = F.when(k == 0, 0).otherwise(F.get(taken, k - 1)["end"])
        between = inline("text", F.substring(run["text"], after + 1, place["begin"] - after), run)
        return F.array(between, inline("noteref", note=place["note"]))

    end = F.get(taken, F.size(taken) - 1)["end"]
    tail = inline("text", F.substring(run["text"], end + 1, F.length(run["text"])), run)
    return F.filter(F.concat(F.flatten(F.transform(taken, one)), F.array(tail)), lambda c: (c["t"] != "text") | (c["text"] != ""))
