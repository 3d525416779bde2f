"""From recognized words to lines, and the interface that a recognizer or PDF engine has to fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.stats import upper_middle
from quire.schemas import OCR_WORDS, PDF_ITEMS, struct
from quire.shipping import ship

#: Confidences and sizes.
SURE, SYMBOL_SURE, CHARACTER_SURE = 55, 85, 60
DEFAULT_HEIGHT = 30.0
BOX_PART, BOX_OVERLAP = 0.03, 0.5


def extract(sources: DataFrame, engine: Callable[[], Callable[[dict], Iterator[dict]]], output: str) -> DataFrame:
    """Rows that an engine makes of each source row, and an error column for those it fails on.

    engine() is called once in each worker and gives a function from a source row to rows of `output` (PDF_ITEMS or OCR_WORDS). One bad file
    makes one row with its error, never a failed job. No PDF, image or text recognition engine is part of this library.
    """
    schema = struct(f"{output}, error string")
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = engine()
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    made = [dict.fromkeys(out.names) | x for x in read(row)]
                except Exception as e:  # noqa: BLE001  an engine may raise anything
                    made = [dict.fromkeys(out.names) | {"doc_id": row.get("source_id"), "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(made, out)

    return sources.mapInArrow(work, schema)


def edge_junk(text: Column, confidence: Column) -> Column:
    """Whether a word is a mark of dirt where it stands at a line's edge: blank, a doubtful symbol, a doubtful single character."""
    bare = F.trim(text)
    symbols = ~bare.rlike(r"[\p{L}\p{N}]")
    single = (F.length(bare) == 1) & ~bare.isin("a", "A", "I")
    return F.coalesce((bare == "") | (symbols & ((confidence < SYMBOL_SURE) | (F.length(bare) <= 1))) | (single & (confidence < CHARACTER_SURE)), F.lit(False))


def superscript_tail(symbols: Column) -> Column:
    """How many symbols at a word's end are superscripts; 0 if all are. Only words that end in one are looked through."""
    from_end = F.reverse(F.transform(symbols, lambda s: F.coalesce(s["is_superscript"], F.lit(False))))
    tail = F.greatest(F.array_position(from_end, False).cast("int") - 1, F.lit(0))
    return F.when(F.try_element_at(symbols, F.lit(-1))["is_superscript"], tail).when(symbols.isNotNull(), 0)


def word_spans(words: DataFrame) -> DataFrame:
    """doc_id, page, para, line_no, spans, conf of each line of recognized words, without the marks of dirt at either end; superscript tails are spans of their own.

    What is asked of a word is found on its own row, so that its symbols never leave their task. Words of one number stand by text, confidence and tail.
    """
    told = words.withColumns({"junk": edge_junk(F.col("text"), F.col("confidence")), "tail": F.coalesce(superscript_tail(F.col("symbols")), F.lit(0))})
    rows = F.sort_array(F.collect_list(F.struct("word_no", "text", "confidence", "tail", "junk")))
    lines = told.groupBy("doc_id", "page", "para", "line_no").agg(rows.alias("words"))
    junk = F.col("words.junk")
    first = F.array_position(junk, False).cast("int")
    last = F.size("words") - F.array_position(F.reverse(junk), False).cast("int") + 1
    kept = lines.where(F.array_contains(junk, False)).withColumn("words", F.slice("words", first, last - first + 1))

    def spans(w: Column, k: Column) -> Column:
        span = lambda text, sup: F.struct(text.alias("text"), F.lit(sup).alias("sup"), F.lit(False).alias("i"), F.lit(False).alias("b"))
        lead = lambda text: F.when(k > 0, F.concat(F.lit(" "), text)).otherwise(text)
        whole = F.length(w["text"])
        plain = span(lead(F.substring(w["text"], F.lit(1), whole - w["tail"])), False)
        return F.when(w["tail"] > 0, F.array(plain, span(F.substring(w["text"], whole - w["tail"] + 1, w["tail"]), True))).otherwise(F.array(span(lead(w["text"]), False)))

    mean = F.aggregate("words.confidence", F.lit(0.0), lambda a, c: a + c) / F.size("words")
    return kept.select("doc_id", "page", "para", "line_no", F.flatten(F.transform("words", spans)).alias("spans"), mean.alias("conf"))


def line_heights(lines: DataFrame) -> DataFrame:
    """doc_id, page, height of the lines that the recognizer was sure of."""
    sure = F.collect_list(F.when(F.coalesce(F.col("conf"), F.lit(0.0)) >= SURE, F.col("y1") - F.col("y0")))
    return lines.groupBy("doc_id", "page").agg(upper_middle(sure, DEFAULT_HEIGHT).alias("height"))


__all__ = ["OCR_WORDS", "PDF_ITEMS", "edge_junk", "extract", "line_heights", "superscript_tail", "word_spans"]

ship(__name__)
