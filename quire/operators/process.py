"""From sources to structured readings: each kind of source has its branch, and what a branch makes is the same four tables.

A file that can't be read makes a row of errors, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_title, title_from_file_name
from quire.operators import blocks as block_ops
from quire.operators import layout
from quire.schemas import BLOCKS, IMAGES, NOTES, PAGES, struct
from quire.shipping import ship
from quire.sources import ocr, pdf_items
from quire.sources.docx import docx_to_html
from quire.sources.html import html_rows

#: Routing of pages, and the least length of an author's name.
SURE_IN_FIGURE, TEXT_LINES_IN_FIGURE = 75.0, 6


@dataclass(frozen=True)
class Structured:
    """pages, blocks, notes and images of readings, and errors (doc_id, error) of those that failed."""

    pages: DataFrame
    blocks: DataFrame
    notes: DataFrame
    images: DataFrame
    errors: DataFrame


def _as_table(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with the columns of a schema; those that are missing are null."""
    schema = struct(ddl)
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def by_kind(sources: DataFrame, kind: str) -> DataFrame:
    return sources.where(F.col("kind") == kind)


def from_html(docs: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> Structured:
    """Readings of one page without a label each."""
    rows = html_rows(docs.withColumn(id_col, F.col(id_col).cast("string")), id_col, html_col)
    pages = docs.where(F.col(html_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit("").alias("label"), F.lit("docx").alias("source"))
    own = lambda part: rows.where(F.col("part") == part)
    made = own("block").withColumnRenamed("no", "block_no")
    notes = own("note").withColumn("note_no", F.col("no") + 1)
    images = own("image").select("id", "data", "mime", F.lit(None).alias("width"), F.lit(None).alias("height")).dropDuplicates(["id"])
    none = docs.sparkSession.createDataFrame([], "doc_id string, error string")
    return Structured(_as_table(pages, PAGES), _as_table(made, BLOCKS), _as_table(notes, NOTES), _as_table(images, IMAGES), none)


def word_html(sources: DataFrame) -> DataFrame:
    """doc_id, html, error of Word files (source_id, content)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(docx_to_html(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a damaged file may raise anything
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "html", "error"])

    return sources.select("source_id", "content").mapInArrow(work, "doc_id string, html string, error string")


def from_word(sources: DataFrame) -> Structured:
    read = word_html(sources)
    made = from_html(read)
    return Structured(made.pages, made.blocks, made.notes, made.images, read.where("error is not null").select("doc_id", "error"))


def from_layouts(lines: DataFrame, layouts: DataFrame, figures: DataFrame, images: DataFrame) -> Structured:
    """Readings from positioned lines, whatever engine they came from."""
    pages, made, notes = block_ops.structure(lines, layouts, figures)
    none = lines.sparkSession.createDataFrame([], "doc_id string, error string")
    return Structured(_as_table(pages, PAGES), _as_table(made, BLOCKS), _as_table(notes, NOTES), images, none)


def routed(layouts: DataFrame, items: DataFrame) -> DataFrame:
    """layouts with source: text where a page's text layer is long enough, else ocr."""
    layer = pdf_items.text_pages(items).select("doc_id", "page", "text_layer")
    return layouts.join(layer, ["doc_id", "page"], "left").withColumn("source", F.when(F.col("text_layer"), "text").otherwise("ocr")).drop("text_layer")


def from_items(items: DataFrame, layouts: DataFrame, figures: DataFrame, images: DataFrame) -> Structured:
    """Readings from a text layer's items; pages that need recognition are left to from_words()."""
    text_pages = routed(layouts, items).where("source = 'text'")
    lines = pdf_items.lines_from_items(items.join(text_pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi"))
    return from_layouts(lines, text_pages, figures, images)


def recognized_lines(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines from recognized words and their boxes (doc_id, page, para, line_no, x0, y0, x1, y1, row_height)."""
    placed = ocr.word_spans(words).join(boxes, ["doc_id", "page", "para", "line_no"])
    size = F.coalesce(F.when(F.col("row_height") > 0, F.col("row_height")), F.col("y1") - F.col("y0"))
    return placed.withColumn("size", size.cast("double")).select("doc_id", "page", "line_no", "spans", "x0", "y0", "x1", "y1", "size", "conf", "para")


def recognized_figures(lines: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines without doubtful text in figures, and figures without those that are full of sure text."""
    kept = layout.outside_figures(lines, boxes, SURE_IN_FIGURE)
    return kept, layout.boxes_without_text(boxes, kept, TEXT_LINES_IN_FIGURE)


def from_words(words: DataFrame, word_boxes: DataFrame, layouts: DataFrame, figure_boxes: DataFrame, images: DataFrame) -> Structured:
    """Readings from recognized words."""
    lines, figures = recognized_figures(recognized_lines(words, word_boxes), figure_boxes)
    return from_layouts(lines, layouts, figures, images)


def photo_pages(photos: DataFrame) -> DataFrame:
    """photos (reading_id, place, part) with their page: places in natural order, two parts for a spread."""
    from pyspark.sql import Window

    return photos.withColumn("page", (F.row_number().over(Window.partitionBy("reading_id").orderBy("place", "part")) - 1).cast("int"))


def all_of(parts: list[Structured]) -> Structured:
    """Several branches' tables together."""

    def union(name: str) -> DataFrame:
        out = getattr(parts[0], name)
        for part in parts[1:]:
            out = out.unionByName(getattr(part, name), allowMissingColumns=True)
        return out

    return Structured(*(union(name) for name in ("pages", "blocks", "notes", "images", "errors")))


def titles(made: Structured, metadata: DataFrame | None = None) -> DataFrame:
    """doc_id, title, author: the file's own if they are sound, else the first heading."""
    headings = block_ops.first_heading(made.blocks)
    if metadata is None:
        return headings.select("doc_id", "title", F.lit(None).cast("string").alias("author"))
    author = F.trim("author")
    own = metadata.select("doc_id", clean_title(F.col("title")).alias("own"), F.when(F.length(author) > 1, author).alias("author"))
    return own.join(headings, "doc_id", "full").select("doc_id", F.coalesce("own", "title").alias("title"), "author")


def results(readings: DataFrame, made: Structured, metadata: DataFrame | None = None) -> DataFrame:
    """What bundle.merged_results() takes, for every queued reading: those without a source failed."""
    counts = made.blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_blocks"))
    known = made.pages.select("doc_id").union(made.errors.select("doc_id")).distinct().withColumn("_known", F.lit(True))
    queued = readings.where(F.col("status").isin("queued", "processing")).select(F.col("id").alias("doc_id"), title_from_file_name(F.col("file_name")).alias("auto_title"))
    joined = queued.join(counts, "doc_id", "left").join(made.errors, "doc_id", "left").join(titles(made, metadata).withColumnRenamed("title", "new_title").withColumnRenamed("author", "new_author"), "doc_id", "left").join(known, "doc_id", "left")
    error: Column = F.coalesce("error", F.when(F.col("_known").isNull(), "The file is no longer there."))
    return joined.select(F.col("doc_id").alias("id"), "new_title", "new_author", "auto_title", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), error.alias("error"))


ship(__name__)
