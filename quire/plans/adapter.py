"""Positioned lines from plain texts: each line of a text is a line of a page of 40, with sizes and places that follow from its number and length.

The same rules as SQL, for checking results against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_LINES, PITCH, TOP, HEIGHT, WIDTH = 40, 14, 100, 792, 612


def text_lines(documents: DataFrame) -> DataFrame:
    """doc_id, idx, page, line_no, text, n and the geometry of quire.schemas.LINES."""
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    n = F.length("text")
    size = F.when(n < 12, 18.0).when(n < 24, 14.0).when(F.col("idx") % 40 >= 37, 8.5).otherwise(11.0)
    placed = rows.withColumns({"page": F.floor(F.col("idx") / PAGE_LINES).cast("int"), "line_no": (F.col("idx") % PAGE_LINES).cast("int"), "n": n, "size": size})
    x0 = F.when(F.col("idx") % 5 == 0, 90.0).otherwise(72.0)
    y0 = (TOP + PITCH * F.col("line_no")).cast("double")
    spans = F.array(F.struct("text", F.lit(False).alias("sup"), F.lit(False).alias("i"), F.lit(False).alias("b")))
    return placed.withColumns(
        {"x0": x0, "y0": y0, "x1": F.when(n >= 80, 540.0).otherwise(x0 + n * 5.5), "y1": y0 + F.col("size"), "conf": (20 + (F.col("idx") * 37) % 80).cast("double"), "spans": spans, "para": F.lit(None).cast("bigint")}
    )


def lines(documents: DataFrame) -> DataFrame:
    return text_lines(documents).select("doc_id", "page", "line_no", "spans", "x0", "y0", "x1", "y1", "size", "conf", "para")


def layouts(documents: DataFrame) -> DataFrame:
    pages = text_lines(documents).select("doc_id", "page").distinct()
    return pages.select("doc_id", "page", F.lit(float(WIDTH)).alias("width"), F.lit(float(HEIGHT)).alias("height"), F.lit(None).cast("string").alias("pdf_label"), F.lit("text").alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("preview"))


def boxes(documents: DataFrame) -> DataFrame:
    """One figure a page, in the middle, on pages of odd number."""
    odd = layouts(documents).where("page % 2 = 1")
    return odd.select("doc_id", "page", F.lit(0).alias("fig_no"), F.lit(100.0).alias("x0"), F.lit(240.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(380.0).alias("y1"), F.lit("img").alias("image"), F.lit(None).cast("string").alias("caption"))


LINES_SQL = f"""
raw AS (SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS idx FROM documents),
sized AS (SELECT *, (idx // {PAGE_LINES})::INT AS page, (idx % {PAGE_LINES})::INT AS line_no, length(text)::INT AS n, CASE WHEN length(text) < 12 THEN 18.0 WHEN length(text) < 24 THEN 14.0 WHEN idx % 40 >= 37 THEN 8.5 ELSE 11.0 END::DOUBLE AS size, CASE WHEN idx % 5 = 0 THEN 90.0 ELSE 72.0 END::DOUBLE AS x0 FROM raw),
lines AS (SELECT *, ({TOP} + {PITCH} * line_no)::DOUBLE AS y0, CASE WHEN n >= 80 THEN 540.0::DOUBLE ELSE x0 + n * 5.5::DOUBLE END AS x1, ({TOP} + {PITCH} * line_no)::DOUBLE + size AS y1, (20 + (idx * 37) % 80)::DOUBLE AS conf FROM sized)"""
