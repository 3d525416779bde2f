"""Schemas of the tables that the operators exchange. Order is always a column."""

from __future__ import annotations

from pyspark.sql.types import StructType

SPAN = "struct<text:string,sup:boolean,i:boolean,b:boolean>"
INLINE = "struct<t:string,text:string,i:boolean,b:boolean,sup:boolean,note:string,page:int>"

LINES = f"doc_id string, page int, line_no int, spans array<{SPAN}>, x0 double, y0 double, x1 double, y1 double, size double, conf double, para bigint"
PAGE_LAYOUTS = "doc_id string, page int, width double, height double, pdf_label string, source string, confidence double, preview string"
FIGURES = "doc_id string, page int, fig_no int, x0 double, y0 double, x1 double, y1 double, image string, caption string"
BLOCKS = (
    f"doc_id string, block_no int, kind string, level int, style string, ordered boolean, page int, content array<{INLINE}>, "
    f"items array<array<{INLINE}>>, rows array<array<array<{INLINE}>>>, image string, alt string, caption string"
)
NOTES = f"doc_id string, note_no int, id string, marker string, content array<{INLINE}>, page int"
PAGES = "doc_id string, page int, label string, confidence int, source string, preview string"
READINGS = "id string, seq int, title string, author string, course string, file_name string, file_type string, source_key string, status string, progress double, message string"
IMAGES = "id string, data binary, mime string, width int, height int"
SOURCES = "source_id string, name string, content binary, length bigint, fingerprint string"
OCR_WORDS = "doc_id string, page int, para bigint, line_no int, word_no int, text string, confidence double, symbols array<struct<text:string,is_superscript:boolean>>"
PDF_ITEMS = "doc_id string, page int, item_no int, str string, x double, y double, w double, size double, b boolean, i boolean"
BUNDLE_FILES = "path string, id string, data binary, store boolean, seq bigint"
TOC = "doc_id string, node_id int, parent_id int, level int, label string, href string"
PAGE_TARGETS = "doc_id string, seq int, label string, href string"

#: States of a reading.
STATUSES = ("queued", "processing", "done", "error")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
