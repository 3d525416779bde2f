"""Queries over fixed inputs whose results were worked out by hand, where SQL can't compute them: the SQL lists what must come out."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import editing, process, render
from quire.operators.bundle import BundleSettings
from quire.operators.inlines import note_reference, page_break, text_run
from quire.plans.catalog import query
from quire.schemas import BLOCKS, IMAGES, NOTES, PAGES, READINGS
from quire.sources import epub, html


def _quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(names: str, rows: list[tuple]) -> str:
    """SQL that gives these rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS t({names})"


def told(content: Column) -> Column:
    """Inline content as text, page breaks as |n|, references as ^id^."""
    return F.array_join(F.transform(content, lambda c: F.when(c["t"] == "text", c["text"]).when(c["t"] == "pb", F.concat(F.lit("|"), c["page"].cast("string"), F.lit("|"))).otherwise(F.concat(F.lit("^"), c["note"], F.lit("^")))), "")


_HTML = {
    "plain": "<nav><a>x</a></nav><h1>Head <i>one</i></h1><p>First<p>Second <b>bold</b><ul><li>a<li>b <i>c</i></ul><script>var x='</p>';</script><h5>Low</h5>",
    "rich": '<p>Text<sup><a href="#footnote-1">[1]</a></sup> on</p><blockquote><p>Quoted</p></blockquote><table><tr><td>x</td><th>y</th></tr><tr><td>z</td></tr></table>'
    '<p>Seen <img src="data:image/png;base64,aGk=" alt="pic"/></p><ol><li>one</li></ol><ol><li id="footnote-1">A note <a href="#footnote-ref-1">back</a></li></ol>',
    "spaces": "<div><section><h3>  Deep \n heading</h3></section>line<p> a\n\n b<br>c </p><p> </p></div>",
}
_HTML_ROWS = [
    ("plain", "block", 0, "heading", 1, None, "Head one"), ("plain", "block", 1, "paragraph", None, None, "First"), ("plain", "block", 2, "paragraph", None, None, "Second bold"), ("plain", "block", 3, "list", None, None, "a;b c"), ("plain", "block", 4, "heading", 3, None, "Low"),
    ("rich", "note", 0, None, None, None, "A note"), ("rich", "block", 0, "paragraph", None, None, "Text^n1^ on"), ("rich", "block", 1, "paragraph", None, "quote", "Quoted"), ("rich", "block", 2, "table", None, None, "x,y;z"),
    ("rich", "image", 0, None, None, None, None), ("rich", "block", 3, "figure", None, None, "pic"), ("rich", "block", 4, "paragraph", None, None, "Seen"), ("rich", "block", 5, "list", None, None, "one"),
    ("spaces", "block", 0, "heading", 3, None, "Deep heading"), ("spaces", "block", 1, "paragraph", None, None, "a b c"),
]


def _html_text() -> Column:
    listed = F.array_join(F.transform("items", told), ";")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, told), ",")), ";")
    return F.when(F.col("kind") == "list", listed).when(F.col("kind") == "table", rows).when(F.col("kind") == "figure", F.col("alt")).when(F.col("part") != "image", F.trim(told(F.col("content"))))


@query(values("doc_id, part, no, kind, level, style, text", _HTML_ROWS))
def html_documents(spark, sf):
    """Unclosed markup, notes, quotations, lists, tables and images of HTML."""
    docs = spark.createDataFrame(list(_HTML.items()), "doc_id string, html string")
    return html.html_rows(docs, "doc_id", "html").select("doc_id", "part", "no", "kind", "level", "style", _html_text().alias("text"))


def _word_file(paragraphs: str, notes: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>")
        archive.writestr("word/footnotes.xml", f"<w:footnotes {w}>{notes}</w:footnotes>")
    return out.getvalue()


def _word_paragraph(runs: str, style: str = "") -> str:
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}{runs}</w:p>'


_RUN = "<w:r><w:t xml:space=\"preserve\">{}</w:t></w:r>"
_WORD = [
    ("good", "block", 0, "heading", 1, "Title & all"), ("good", "block", 1, "heading", 2, "Under it"), ("good", "block", 2, "paragraph", None, "Plain slanted^n1^"), ("good", "block", 3, "paragraph", None, "Quoted"), ("good", "note", 1, None, None, "Noted."), ("bad", "error", 0, None, None, "BadZipFile"),
]


@query(values("doc_id, part, no, kind, level, text", _WORD))
def word_documents(spark, sf):
    """Word files through the driver for their kind; a damaged one is a row with its error."""
    body = (
        _word_paragraph(_RUN.format("Title &amp; all"), "Title") + _word_paragraph(_RUN.format("Under it"), "Subtitle")
        + _word_paragraph(_RUN.format("Plain ") + '<w:r><w:rPr><w:i/></w:rPr><w:t>slanted</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r>') + _word_paragraph(_RUN.format("Quoted"), "Quote")
    )
    notes = f'<w:footnote w:id="2">{_word_paragraph(_RUN.format("Noted."))}</w:footnote>'
    sources = spark.createDataFrame([("good", _word_file(body, notes), "docx"), ("bad", b"no archive", "docx"), ("other", b"", "pdf")], "source_id string, content binary, kind string")
    made = process.from_word(process.by_kind(sources, "docx"))
    shown = made.blocks.select("doc_id", F.lit("block").alias("part"), F.col("block_no").alias("no"), "kind", "level", F.trim(told(F.col("content"))).alias("text"))
    noted = made.notes.select("doc_id", F.lit("note").alias("part"), F.col("note_no").alias("no"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("level"), F.trim(told(F.col("content"))).alias("text"))
    failed = made.errors.select("doc_id", F.lit("error").alias("part"), F.lit(0).alias("no"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("level"), F.regexp_extract("error", r"^\w+", 0).alias("text"))
    return shown.unionByName(noted).unionByName(failed)


_EDITED = [(0, "Text 0^n1^"), (1, "New ^n1^ end |0|"), (2, "Text 2^n1^"), (3, "^n2^ and gone"), (4, "Text 4^n1^")]


def _editable(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = spark.createDataFrame([("d", k, "paragraph", None, None, None, 0, [text_run(f"Text {k}"), note_reference("n1")], None, None, None, None, None) for k in range(5)], BLOCKS)
    notes = spark.createDataFrame([("d", 1, "n1", "1", [text_run("Note")], 0), ("d", 2, "n2", "2", [text_run("Other")], 0)], NOTES)
    return made, notes, spark.createDataFrame([("d", 0, "5", None, "text", None), ("d", 1, "", None, "text", None)], PAGES)


@query(values("block_no, text", _EDITED))
def edited_texts(spark, sf):
    """Edited texts put in place: an unchanged one keeps what it had, tokens are looked up, unknown ones vanish."""
    made, notes, pages = _editable(spark)
    edits = spark.createDataFrame([("d", 1, "New ⟦note 1⟧ end ⟦p. 5⟧"), ("d", 2, "Text 2⟦note 1⟧"), ("d", 3, "⟦note 2⟧ and ⟦note 9⟧gone⟦p. 77⟧")], "doc_id string, block_no int, text string")
    return editing.apply_edits(made, edits, notes, pages).select("block_no", told(F.col("content")).alias("text"))


@query(values("part, no, text", [("caption", 0, "A view"), ("caption", 1, None), ("note", 1, "a b"), ("note", 2, "Other")]))
def edited_captions(spark, sf):
    made, notes, _ = _editable(spark)
    made = editing.caption_set(editing.caption_set(made.where("block_no < 2").withColumn("caption", F.lit("old")), "d", 0, " A view "), "d", 1, " ")
    return made.select(F.lit("caption").alias("part"), F.col("block_no").alias("no"), F.col("caption").alias("text")).union(editing.note_set(notes, "d", "n1", " a  b ").select(F.lit("note"), "note_no", told(F.col("content"))))


def _shelf(spark):
    """Two finished readings and one that failed."""
    reading = lambda k, seq, title, course, status="done": (k, seq, title, "", course, f"{k}.pdf", "pdf", None, status, 1.0, None)
    readings = spark.createDataFrame([reading("a", 0, "Liberty", "POL"), reading("b", 1, "Other", ""), reading("c", 2, "Lost", "POL", "error")], READINGS)
    paragraph = lambda d, no, page, *content, **more: (d, no, more.get("kind", "paragraph"), more.get("level"), more.get("style"), more.get("ordered"), page, list(content), more.get("items"), more.get("rows"), more.get("image"), None, more.get("caption"))
    made = spark.createDataFrame(
        [
            paragraph("a", 0, 0, text_run("LIBERTY"), kind="heading", level=1),
            paragraph("a", 1, 0, text_run("Some "), text_run("bold", {"b": True}), text_run(" & more"), note_reference("n1"), page_break(1), text_run("on.")),
            paragraph("a", 2, 1, text_run("Part <one>"), kind="heading", level=2),
            paragraph("a", 3, 1, kind="list", ordered=False, items=[[text_run("x")], [text_run("y", {"i": True})]]),
            paragraph("a", 4, 1, kind="table", rows=[[[text_run("p")], [text_run("q")]]]),
            paragraph("a", 5, 1, kind="figure", image="i1", caption="A view"),
            paragraph("a", 6, 1, kind="figure", image="gone"),
            paragraph("b", 0, None, text_run("Quoted."), style="quote"),
            paragraph("c", 0, None, text_run("Never shown.")),
        ],
        BLOCKS,
    )
    notes = spark.createDataFrame([("a", 1, "n1", "1", [text_run("See there.")], 0)], NOTES)
    pages = spark.createDataFrame([("a", 0, "47", None, "text", None), ("a", 1, "48", None, "text", None), ("a", 2, "", None, "text", None), ("b", 0, "", None, "docx", None)], PAGES)
    images = spark.createDataFrame([("i1", b"png!", "image/png", 30, 20), ("i2", b"never", "image/png", 1, 1)], IMAGES)
    return readings, made, notes, pages, images


_PAGE = '<span class="pg" epub:type="pagebreak" role="doc-pagebreak" id="r01-pg{0}" title="{1}" aria-label="{1}">[p.&#160;{1}]</span>'
_FIRST = "\n".join([
    '<header class="reading-head">', '<p class="course">POL</p>', '<h1 id="r01-title">Liberty</h1>', '<p class="source">a.pdf · pp. 47–48</p>', "</header>",
    f'<p>{_PAGE.format(1, 47)}</p>',
    f'<p>Some <b>bold</b> &amp; more<sup><a class="nref" epub:type="noteref" role="doc-noteref" id="r01-nr1" href="r01-notes.xhtml#r01-n1">1</a></sup> {_PAGE.format(2, 48)} on.</p>',
    '<h3 id="r01-h1">Part &lt;one&gt;</h3>', "<ul>", "<li>x</li>", "<li><i>y</i></li>", "</ul>", "<table>", "<tbody>", "<tr><td>p</td><td>q</td></tr>", "</tbody>", "</table>",
    "<figure>", '<img src="../images/img1.png" alt="A view" width="30" height="20"/>', "<figcaption>A view</figcaption>", "</figure>",
    f'<p class="pgline">{_PAGE.format(3, 3)}</p>',
])
_SECOND = "\n".join(['<header class="reading-head">', '<h1 id="r02-title">Other</h1>', '<p class="source">b.pdf</p>', "</header>", '<p class="quote">Quoted.</p>'])
_ITEM = '<li id="r01-n1" epub:type="endnote"><p><a class="back" href="r01-01.xhtml#r01-nr1" role="doc-backlink">1.</a> See there. <span class="where">(p.&#160;47)</span></p></li>'


@query(values("path, body", [("text/r01-01.xhtml", _FIRST), ("text/r02-01.xhtml", _SECOND), ("text/r01-notes.xhtml", _ITEM)]))
def rendered_readings(spark, sf):
    """What stands between the body tags of each reading's files; of notes, their items."""
    readings, made, notes, pages, _ = _shelf(spark)
    shown = spark.createDataFrame([("i1", "images/img1.png", 30, 20)], "id string, href string, width int, height int")
    listed = readings.where("status = 'done'").withColumn("place", F.col("seq"))
    files = render.rendered(listed, made, notes, pages, shown, BundleSettings()).where("part = 'file'")
    body = F.when(F.col("path").contains("notes"), F.regexp_extract("text", r"(?s)(<li id=.*</li>)", 1)).otherwise(F.regexp_extract("text", r"(?s)<body>\n(.*)\n</body>", 1))
    return files.select("path", body.alias("body"))


_TARGETS = [("page", 0, "47", "text/r01-01.xhtml#r01-pg1"), ("page", 1, "48", "text/r01-01.xhtml#r01-pg2"), ("page", 2, "3", "text/r01-01.xhtml#r01-pg3"), ("toc", 0, "Liberty", "text/r01-01.xhtml"), ("toc", 1, "Part <one>", "text/r01-01.xhtml#r01-h1"), ("toc", 0, "Other", "text/r02-01.xhtml")]


@query(values("part, seq, label, href", _TARGETS))
def rendered_targets(spark, sf):
    """Table of contents and page list of the readings."""
    readings, made, notes, pages, _ = _shelf(spark)
    listed = readings.where("status = 'done'").withColumn("place", F.col("seq"))
    return render.rendered(listed, made, notes, pages, None, BundleSettings()).where("part in ('toc', 'page')").select("part", "seq", "label", "href")


_NAV = ['<li><a href="text/title.xhtml">Contents</a></li>', '<li><a href="text/r01-01.xhtml">Liberty</a><ol><li><a href="text/r01-01.xhtml#r01-h1">Part &lt;one&gt;</a></li></ol></li>', '<li><a href="text/r02-01.xhtml">Other</a></li>']
_FILES = [
    ("mimetype", True, "application/epub+zip"), ("META-INF/container.xml", False, None), ("OEBPS/css/style.css", False, None), ("OEBPS/text/title.xhtml", False, '<ol><li><a href="r01-01.xhtml">Liberty</a></li><li><a href="r02-01.xhtml">Other</a></li></ol>'),
    ("OEBPS/text/r01-01.xhtml", False, None), ("OEBPS/text/r01-notes.xhtml", False, None), ("OEBPS/text/r02-01.xhtml", False, None), ("OEBPS/images/img1.png", True, None),
    ("OEBPS/nav.xhtml", False, "<ol>" + "".join(_NAV) + "</ol>"), ("OEBPS/toc.ncx", False, "Contents 1 Liberty 2 Part &lt;one&gt; 3 Other 4"), ("OEBPS/content.opf", False, "nav ncx css title r01-01 r01-notes r02-01 img1 / title r01-01 r01-notes r02-01 / 2026-01-02T03:04:05Z"),
]


@query(values("n, path, store, holds", [(k, *r) for k, r in enumerate(_FILES, 1)]))
def archive_files(spark, sf):
    """The files of an archive in order, and what their navigation holds."""
    made = epub.bundle_files(*_shelf(spark), BundleSettings(title="Week 5"), dt.datetime(2026, 1, 2, 3, 4, 5))
    text = F.decode("data", "UTF-8")
    every = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    points = F.array_join(F.transform(F.arrays_zip(every("<text>([^<]*)</text></navLabel>").alias("label"), every('playOrder="([0-9]+)"').alias("play")), lambda x: F.concat_ws(" ", x["label"], x["play"])), " ")
    package = F.concat_ws(" / ", F.array_join(every('<item id="([^"]*)"'), " "), F.array_join(every('<itemref idref="([^"]*)"'), " "), F.regexp_extract(text, "modified\">([^<]*)<", 1))
    path = F.col("path")
    holds = (
        F.when(path == "mimetype", text).when(path.endswith("title.xhtml"), F.regexp_extract(text, "(<ol>.*</ol>)", 1)).when(path.endswith("nav.xhtml"), F.regexp_extract(text, "</h1>(<ol>.*?</ol>)</nav>", 1))
        .when(path.endswith(".ncx"), points).when(path.endswith(".opf"), package)
    )
    from pyspark.sql import Window

    # a list of eleven files
    return made.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")).alias("n"), "path", "store", holds.alias("holds"))


