import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from quire.operators import raster
from quire.schemas import OCR_WORDS, PDF_ITEMS
from quire.sources import ocr, pdf_items
from quire.sources.docx import docx_to_html
from quire.sources.html import Reader, html_rows, title_of


def said(content):
    return "".join(c["text"] if c["t"] == "text" else f"^{c['note']}^" for c in content or [])


def blocks(html):
    return [(r["kind"], r["level"], said(r["content"])) for r in Reader(html).rows if r["part"] == "block"]


def test_unclosed_markup():
    html = "<nav><a>x</a></nav><h1>Head <i>one</i></h1><p>First<p>Second <b>bold</b><ul><li>a<li>b</ul><script>var x='</p>';</script><h5>Low</h5>"
    assert blocks(html) == [("heading", 1, "Head one"), ("paragraph", None, "First"), ("paragraph", None, "Second bold"), ("list", None, ""), ("heading", 3, "Low")]
    items = [r["items"] for r in Reader(html).rows if r["kind"] == "list"][0]
    assert [said(x) for x in items] == ["a", "b"]


def test_notes_quotes_tables_images():
    html = (
        '<p>Text<sup><a href="#footnote-1">[1]</a></sup> on</p><blockquote><p>Quoted</p></blockquote><table><tr><td>x</td><td>y</td></tr></table>'
        '<p><img src="data:image/png;base64,aGk=" alt="pic"/></p><img src="data:image/gif;base64,aGk="/><ol><li id="footnote-1">A note <a href="#footnote-ref-1">back</a></li></ol>'
    )
    rows = Reader(html).rows
    assert [(r["id"], r["marker"], said(r["content"])) for r in rows if r["part"] == "note"] == [("n1", "1", "A note")]
    made = [r for r in rows if r["part"] == "block"]
    assert [r["kind"] for r in made] == ["paragraph", "paragraph", "table", "figure"]
    assert said(made[0]["content"]) == "Text^n1^ on" and made[1]["style"] == "quote" and said(made[2]["rows"][0][1]) == "y" and made[3]["alt"] == "pic"
    assert title_of(rows) is None


def test_html_rows_of_a_table(spark):
    df = spark.createDataFrame([(1, "<h2>One</h2><p>a"), (2, None), (3, "")], "page_id long, html string")
    assert [(r["doc_id"], r["no"], r["kind"]) for r in html_rows(df, "page_id", "html").orderBy("doc_id", "no").collect()] == [(1, 0, "heading"), (1, 1, "paragraph")]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    document = (
        f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Title &amp; all</w:t></w:r></w:p><w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>slanted</w:t></w:r>'
        '<w:r><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p></w:body></w:document>'
    )
    notes = f'<w:footnotes {w}><w:footnote w:id="2"><w:p><w:r><w:t>Noted.</w:t></w:r></w:p></w:footnote></w:footnotes>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
        z.writestr("word/footnotes.xml", notes)
    rows = Reader(docx_to_html(out.getvalue())).rows
    assert [(r["part"], r["kind"], said(r["content"])) for r in rows] == [("note", None, "Noted."), ("block", "heading", "Title & all"), ("block", "paragraph", "Plain slanted^n1^"), ("block", "list", "")]


def test_items_to_lines(spark):
    items = [("d", 0, 0, "Hello", 72.0, 100.0, 28.0, 11.0, False, False), ("d", 0, 1, "world", 104.0, 100.4, 28.0, 11.0, False, False), ("d", 0, 2, "2", 132.5, 96.0, 4.0, 7.0, False, False), ("d", 0, 3, "Far", 400.0, 100.0, 20.0, 11.0, True, False), ("d", 0, 4, "Next", 72.0, 114.0, 20.0, 11.0, False, False)]
    got = pdf_items.lines_from_items(spark.createDataFrame(items, PDF_ITEMS).repartition(3)).orderBy("line_no").collect()
    assert [["".join(s["text"] for s in r["spans"]), r["size"]] for r in got] == [["Hello world2", 11.0], ["Far", 11.0], ["Next", 11.0]]
    assert got[0]["spans"][-1]["sup"] and got[1]["spans"][0]["b"] and abs(got[0]["y0"] - 91.2) < 0.01


def test_words_to_spans(spark):
    def word(no, text, conf=90.0, line=0, sup=()):
        return ("d", 0, 1, line, no, text, conf, [(c, k in sup) for k, c in enumerate(text)])

    words = [word(0, "~", 70.0), word(1, "1"), word(2, "These"), word(3, "words2", sup=(5,)), word(0, "means", line=1), word(1, "of", line=1), word(2, ":", 40.0, line=1), word(0, "is", line=2), word(1, "a", line=2), word(0, "¢", 30.0, line=3), word(1, "nty.", line=3), word(0, "~", 10.0, line=4)]
    got = ocr.word_spans(spark.createDataFrame(words, OCR_WORDS)).orderBy("line_no").collect()
    assert ["".join(s["text"] for s in r["spans"]) for r in got] == ["1 These words2", "means of", "is a", "nty."]
    assert got[0]["spans"][-1]["sup"] and got[0]["spans"][-1]["text"] == "2"


def test_symbols_stay_with_their_words(spark):
    """No symbol is dealt out with its word; flags that are unknown are none, and no symbols no tail."""
    flags = {"ab12": [False, False, True, True], "xy3": [True, None, True], "all": [True, True, True], "end": [False, True, None], "bare": None}
    words = [("d", 0, 1, 0, k, t, 90.0, None if f is None else list(zip(t, f))) for k, (t, f) in enumerate(flags.items())]
    got = ocr.word_spans(spark.createDataFrame(words, OCR_WORDS).repartition(3))
    assert [(s["text"], s["sup"]) for s in got.first()["spans"]] == [("ab", False), ("12", True), (" xy", False), ("3", True), (" all", False), (" end", False), (" bare", False)]
    grouped = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x]
    assert grouped and not any("symbols" in x for x in grouped)


def test_engine_errors_are_rows(spark):
    def engine():
        def read(row):
            if row["source_id"] == "bad":
                raise ValueError("no")
            yield {"doc_id": row["source_id"], "page": 0, "item_no": 0, "str": "x", "x": 1.0, "y": 1.0, "w": 1.0, "size": 10.0, "b": False, "i": False}

        return read

    got = ocr.extract(spark.createDataFrame([("ok",), ("bad",)], "source_id string"), engine, PDF_ITEMS).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["error"]) for r in got] == [("bad", "ValueError: no"), ("ok", None)]


def test_raster():
    rng = np.random.default_rng(0)
    page = np.full((300, 200), 240, np.uint8)
    page[30:270:8, 20:180] = rng.integers(0, 255, (30, 160))
    spread = np.hstack([page, page])
    at = raster.spread_gutter(spread)
    assert at is not None and 180 <= at <= 220 and raster.spread_gutter(page) is None and len(raster.halves(spread)) == 2
    shaded = (np.linspace(120, 250, 400)[None, :] * np.ones((300, 1))).astype(np.uint8)
    assert raster.flattened(shaded).std() < shaded.std() / 4
    assert raster.stretched(np.clip(page, 60, 255)).min() == 0 and raster.recognition_scale(1000, 800) == 2.2 and raster.recognition_scale(7200, 100) == 0.5
    image = np.full((700, 700), 255, np.uint8)
    image[200:400, 200:500] = 90
    boxes = raster.figure_boxes(image, [], 20)
    assert len(boxes) == 1 and abs(boxes[0][0] - 200) <= 30 and not raster.figure_boxes(image, [(190, 190, 510, 410)], 20)
    assert raster.luma(np.array([[[0, 0, 255]]], np.uint8))[0, 0] == 76 and raster.added_boxes([(0, 0, 50, 50)], [(10, 10, 40, 40), (60, 60, 99, 99)], 100, 100) == [(0, 0, 50, 50), (60, 60, 99, 99)]


def test_gray_columns(spark):
    df = spark.createDataFrame([("s", (4, 2, 3, bytes(24)))], "source_id string, image struct<width:int,height:int,nChannels:int,data:binary>")
    got = df.select("source_id", raster.gray_image(F.col("image")).alias("gray"))
    assert raster.split_spreads(got).count() == 1
    assert got.select(raster.prepared(F.col("gray")).alias("p")).first()["p"]["width"] == 10
