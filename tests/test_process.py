import io
import zipfile

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import bundle, editing, process, raster
from quire.operators.inlines import note_reference, text_run
from quire.schemas import BLOCKS, FIGURES, IMAGES, NOTES, PAGE_LAYOUTS, PAGES, PDF_ITEMS, READINGS
from quire.sources import state


def word_file(title, body):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{title}</w:t></w:r></w:p><w:p><w:r><w:t>{body}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def reading(key, name, status="queued"):
    return (key, 0, text_title(name), "", "", name, "docx", key, status, 0.0, None)


def text_title(name):
    return name.split(".")[0].replace("_", " ").capitalize()


def test_word_files_to_results(spark):
    sources = spark.createDataFrame([("a", word_file("A fine title", "Some text."), "docx"), ("b", b"not a zip", "docx"), ("c", b"", "pdf")], "source_id string, content binary, kind string")
    made = process.from_word(process.by_kind(sources, "docx"))
    assert [(r["kind"], r["doc_id"]) for r in made.blocks.orderBy("block_no").collect()] == [("heading", "a"), ("paragraph", "a")]
    readings = spark.createDataFrame([reading("a", "my_file.docx"), reading("b", "bad.docx"), reading("gone", "gone.docx"), reading("old", "old.docx", "done")], READINGS)
    merged = {r["id"]: (r["title"], r["status"], r["message"]) for r in bundle.merged_results(readings, process.results(readings, made)).collect()}
    assert merged["a"] == ("A fine title", "done", None) and merged["b"][1] == "error" and "BadZipFile" in merged["b"][2]
    assert merged["gone"] == ("Gone", "error", "The file is no longer there.") and merged["old"][1] == "done"


def test_items_to_reading(spark):
    words = ["This", "layer", "of", "text", "is", "long", "enough", "to", "be", "used", "as", "it", "stands."]
    items = [("d", 0, k, w, 72.0 + 34 * k, 100.0, 30.0, 11.0, False, False) for k, w in enumerate(words)] + [("d", 1, 0, "short", 72.0, 100.0, 30.0, 11.0, False, False)]
    layouts = spark.createDataFrame([("d", k, 612.0, 792.0, None, None, None, None) for k in range(2)], PAGE_LAYOUTS)
    df = spark.createDataFrame(items, PDF_ITEMS)
    assert [r["source"] for r in process.routed(layouts, df).orderBy("page").collect()] == ["text", "ocr"]
    made = process.from_items(df, layouts, spark.createDataFrame([], FIGURES), spark.createDataFrame([], IMAGES))
    assert [text_of(r["content"]) for r in made.blocks.collect()] == [" ".join(words)]


def text_of(content):
    return "".join(c["text"] or "" for c in content)


def test_words_to_lines_without_figure_text(spark):
    words = spark.createDataFrame([("d", 0, 1, 0, 0, "Sure", 95.0, None), ("d", 0, 1, 1, 0, "smudge", 60.0, None)], process.ocr.OCR_WORDS)
    boxes = spark.createDataFrame([("d", 0, 1, 0, 72.0, 100.0, 200.0, 112.0, 11.0), ("d", 0, 1, 1, 110.0, 310.0, 200.0, 322.0, 0.0)], "doc_id string, page int, para bigint, line_no int, x0 double, y0 double, x1 double, y1 double, row_height double")
    figures = spark.createDataFrame([("d", 0, 0, 100.0, 300.0, 400.0, 500.0, "i", None)], FIGURES)
    lines, kept = process.recognized_figures(process.recognized_lines(words, boxes), figures)
    assert [(r["line_no"], r["size"]) for r in lines.collect()] == [(0, 11.0)] and kept.count() == 1


def test_branches_join_and_state_survives(spark, tmp_path):
    a = process.from_html(spark.createDataFrame([("x", "<h1>One</h1><p>t")], "doc_id string, html string"))
    b = process.from_html(spark.createDataFrame([("y", "<p>two"), ("z", None)], "doc_id string, html string"))
    both = process.all_of([a, b])
    assert both.blocks.count() == 3 and both.pages.count() == 2
    state.save({"blocks": both.blocks, "pages": both.pages, "readings": spark.createDataFrame([reading("x", "x.docx", "processing")], READINGS)}, str(tmp_path), 1)
    assert state.load(spark, str(tmp_path), "blocks", 1).count() == 3 and state.load(spark, str(tmp_path), "notes", 1).count() == 0
    assert state.load(spark, str(tmp_path), "readings", 1).first()["status"] == "queued"
    assert state.settings_from({"title": "T", "gone": 1}).title == "T" and state.settings_from({}).language == "en"
    assert state.without_garbage(both.pages, "doc_id", a.pages).count() == 1


def test_edited_blocks(spark):
    blocks = spark.createDataFrame([("d", k, "paragraph", None, None, None, 0, [text_run(f"Text {k}"), note_reference("n1")], None, None, None, None, None) for k in range(3)], BLOCKS)
    notes = spark.createDataFrame([("d", 1, "n1", "1", [text_run("Note")], 0)], NOTES)
    pages = spark.createDataFrame([("d", 0, "5", None, "text", None)], PAGES)
    edits = spark.createDataFrame([("d", 1, "New ⟦note 1⟧ end ⟦p. 5⟧"), ("d", 2, "Text 2⟦note 1⟧")], "doc_id string, block_no int, text string")
    got = {r["block_no"]: [(c["t"], c["text"]) for c in r["content"]] for r in editing.apply_edits(blocks, edits, notes, pages).collect()}
    assert got == {0: [("text", "Text 0"), ("noteref", None)], 1: [("text", "New "), ("noteref", None), ("text", " end "), ("pb", None)], 2: [("text", "Text 2"), ("noteref", None)]}
    assert editing.note_set(notes, "d", "n1", " a  b ").first()["content"][0]["text"] == "a b"
    assert editing.caption_set(blocks, "d", 0, " ").where("block_no = 0").first()["caption"] is None


def test_small_list_steps(spark):
    readings = spark.createDataFrame([reading("a", "a.docx", "done"), reading("b", "b.docx")], READINGS)
    assert [r["id"] for r in bundle.next_queued(readings).collect()] == ["b"] and bundle.selected_between(readings, 1, 0).count() == 2
    assert bundle.appended(readings, readings).count() == 4
    assert spark.range(1).select(text.cover_list(F.array(*map(F.lit, "abcd")), 3)).first()[0] == ["a", "b", "c", "+ 1 more"]
    assert raster.cropped(raster.np.zeros((10, 20)), (5, 2, 8, 4), 2.0).shape == (4, 6)
