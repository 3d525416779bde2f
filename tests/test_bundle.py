import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.hashing import crc32_hex, dos_datetime, fingerprint
from quire.operators import bundle, editing
from quire.operators.bundle import BundleSettings
from quire.operators.inlines import note_reference, page_break, text_run
from quire.operators.render import rendered
from quire.schemas import BLOCKS, IMAGES, NOTES, PAGES, READINGS
from quire.sources import epub, files

NOW = dt.datetime(2026, 10, 2, 12)
PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000d49444154789c6360000002000154a24f5f0000000049454e44ae426082")


def reading(key, seq, course="", title=None, status="done", name=None, source_key=None):
    return (key, seq, title or f"Reading {key}", "An Author", course, name or f"{key}.pdf", "pdf", source_key or key, status, 1.0, None)


def block(doc, no, kind, content=(), *, level=None, page=None, image=None, caption=None, items=None, rows=None, ordered=None):
    return (doc, no, kind, level, None, ordered, page, list(content), items, rows, image, None, caption)


@pytest.fixture(scope="module")
def one(spark):
    run = text_run
    blocks = [
        block("a", 0, "heading", [run("Reading a")], level=1, page=0),
        block("a", 1, "heading", [run("First part")], level=2, page=0),
        block("a", 2, "paragraph", [run("Said & <done>"), note_reference("n1"), run(" goes on"), page_break(1), run(" here.")], page=0),
        block("a", 3, "figure", image="fig1", caption="A picture", page=1),
        block("a", 4, "heading", [run("Deeper")], level=3, page=1),
        block("a", 5, "list", items=[[run("one")], [run("two", {"i": True})]], ordered=False, page=1),
        block("a", 6, "table", rows=[[[run("x")], [run("y")]]], page=1),
    ]
    pages = [("a", 0, "3", None, "text", None), ("a", 1, "4", None, "text", None), ("a", 2, "5", 88, "ocr", None)]
    return (
        spark.createDataFrame([reading("a", 0)], READINGS), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame([("a", 1, "n1", "1", [run("A note.")], 0)], NOTES),
        spark.createDataFrame(pages, PAGES), spark.createDataFrame([("fig1", PNG, "image/png", 1, 1)], IMAGES),
    )


def test_archive(spark, one, tmp_path):
    made = epub.bundle_files(*one, BundleSettings(title="A bundle"), NOW, "urn:test")
    path = str(tmp_path / "out.epub")
    epub.save(made, path, NOW)
    raw = open(path, "rb").read()
    assert raw[30:58] == b"mimetypeapplication/epub+zip" and raw[6:10] == b"\0\0\0\0" and raw[28:30] == b"\0\0"
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        assert z.testzip() is None
        assert names == ["mimetype", "META-INF/container.xml", "OEBPS/css/style.css", "OEBPS/text/title.xhtml", "OEBPS/text/r01-01.xhtml", "OEBPS/text/r01-notes.xhtml", "OEBPS/images/img1.png", "OEBPS/nav.xhtml", "OEBPS/toc.ncx", "OEBPS/content.opf"]
        text, nav, notes = (z.read(f"OEBPS/{x}").decode() for x in ("text/r01-01.xhtml", "nav.xhtml", "text/r01-notes.xhtml"))
        assert z.read("OEBPS/images/img1.png") == PNG
    assert "Said &amp; &lt;done&gt;" in text and 'href="r01-notes.xhtml#r01-n1"' in text and "pp. 3–5" in text
    assert text.count("<h3") == 1 and "[p.&#160;4]" in text and "r01-pg3" in text and "<i>two</i>" in text and "<td>y</td>" in text
    assert 'href="r01-01.xhtml#r01-nr1"' in notes and "(p.&#160;3)" in notes
    assert nav.index("First part") < nav.index("Deeper") and "text/r01-01.xhtml#r01-pg2" in nav


def test_options_off(one):
    readings, blocks, notes, pages, _ = one
    rows = rendered(bundle.ordered(readings), blocks, notes, pages, None, BundleSettings(page_markers=False, sections_in_toc=False, kepub=True)).collect()
    text = next(r["text"] for r in rows if r["part"] == "file")
    ids = [x.split('"')[0] for x in text.split('id="kobo.')[1:]]
    assert "[p." not in text and "pagebreak" in text and len(ids) == len(set(ids)) > 5
    assert len([r for r in rows if r["part"] == "toc"]) == 1


def test_long_reading_is_split(spark):
    readings = spark.createDataFrame([reading("a", 0)], READINGS)
    blocks = spark.createDataFrame([block("a", k, "heading" if k % 20 == 0 else "paragraph", [text_run("Words " * 100)], level=1, page=k // 20) for k in range(600)], BLOCKS)
    pages = spark.createDataFrame([("a", k, "", None, "text", None) for k in range(30)], PAGES)
    rows = rendered(bundle.ordered(readings), blocks, spark.createDataFrame([], NOTES), pages, None, BundleSettings()).where("part = 'file'").collect()
    assert len(rows) > 1 and all(len(r["text"]) < 300_000 for r in rows)


def test_order_by_course(spark):
    df = spark.createDataFrame([reading("a", 0, "SOC 101"), reading("b", 1, "HIST 210"), reading("c", 2, " SOC 101 ")], READINGS)
    assert [r["id"] for r in bundle.ordered(df).orderBy("place").collect()] == ["a", "c", "b"]
    single = spark.createDataFrame([reading("a", 0, ""), reading("b", 1, "X"), reading("c", 2, "")], READINGS)
    got = bundle.ordered(single).orderBy("place").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and not got[0]["grouped"]


def test_duplicates_and_counters(spark):
    df = spark.createDataFrame([reading("a", 0, source_key="k"), reading("b", 1, source_key="k"), reading("c", 2, status="error"), reading("d", 3, status="processing")], READINGS)
    pages = spark.createDataFrame([("a", 0, "", 50, "ocr", None)], PAGES)
    assert [r["id"] for r in bundle.duplicates(df, pages).collect()] == ["b"]
    assert bundle.counters(df, pages).first().asDict() == {"total": 4, "done": 2, "waiting": 1, "failed": 1, "review": 1}


def test_fingerprints(spark):
    base = bytes(200_000)
    changed = base[:100_000] + b"x" + base[100_001:]
    rows = spark.createDataFrame([(0, base), (1, changed), (2, base + b"y"), (3, b"123456789"), (4, b"")], "k int, c binary")
    got = [r["f"] for r in rows.select("k", fingerprint(F.col("c")).alias("f")).orderBy("k").collect()]
    assert got[0] == got[1] != got[2] and got[3] == "9:cbf43926:0" and got[4] == "0:0:0"
    assert rows.where("k = 3").select(crc32_hex(F.col("c"))).first()[0] == "cbf43926"
    t = spark.sql("SELECT timestamp'2026-10-02 12:34:57' AS t").select(dos_datetime(F.col("t")).alias("d")).first()["d"]
    assert (t["date"], t["time"]) == ((46 << 9) | (10 << 5) | 2, (12 << 11) | (34 << 5) | 28)


def test_intake_rules(spark):
    batch = spark.createDataFrame([(0, "a.pdf", "pdf", "f1"), (1, "again.pdf", "pdf", "f1"), (2, "x.zip", None, "f2"), (3, "p10.jpg", "image", "f3"), (4, "p2.jpg", "image", "f4"), (5, "old.pdf", "pdf", "f5")], "seq int, name string, kind string, fingerprint string")
    known = spark.createDataFrame([reading("z", 7, "HIST", source_key="f5;f9")], READINGS)
    marked = files.classify_batch(batch, files.known_fingerprints(known))
    assert [r["outcome"] for r in marked.orderBy("seq").collect()] == ["reading", "repeat", "skipped", "photo", "photo", "known"]
    made = files.new_readings(marked, known).orderBy("seq").collect()
    assert [(r["seq"], r["title"], r["course"], r["file_type"]) for r in made] == [(8, "A", "HIST", "pdf"), (9, "P2", "HIST", "image")]
    assert made[1]["source_key"] == "f3;f4"


def test_edits(spark):
    df = spark.createDataFrame([reading("a", 0), reading("b", 1), reading("c", 2)], READINGS)
    order = lambda x: [r["id"] for r in x.orderBy("seq").collect()]
    assert order(bundle.moved(df, 0, 2)) == ["b", "c", "a"] and order(bundle.moved(df, 2, 0)) == ["c", "a", "b"]
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    gone = bundle.removed(df, ["b"], now)
    assert order(bundle.present(gone)) == ["a", "c"] and order(bundle.present(bundle.undone(gone, ["b"]))) == ["a", "b", "c"]
    assert order(bundle.finalized(gone, F.lit("2026-01-01 00:00:10").cast("timestamp"))) == ["a", "c"]
    results = spark.createDataFrame([("a", "New", "Who", "Reading a", 3, None), ("b", "New", None, "other", 0, None)], "id string, new_title string, new_author string, auto_title string, n_blocks int, error string")
    got = {r["id"]: (r["title"], r["status"]) for r in bundle.merged_results(df, results).collect()}
    assert got == {"a": ("New", "done"), "b": ("Reading b", "error"), "c": ("Reading c", "done")}


def test_editable_round_trip(spark):
    content = [text_run("One", {"b": True}), note_reference("n1"), page_break(1), text_run("two")]
    df = spark.createDataFrame([(content,)], "content array<struct<t:string,text:string,i:boolean,b:boolean,sup:boolean,note:string,page:int>>")
    shown = df.select(editing.editable(F.col("content"), F.create_map(F.lit("n1"), F.lit("1")), F.create_map(F.lit(1), F.lit("47")))).first()[0]
    assert shown == "One⟦note 1⟧ ⟦p. 47⟧ two"
