import pytest
from pyspark.sql import functions as F

from quire.functions import stats, text
from quire.operators import layout
from quire.streaming.intake import intake, new_files


def apply(spark, fn, *rows):
    n = len(rows[0])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(n)))
    return [r["out"] for r in df.select("k", fn(*(F.col(f"c{i}") for i in range(n))).alias("out")).orderBy("k").collect()]


def test_page_numbers(spark):
    given_, want = zip(("47", "47"), ("— 112 —", "112"), ("THE SOCIOLOGICAL IMAGINATION 9", "9"), ("12 Chapter One", "12"), ("xii", "xii"), ("Introduction", None), ("007", "7"), ("page 5", "5"))
    assert apply(spark, text.page_number, *((x,) for x in given_)) == list(want)


def test_joined(spark):
    assert apply(spark, text.joined, ("imagi-", "nation"), ("Anglo-", "Saxon"), ("the", "next"), ("", "x"), ("a ", "b")) == ["imagination", "Anglo- Saxon", "the next", "x", "a b"]


def test_similarity(spark):
    got = apply(spark, text.dice, ("the sociological imagination", "the socioiogical imaginatlon"), ("the promise", "on intellectual"), ("night", "nacht"), ("a", "b"), ("x", "x"), ("aaa", "aa"))
    assert got[0] > 0.75 and got[1] < 0.4 and got[2] == 0.25 and got[3:5] == [0, 1] and abs(got[5] - 2 / 3) < 1e-9


def test_titles(spark):
    assert apply(spark, text.title_from_file_name, ("mill-scan.pdf",), ("Smith - Chapter 3.pdf",), ("week_5_reading.docx",), (".pdf",)) == ["Mill scan", "Smith – Chapter 3", "Week 5 reading", "Untitled reading"]
    assert apply(spark, text.tidy_heading, ("CHAPTER I1",), ("CHAPTER I 1",), ("THE SOCIOLOGICAL IMAGINATION",), ("(Of the Liberty of Thought",)) == ["Chapter II", "Chapter II", "The Sociological Imagination", "Of the Liberty of Thought"]
    assert apply(spark, text.clean_title, ("Microsoft Word - essay.doc",), ("untitled",), ("A book",)) == ["essay", None, "A book"]


def test_file_names(spark):
    name = lambda c, t: text.epub_file_name(c, t, F.lit(False))
    got = apply(spark, name, ("Week 5: Mill / Weber?", ""), ("", "Psych 201 — Week 5: Memory & Learning"), ("..hidden.", ""), ("SOC 101 – Week 1 “Mill” café", ""), ("", ""))
    assert got == ["Week 5 Mill Weber.epub", "Psych-201-Week-5-Memory-Learning.epub", "hidden.epub", "SOC 101 - Week 1 Mill cafe.epub", "readings.epub"]
    assert apply(spark, lambda c, t: text.epub_file_name(c, t, F.lit(True)), ("Week 5.epub", "")) == ["Week 5.kepub.epub"]


def test_small_ones(spark):
    assert apply(spark, text.kind_of, ("A.PDF",), ("x.docx",), ("y.HEIC",), ("z.txt",)) == ["pdf", "docx", "image", None]
    assert apply(spark, text.xml_safe, ("a<b>&\"c\x01",)) == ["a&lt;b&gt;&amp;&quot;c"]
    assert apply(spark, text.norm_header, ("The Promise 47",), ("xii Preface",)) == ["the promise", "preface"]
    keys = apply(spark, text.natural_key, ("p10.jpg",), ("P2.jpg",), ("p1.jpg",))
    assert sorted(range(3), key=keys.__getitem__) == [2, 1, 0]
    assert apply(spark, text.toc_label, ("x" * 130,), (" a  b ",)) == ["x" * 117 + "…", "a b"]
    assert apply(spark, lambda c: text.padded(c.cast("int")), ("7",), ("123",)) == ["07", "123"]
    assert apply(spark, lambda c: text.bytes_text(c.cast("long")), ("2048",), ("5242880",), ("52428800",)) == ["2 KB", "5.0 MB", "50 MB"]
    assert apply(spark, lambda c: text.name_list(F.split(c, ",")), ("a,b",), ("a,b,c,d,e",)) == ["a, b", "a, b, c and 2 more"]
    assert apply(spark, lambda c: F.array_join(text.sentences(c), "|"), ('One. Two? "Three!" Four',), ("...",)) == ['One. |Two? |"Three!" |Four', "..."]


def test_sentences_are_lossless(spark):
    import random

    rng = random.Random(2)
    values = ["".join(rng.choices("ab .!?…”)\n", k=rng.randint(0, 20))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.where(F.array_join(text.sentences(F.col("v")), "") != F.col("v")).count() == 0


def test_labels(spark):
    def resolved(detected, own):
        pages = spark.createDataFrame([("d", k, own[k] if own else None) for k in range(len(detected))], "doc_id string, page int, pdf_label string")
        running = spark.createDataFrame([("d", k, 0, x, 0, 1) for k, x in enumerate(detected) if x], "doc_id string, page int, line_no int, number string, end int, place long")
        return [r["label"] for r in layout.page_labels(pages, running).orderBy("page").collect()]

    assert resolved(["16", "17", "13", None, "20"], None) == ["16", "17", "18", "19", "20"]
    assert resolved([None, None], None) == ["", ""]
    assert resolved([None, None], ["223", "224"]) == ["223", "224"]
    assert resolved(["5", "6"], ["1", "2"]) == ["5", "6"]
    assert resolved(["iv", "5"], None) == ["iv", "5"]


def test_stats(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],), ([],)], "v array<double>")
    assert [tuple(r) for r in df.select(stats.nearest_rank(F.col("v"), 0.85), stats.upper_middle(F.col("v"), 30.0)).collect()] == [(4.0, 3.0), (0.0, 30.0)]
    rows = spark.createDataFrame([("a", 2, 0), ("a", 1, 1), ("a", 1, 2), ("a", 2, 3)], "g string, v int, o int")
    assert stats.first_seen_mode(rows, ["g"], "v", "o").first()["v"] == 2
    assert spark.range(1).select(stats.half_up(F.lit(-2.5))).first()[0] == -2


@pytest.mark.parametrize("again", [False, True])
def test_intake_stream(spark, tmp_path, again):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, data in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.docx", b"2"), ("d.txt", b"3")):
        (inbox / name).write_bytes(data)
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "check")
    intake(spark, str(inbox), state, checkpoint).awaitTermination(120)
    if again:
        (inbox / "e.pdf").write_bytes(b"1")
        (inbox / "f.pdf").write_bytes(b"4")
        intake(spark, str(inbox), state, checkpoint).awaitTermination(120)
    assert spark.read.parquet(state).count() == 2 + again


def test_stream_drops_repeats(spark, tmp_path):
    for name, data in (("a.pdf", b"1"), ("b.pdf", b"1"), ("c.pdf", b"2")):
        (tmp_path / name).write_bytes(data)
    query = new_files(spark, str(tmp_path)).select("fingerprint").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 2
