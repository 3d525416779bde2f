import datetime as dt
import io
import zipfile

from quire.schemas import BUNDLE_FILES
from quire.sources import epub, state


def test_small_bundles_are_bytes_and_large_ones_files(spark, tmp_path):
    now, path = dt.datetime(2026, 1, 2, 3, 4, 6), str(tmp_path / "out.epub")
    files = spark.createDataFrame([("b.txt", "b", b"x" * 500, False, 2**40), ("mimetype", "", b"application/epub+zip", True, 0), ("a.txt", "a", b"short", False, 7)], BUNDLE_FILES).repartition(3)
    small = epub.export(files, 1000, path, now)
    assert not (tmp_path / "out.epub").exists() and epub.export(files, 1000, path, now, stream_above=10) is None
    for archive in (zipfile.ZipFile(io.BytesIO(small)), zipfile.ZipFile(path)):
        assert [(x.filename, x.compress_type, x.date_time) for x in archive.infolist()] == [("mimetype", 0, (2026, 1, 2, 3, 4, 6)), ("a.txt", 0, (2026, 1, 2, 3, 4, 6)), ("b.txt", 8, (2026, 1, 2, 3, 4, 6))]
        assert archive.read("b.txt") == b"x" * 500 and archive.testzip() is None


def test_starting_over(spark, tmp_path):
    readings = spark.createDataFrame([("a", 0, "T", "", "", "a.pdf", "pdf", None, "done", 1.0, None)], state.schemas.READINGS)
    state.save({"readings": readings}, str(tmp_path), 1)
    state.save(state.cleared(spark), str(tmp_path), 2)
    assert state.load(spark, str(tmp_path), "readings", 1).count() == 1
    assert all(state.load(spark, str(tmp_path), name, 2).count() == 0 for name in state.TABLES)
