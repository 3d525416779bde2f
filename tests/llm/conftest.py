import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def odd(documents):
    """Rows with nulls, empty and blank texts, repeats, and one very long text."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return documents((1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (5, long), (None, "no id here at all today"), (6, "plain text\nwith two lines"), (7, "x", None, None))
