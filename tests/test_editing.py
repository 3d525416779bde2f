import random
import re

from quire.operators import editing
from quire.operators.inlines import note_reference, page_break, text_run
from quire.schemas import BLOCKS, NOTES, PAGES

TOKEN = re.compile(r"⟦\s*(note|p\.)\s*([^⟧]*?)\s*⟧")


def name_of(page, labels):
    return labels.get(page) or str(page + 1)


def shown(content, notes, labels):
    markers = dict(notes)
    out = [c["text"] if c["t"] == "text" else f"⟦note {markers[c['note']]}⟧" if c["t"] == "noteref" and c["note"] in markers else "" if c["t"] == "noteref" else f" ⟦p. {name_of(c['page'], labels)}⟧ " for c in content]
    return re.sub(" {2,}", " ", "".join(out)).strip(" ")


def token_by_token(text, before, notes, labels):
    """One text, one token after the other. notes: (id, marker) in order; labels: of page."""
    if shown(before, notes, labels) == text.strip():
        return before
    out, end = [], 0
    for m in [*TOKEN.finditer(text), None]:
        part = text[end : m.start() if m else None]
        if part:
            out.append(text_run(re.sub(r"\s+", " ", part)))
        if m is None:
            break
        end = m.end()
        if m[1] == "note":
            own = [(c["note"], dict(notes)[c["note"]]) for c in before if c["t"] == "noteref" and c["note"] in dict(notes)]
            out += [note_reference(i) for i, marker in own + notes if marker == m[2]][:1]
        else:
            out += [page_break(p) for p in [c["page"] for c in before if c["t"] == "pb"] + sorted(labels) if name_of(p, labels) == m[2]][:1]
    if out and out[0]["t"] == "text":
        out[0]["text"] = out[0]["text"].lstrip()
    if out and out[-1]["t"] == "text":
        out[-1]["text"] = out[-1]["text"].rstrip()
    return [c for c in out if c["t"] != "text" or c["text"]]


def plain(content):
    return [(c["t"], c["text"], c["note"], c["page"], c["b"]) for c in content or ()]


def test_edits_equal_token_by_token(spark):
    rng = random.Random(3)
    notes = {d: [(f"{d}{k}", rng.choice("12*")) for k in range(4)] for d in "ab"} | {"c": []}
    labels = {d: {p: rng.choice(["", None, "5", "7"]) for p in range(4)} for d in "ab"} | {"c": {}}
    pieces = [" ", "  ", "word", "\n", "⟦note 1⟧", "⟦note *⟧", "⟦ note  2 ⟧", "⟦note 9⟧", "⟦p. 5⟧", "⟦p.7⟧", "⟦p. 2⟧", "⟦p. 99⟧", "⟦p. ⟧", "⟦x⟧", "⟦note 1", "é\u00a0"]
    rows, edits, want = [], [], {}
    for k in range(240):
        d = rng.choice("abc")
        pick = lambda: rng.choice([text_run(rng.choice(["One", "two ", " x"]), {"b": True}), note_reference(f"{d}{rng.randrange(5)}"), page_break(rng.randrange(6))])  # noqa: B023, E731
        before = [pick() for _ in range(rng.randrange(5))]
        text = shown(before, notes[d], labels[d]) + rng.choice(["", " "]) if k % 4 == 0 else "".join(rng.choices(pieces, k=rng.randrange(9)))
        rows.append((d, k, "paragraph", None, None, None, 0, before, None, None, None, None, None))
        want[d, k] = before
        if k % 5:
            edits.append((d, k, None if text == "" else text))
            want[d, k] = token_by_token(text, before, notes[d], labels[d])
    edits += [("z", 1, "no such block"), (None, None, "nothing")]
    blocks, edited = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(edits, "doc_id string, block_no int, text string")
    all_notes = spark.createDataFrame([(d, k, i, m, [], 0) for d, x in notes.items() for k, (i, m) in enumerate(x)], NOTES)
    all_pages = spark.createDataFrame([(d, p, label, None, "text", None) for d, x in labels.items() for p, label in x.items()], PAGES)
    got = {(r["doc_id"], r["block_no"]): plain(r["content"]) for r in editing.apply_edits(blocks, edited, all_notes, all_pages).collect()}
    assert got == {k: plain(v) for k, v in want.items()}
    none = editing.apply_edits(blocks.limit(0), edited, all_notes, all_pages)
    assert none.count() == 0 and none.columns == blocks.columns
