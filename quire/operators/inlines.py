"""Inline content as Python folds see it: lists of dicts with the fields of quire.schemas.INLINE."""

from __future__ import annotations

import unicodedata

from quire.shipping import ship

_SPACES = "\t\n\x0b\x0c\r " + "".join(map(chr, (160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)))
#: All small letters, for patterns.
_SMALL = "".join(c for c in map(chr, range(0x2FFF)) if unicodedata.category(c) == "Ll")
#: How a finished sentence ends.
FINISHED = tuple(".!?:;\"”’)]…")


def text_run(text: str, like: dict | None = None) -> dict:
    like = like or {}
    return {"t": "text", "text": text, "i": bool(like.get("i")), "b": bool(like.get("b")), "sup": bool(like.get("sup")), "note": None, "page": None}


def note_reference(note: str) -> dict:
    return {"t": "noteref", "text": None, "i": False, "b": False, "sup": False, "note": note, "page": None}


def page_break(page: int) -> dict:
    return {"t": "pb", "text": None, "i": False, "b": False, "sup": False, "note": None, "page": page}


def plain(content: list[dict] | None) -> str:
    return "".join(c["text"] for c in content or () if c["t"] == "text")


def style(run: dict) -> tuple[bool, bool, bool]:
    return bool(run.get("i")), bool(run.get("b")), bool(run.get("sup"))


def is_small_letter(c: str) -> bool:
    return unicodedata.category(c) == "Ll"


def breaks_word(before: str, after: str) -> bool:
    """Whether a hyphen at the end of before belongs to a word that goes on in after."""
    return len(before) > 1 and before[-1] == "-" and before[-2].isalpha() and bool(after) and is_small_letter(after[0])


def finished(text: str) -> bool:
    return text.endswith(FINISHED)


def add_runs(content: list[dict], runs: list[dict]) -> None:
    """Append runs of text; a run in the style of the last one becomes part of it."""
    for run in runs:
        if not run["text"]:
            continue
        if content and content[-1]["t"] == "text" and style(content[-1]) == style(run):
            content[-1]["text"] += run["text"]
        else:
            content.append(text_run(run["text"], run))


ship(__name__)
