"""HTML to blocks, notes and images. Markup that isn't well-formed is read as browsers do, so far as blocks go."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.inlines import note_reference, plain, style, text_run
from quire.schemas import INLINE, struct
from quire.shipping import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What an element's start closes, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_SPACE = re.compile(r"\s+")
_NOTE_ID, _NOTE_LINK, _BACK_LINK = re.compile(r"(foot|end)note-"), re.compile(r"#(?:foot|end)note-\d"), re.compile(r"#(foot|end)note-ref-")
_DATA = re.compile(r"data:(image/[\w+.-]+);base64,(.*)", re.S)

#: part is block, note or image; the fields of the others are null.
ROWS = f"part string, no int, kind string, level int, style string, ordered boolean, content array<{INLINE}>, items array<array<{INLINE}>>, rows array<array<array<{INLINE}>>>, image string, alt string, id string, marker string, data binary, mime string"
_FIELDS = [x.split()[0] for x in ROWS.split(", ")]


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def below(self) -> Iterator[Node]:
        for c in self.elements():
            yield c
            yield from c.below()

    def drop(self, child: Node) -> None:
        self.children = [c for c in self.children if c is not child]


class Tree(HTMLParser):
    """The document's elements; script and style contents are left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"li", "td", "th", "blockquote", "div", "body"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attributes}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent


class Reader:
    """Blocks, notes and images of one document."""

    def __init__(self, html: str):
        self.rows: list[dict] = []
        self.note_ids: dict[str, str] = {}
        self.counts = {"block": 0, "note": 0, "image": 0}
        root = Tree(html).root
        self._notes(root)
        for child in root.elements():
            self._visit(child, False)

    def _row(self, part: str, **fields) -> None:
        self.rows.append(dict.fromkeys(_FIELDS) | {"part": part, "no": self.counts[part]} | fields)
        self.counts[part] += 1

    def _notes(self, root: Node) -> None:
        found = [x for x in root.below() if x.tag == "li" and _NOTE_ID.match(x.attributes.get("id", ""))]
        for k, item in enumerate(found, 1):
            self.note_ids[item.attributes["id"]] = f"n{k}"
            for link in [x for x in item.below() if x.tag == "a" and _BACK_LINK.match(x.attributes.get("href", ""))]:
                link.parent.drop(link)
            self._row("note", id=f"n{k}", marker=str(k), content=self.inlines(item))
            around = item.parent
            around.drop(item)
            if around.parent is not None and not any(x.tag == "li" for x in around.below()):
                around.parent.drop(around)

    def inlines(self, node: Node) -> list[dict]:
        out: list[dict] = []
        self._walk(node, {"i": False, "b": False, "sup": False}, out)
        if out and out[0]["t"] == "text":
            out[0]["text"] = out[0]["text"].lstrip()
        if out and out[-1]["t"] == "text":
            out[-1]["text"] = out[-1]["text"].rstrip()
        return [c for c in out if c["t"] != "text" or c["text"]]

    def _walk(self, node: Node, now: dict, out: list[dict]) -> None:
        for child in node.children:
            if isinstance(child, str) or child.tag == "br":
                text = _SPACE.sub(" ", child) if isinstance(child, str) else " "
                run = text_run(text, now)
                if out and out[-1]["t"] == "text" and style(out[-1]) == style(run):
                    out[-1]["text"] += text
                elif text:
                    out.append(run)
            elif child.tag == "a" and _NOTE_LINK.match(child.attributes.get("href", "")):
                if note := self.note_ids.get(child.attributes["href"][1:]):
                    out.append(note_reference(note))
            elif child.tag != "img":
                tags = {"i": ("em", "i"), "b": ("strong", "b"), "sup": ("sup",)}
                self._walk(child, {k: now[k] or child.tag in own for k, own in tags.items()}, out)

    def _figure(self, node: Node, alt: bool) -> None:
        m = _DATA.match(node.attributes.get("src", ""))
        if not m:
            return
        try:
            data = base64.b64decode(m[2])
        except ValueError:
            return
        if m[1] not in ("image/png", "image/jpeg"):  # others would need a decoder
            return
        name = hashlib.sha256(data).hexdigest()
        self._row("image", id=name, data=data, mime=m[1])
        self._row("block", kind="figure", image=name, alt=node.attributes.get("alt") if alt else None)

    def _visit(self, node: Node, quoted: bool) -> None:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            if content := self.inlines(node):
                self._row("block", kind="heading", level=min(3, int(tag[1])), content=content)
        elif tag == "p":
            for image in [x for x in node.below() if x.tag == "img"]:
                self._figure(image, True)
            content = self.inlines(node)
            if any(c["t"] != "text" or c["text"].strip() for c in content):
                self._row("block", kind="paragraph", style="quote" if quoted else None, content=content)
        elif tag in ("ul", "ol"):
            if items := [self.inlines(x) for x in node.elements() if x.tag == "li"]:
                self._row("block", kind="list", ordered=tag == "ol", items=items)
        elif tag == "table":
            if rows := [[self.inlines(cell) for cell in x.elements()] for x in node.below() if x.tag == "tr"]:
                self._row("block", kind="table", rows=rows)
        elif tag == "img":
            self._figure(node, False)
        else:
            for child in node.elements():
                self._visit(child, quoted or tag == "blockquote")


def title_of(rows: list[dict]) -> str | None:
    return next((plain(r["content"]).strip() or None for r in rows if r["kind"] == "heading"), None)


def html_rows(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows of ROWS for each document; a null text makes none, one that can't be read makes none either and shows as missing."""
    schema = struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, {ROWS}")
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if html:
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, **row} for row in Reader(html).rows], out)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInArrow(work, schema)


ship(__name__)
