"""Word files to HTML, with the standard library only; quire.sources.html takes it from there.

Title and Subtitle become h1 and h2, Quote a block quotation, headings h1 to h6, numbered paragraphs list items, footnotes a list at the end.
"""

from __future__ import annotations

import base64
import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from itertools import groupby

from quire.shipping import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def _value(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else node.get(_W + name)


def _on(properties: ET.Element | None, tag: str) -> bool:
    node = properties.find(_W + tag) if properties is not None else None
    return node is not None and _value(node) not in ("0", "false", "none")


class _Word:
    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.files.namelist())
        part = lambda name: ET.fromstring(self.files.read(name)) if name in names else None
        links = part("word/_rels/document.xml.rels")
        self.targets = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}
        self.body = part("word/document.xml").find(f"{_W}body")
        self.notes = {kind: part(f"word/{kind}notes.xml") for kind in ("foot", "end")}
        self.used: list[tuple[str, str]] = []
        self.ordered = self._ordered(part("word/numbering.xml"))

    @staticmethod
    def _ordered(numbering: ET.Element | None) -> dict[str, bool]:
        """Whether each list's first level counts."""
        if numbering is None:
            return {}
        kinds = {_value(x, "abstractNumId"): _value(x.find(f"{_W}lvl/{_W}numFmt")) for x in numbering.findall(f"{_W}abstractNum")}
        return {_value(x, "numId"): kinds.get(_value(x.find(f"{_W}abstractNumId"))) not in (None, "bullet", "none") for x in numbering.findall(f"{_W}num")}

    def run(self, node: ET.Element) -> str:
        out = ""
        for x in node:
            tag = x.tag.removeprefix(_W)
            if tag == "t":
                out += html.escape(x.text or "", quote=False)
            elif tag in ("tab", "br", "cr"):
                out += "<br/>" if tag != "tab" else " "
            elif tag in ("footnoteReference", "endnoteReference"):
                kind = tag.removesuffix("noteReference")
                self.used.append((kind, _value(x, "id")))
                out += f'<sup><a href="#{kind}note-{_value(x, "id")}">{len(self.used)}</a></sup>'
            elif tag == "drawing":
                for blip in x.iter(f"{_A}blip"):
                    out += self._image(blip.get(f"{_R}embed"))
        properties = node.find(f"{_W}rPr")
        for tag, own in (("b", _on(properties, "b")), ("i", _on(properties, "i")), ("sup", properties is not None and _value(properties.find(f"{_W}vertAlign")) == "superscript")):
            out = f"<{tag}>{out}</{tag}>" if own and out else out
        return out

    def _image(self, link: str | None) -> str:
        target = self.targets.get(link)
        mime = _TYPES.get((target or "").rpartition(".")[2].lower())
        if not mime:
            return ""
        data = self.files.read("word/" + target.removeprefix("/word/"))
        return f'<img src="data:{mime};base64,{base64.b64encode(data).decode()}"/>'

    def runs(self, node: ET.Element) -> str:
        return "".join(self.run(x) if x.tag == f"{_W}r" else self.runs(x) for x in node if x.tag in (f"{_W}r", f"{_W}hyperlink", f"{_W}smartTag", f"{_W}ins", f"{_W}sdt", f"{_W}sdtContent"))

    def block(self, node: ET.Element) -> tuple[str | None, str]:
        """The list that a paragraph belongs to, and its HTML."""
        if node.tag == f"{_W}tbl":
            rows = "".join("<tr>" + "".join("<td>" + "<br/>".join(self.runs(p) for p in cell.iter(f"{_W}p")) + "</td>" for cell in row.findall(f"{_W}tc")) + "</tr>" for row in node.iter(f"{_W}tr"))
            return None, f"<table>{rows}</table>"
        properties = node.find(f"{_W}pPr")
        name = (_value(properties.find(f"{_W}pStyle")) if properties is not None else None) or ""
        text, key = self.runs(node), name.replace(" ", "").lower()
        if m := re.fullmatch(r"heading([1-6])", key):
            return None, f"<h{m[1]}>{text}</h{m[1]}>"
        if key in ("title", "subtitle"):
            level = 1 if key == "title" else 2
            return None, f"<h{level}>{text}</h{level}>"
        if key in ("quote", "intensequote"):
            return None, f"<blockquote><p>{text}</p></blockquote>"
        number = _value(properties.find(f"{_W}numPr/{_W}numId")) if properties is not None else None
        return (number, f"<li>{text}</li>") if number not in (None, "0") else (None, f"<p>{text}</p>")

    def html(self) -> str:
        made = [self.block(x) for x in self.body if x.tag in (f"{_W}p", f"{_W}tbl")]
        out = []
        for number, group in groupby(made, key=lambda x: x[0]):
            inner = "".join(text for _, text in group)
            tag = "ol" if self.ordered.get(number) else "ul"
            out.append(inner if number is None else f"<{tag}>{inner}</{tag}>")
        notes = ""
        for kind, key in self.used:
            note = next((x for x in self.notes[kind] if _value(x, "id") == key), None) if self.notes[kind] is not None else None
            text = " ".join(self.runs(p) for p in note.iter(f"{_W}p")) if note is not None else ""
            notes += f'<li id="{kind}note-{key}">{text} <a href="#{kind}note-ref-{key}">↑</a></li>'
        return "".join(out) + (f"<ol>{notes}</ol>" if notes else "")


def docx_to_html(content: bytes) -> str:
    return _Word(content).html()


ship(__name__)
