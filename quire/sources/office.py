"""Markdown of zip-based office files (docx, xlsx, pptx), with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET


class OfficeError(Exception):
    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind, self.detail = kind, detail


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(e) -> str:
    out = []
    for x in e.iter():
        k = _name(x)
        if k == "t":
            out.append(x.text or "")
        elif k == "tab":
            out.append("\t")
        elif k in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _table(rows: list[list[str]]) -> str:
    from html import escape

    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def _docx(z) -> str:
    body = next((x for x in ET.fromstring(z.read("word/document.xml")).iter() if _name(x) == "body"), None)
    out = []
    for p in body if body is not None else []:
        if _name(p) == "tbl":
            out.append(_table([[" ".join(filter(None, (_text(q) for q in c.iter() if _name(q) == "p"))) for c in r if _name(c) == "tc"] for r in p if _name(r) == "tr"]))
        elif _name(p) == "p" and (t := _text(p).strip()):
            style = next((_attr(s, "val") or "" for s in p.iter() if _name(s) == "pStyle"), "")
            m = re.fullmatch(r"(?i)heading\s*([1-6])|([1-6])", style)
            level = int(m[1] or m[2]) if m else 1 if style.lower() == "title" else 0
            bullet = any(_name(s) == "numPr" for s in p.iter())
            out.append("#" * level + " " * (level > 0) + "- " * (bullet and not level) + t)
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _xlsx(z) -> str:
    names = z.namelist()
    shared = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml")) if _name(s) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [_attr(s, "name") or "" for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _name(s) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for i, n in enumerate(sheets):
        rows = []
        for r in ET.fromstring(z.read(n)).iter():
            if _name(r) != "row":
                continue
            cells: dict[int, str] = {}
            for k, c in enumerate(x for x in r if _name(x) == "c"):
                v = next((x.text or "" for x in c if _name(x) == "v"), "")
                kind = c.get("t")
                v = shared[int(v)] if kind == "s" and v.isdigit() and int(v) < len(shared) else _text(c) if kind == "inlineStr" else v
                cells[_column(c.get("r") or "") if c.get("r") else k] = v
            rows.append([cells.get(j, "") for j in range(max(cells, default=-1) + 1)])
        width = max(map(len, rows), default=0)
        if width:
            out += [f"## {titles[i] if i < len(titles) else f'Sheet{i + 1}'}", _table([r + [""] * (width - len(r)) for r in rows])]
    return "\n\n".join(out)


def _pptx(z) -> str:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for n in slides:
        for shape in ET.fromstring(z.read(n)).iter():
            if _name(shape) != "sp":
                continue
            title = any(_name(x) == "ph" and x.get("type") in ("title", "ctrTitle") for x in shape.iter())
            lines = [t for p in shape.iter() if _name(p) == "p" and (t := _text(p).strip())]
            if lines:
                out.append("## " + " ".join(lines) if title else "\n".join(lines))
    return "\n\n".join(out)


def to_markdown(data: bytes) -> str:
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        if b"E\0n\0c\0r\0y\0p\0t\0e\0d\0P\0a\0c\0k\0a\0g\0e" in data:
            raise OfficeError("encrypted", "office file is encrypted")
        raise OfficeError("unsupported", "legacy office format")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            for part, f in (("word/document.xml", _docx), ("xl/workbook.xml", _xlsx), ("ppt/presentation.xml", _pptx)):
                if part in names:
                    return f(z)
    except (zipfile.BadZipFile, ET.ParseError, KeyError, RuntimeError) as e:
        raise OfficeError("malformed", str(e)) from e
    raise OfficeError("unsupported", "no known part")
