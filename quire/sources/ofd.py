"""Positioned text of OFD packages (zip of XML), with the standard library."""

from __future__ import annotations

import io
import math
import posixpath
import zipfile
from xml.etree import ElementTree as ET

from .. import schema as S


class OfdError(Exception):
    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind, self.detail = kind, detail


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _all(e, name: str):
    return [x for x in e.iter() if _name(x) == name]


def _kids(e, *names: str):
    return [x for x in e if _name(x) in names]


def _numbers(s: str | None) -> list[float]:
    return [float(v) for v in (s or "").split()]


IDENTITY = [float(i % 3 == 0) for i in range(4)] + [0.0] * 2


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise OfdError("malformed", f"container: {e}") from e
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def xml(self, path: str):
        real = self.names.get(path.lstrip("/").lower())
        if real is None:
            raise OfdError("missingPart", path)
        try:
            return ET.fromstring(self.zip.read(real))
        except (ET.ParseError, RuntimeError, zipfile.BadZipFile) as e:
            raise OfdError("malformed", f"{path}: {e}") from e

    def pages(self):
        """(body, path of the content) of each page in order."""
        root = next((n for k, n in self.names.items() if k == "ofd.xml" or k.endswith("/ofd.xml")), None)
        if root is None:
            raise OfdError("missingPart", "OFD.xml")
        base = posixpath.dirname(root)
        for body, r in enumerate(_all(self.xml(root), "DocRoot")):
            doc = (r.text or "").strip()
            doc = doc.lstrip("/") if doc.startswith("/") else posixpath.join(base, doc)
            tree = self.xml(doc)
            here = posixpath.dirname(doc)
            shared = [_at(here, x.text) for kind in ("PublicRes", "DocumentRes") for x in _all(tree, kind)]
            for p in _all(tree, "Page"):
                loc = p.get("BaseLoc") or ""
                if loc:
                    yield body, _at(here, loc), here, shared

    def media(self, resource: str, files: list[str]) -> bytes | None:
        """JN-8: bytes of the medium of that id, of the first resource file that has it; null if it has none that can be read."""
        for f in files:
            try:
                res = self.xml(f)
            except OfdError:
                continue
            base = _at(posixpath.dirname(f), res.get("BaseLoc") or "")
            for m in _all(res, "MultiMedia"):
                if m.get("ID") == resource:
                    name = next((x.text for x in m if _name(x) == "MediaFile" and x.text), "")
                    real = self.names.get(_at(base, name).lower())
                    try:
                        return self.zip.read(real) if real else None
                    except (RuntimeError, zipfile.BadZipFile):
                        return None
        return None


def _at(folder: str, loc: str | None) -> str:
    loc = (loc or "").strip()
    return loc.lstrip("/") if loc.startswith("/") else posixpath.join(folder, loc).rstrip("/")


def objects(layer) -> tuple[list[str], int]:
    """SRC-16: resource ids of a layer's image objects, and the number of its other objects; blocks are opened."""
    images, other = [], 0
    for o in layer:
        kind = _name(o)
        if kind in ("PageBlock", "Layer", "Content"):
            more, n = objects(o)
            images += more
            other += n
        elif kind == "ImageObject":
            images.append(o.get("ResourceID") or "")
        else:
            other += 1
    return images, other


def is_off_axis(ctm: list[float]) -> bool:
    if len(ctm) != 6:
        return False
    r = math.degrees(math.atan2(ctm[1], ctm[0])) % 90.0
    return min(r, 90.0 - r) > S.WATERMARK_DEGREES + 1e-9


def _number(s: str | None) -> float:
    try:
        return float(s)
    except (TypeError, ValueError):
        return 0.0


def text_lines(layer):
    """(x0, x1, y0, y1, text) of text objects, blocks within blocks; watermarks and blanks left out. Also counts images."""
    lines, images = [], 0
    for o in layer:
        kind = _name(o)
        if kind in ("PageBlock", "Layer", "Content"):
            more, n = text_lines(o)
            lines += more
            images += n
        elif kind == "ImageObject":
            images += 1
        elif kind == "TextObject":
            ctm = _numbers(o.get("CTM"))
            if is_off_axis(ctm):
                continue
            codes = _kids(o, "TextCode")
            text = "".join(t for _, t in sorted(((_number(c.get("X")), c.text) for c in codes if c.text is not None), key=lambda v: v[0]))
            if not text.strip():
                continue
            b = (_numbers(o.get("Boundary")) + [0.0] * 4)[:4]
            if b[2] > 0 and b[3] > 0:
                lines.append((b[0], b[0] + b[2], b[1], b[1] + b[3], text))
                continue
            m = ctm if len(ctm) == 6 else IDENTITY
            lx, ly = (_number(codes[0].get("X")), _number(codes[0].get("Y"))) if codes else (0.0, 0.0)
            x, y = b[0] + m[0] * lx + m[2] * ly + m[4], b[1] + m[1] * lx + m[3] * ly + m[5]
            lines.append((x, x, y, y + 1.0, text))
    return lines, images


def extract(data: bytes):
    """(page_no from 0, lines, images, picture); a page that can't be read is passed over and takes no number.

    The picture is that of a page which is one image and nothing else.
    """
    pkg = Package(data)
    n = 0
    for _, path, here, shared in list(pkg.pages()):
        try:
            root = pkg.xml(path)
        except OfdError:
            continue
        content = _kids(root, "Content") or ([root] if _name(root) == "Content" else [])
        lines, images, found, other = [], 0, [], 0
        for c in content:
            more, k = text_lines(c)
            lines += more
            images += k
            ids, rest = objects(c)
            found += ids
            other += rest
        picture = None
        if len(found) == 1 and not other:
            picture = pkg.media(found[0], [*shared, *[_at(here, x.text) for x in _all(root, "PageRes")]])
        yield n, lines, images, picture
        n += 1
