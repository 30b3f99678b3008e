"""Small documents made in memory."""

from __future__ import annotations

import io
import zipfile
import zlib


def ofd(pages: list[str], media: dict[str, bytes] | None = None) -> bytes:
    """A package whose pages have these objects (XML), with media by id."""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("OFD.xml", "<OFD><DocBody><DocRoot>D/Doc.xml</DocRoot></DocBody></OFD>")
        for k, v in (media or {}).items():
            z.writestr(f"D/Res/m{k}.png", v)
        z.writestr("D/Public.xml", '<Res BaseLoc="Res">' + "".join(f'<MultiMedias><MultiMedia ID="{k}"><MediaFile>m{k}.png</MediaFile></MultiMedia></MultiMedias>' for k in media or {}) + "</Res>")
        z.writestr("D/Doc.xml", "<Document><CommonData><PublicRes>Public.xml</PublicRes></CommonData><Pages>" + "".join(f'<Page ID="{i}" BaseLoc="Pages/P{i}/Content.xml"/>' for i in range(len(pages))) + "</Pages></Document>")
        for i, p in enumerate(pages):
            z.writestr(f"D/Pages/P{i}/Content.xml", f"<Page><Content><Layer>{p}</Layer></Content></Page>")
    return b.getvalue()


def ofd_text(x: float, y: float, text: str, ctm: str = "", width: float = 200) -> str:
    turn = f' CTM="{ctm}"' if ctm else ""
    return f'<TextObject ID="1" Boundary="{x - 2} {y - 6} {width} 10"{turn}><TextCode X="2" Y="6">{text}</TextCode></TextObject>'


def pdf(pages: list[list[tuple[float, float, str]]], packed: bool = True) -> bytes:
    """Text at places (from the bottom left) on each page."""
    out, at = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")

    def add(n: int, body: bytes):
        at.append(out.tell())
        out.write(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    add(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    add(2, f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /MediaBox [0 0 600 800] >>".encode())
    add(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    for i, items in enumerate(pages):
        ops = "BT /F1 10 Tf " + " ".join("1 0 0 1 {} {} Tm ({}) Tj".format(x, y, t.replace("(", "\\(").replace(")", "\\)")) for x, y, t in items) + " ET"
        data = zlib.compress(ops.encode("latin-1")) if packed else ops.encode("latin-1")
        add(4 + 2 * i, f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        add(5 + 2 * i, f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream")
    out.write(b"trailer << /Root 1 0 R >>\n%%EOF\n")
    return out.getvalue()


def office(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()
