import os

import builders as b
import pytest
from pyspark.sql import functions as F

from quire import api, ocr
from quire.sources import files
from quire.sources.extract import extract
from quire.streaming.convert import convert_stream

THREE = [(18, 30, "年度报告"), (18, 52, "甲方与乙方在此约定以下条目。"), (18, 74, "合计 37 件，共 412.50 元")]
DOCX = b.office({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body &amp; more</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a&lt;</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = b.office({"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
PPTX = b.office({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<sld><sp><nvPr><ph type="title"/></nvPr><p><r><t>T</t></r></p></sp><sp><p><r><t>line</t></r></p></sp></sld>'})
LINES = [(50, 700 - 15 * i, f"Line {i} of the text layer, long enough.") for i in range(6)]


def files_df(spark, docs):
    d = spark.createDataFrame([(k, bytearray(v), len(v), i) for i, (k, v) in enumerate(docs.items())], "path string, content binary, length bigint, ord int")
    return files.with_kind(d)


def run(spark, docs, *a, **k):
    return {r["path"]: (r["markdown"], r["error"]) for r in api.convert(files_df(spark, docs), *a, **k).collect()}


def test_kinds(spark):
    docs = {"a": b"%PDF-1.7 x", "b": b.ofd([]), "c": DOCX, "d": b"\xd0\xcf\x11\xe0zzzz", "e": b"%P"}
    assert {r["path"]: r["kind"] for r in files_df(spark, docs).collect()} == {"a": "pdf", "b": "ofd", "c": "other", "d": "other", "e": None}


def test_batch_is_single(spark):
    # columns whose lines begin at other places each: where they all begin alike, the page is a table
    two = [(60 + 12 * (i == 3), 700 - 20 * i, f"left {i} words") for i in range(5)] + [(360 + 12 * (i == 3), 700 - 20 * i, f"right {i} words") for i in range(5)]
    docs = {
        "t.ofd": b.ofd(["".join(b.ofd_text(*t) for t in THREE)]),
        "w.ofd": b.ofd([b.ofd_text(20, 35, "kept line") + b.ofd_text(20, 60, "turned", "0.7 0.7 -0.7 0.7 0 0")]),
        "l.pdf": b.pdf([LINES, [(50, 700, "1.2 Heading here")]]),
        "plain.pdf": b.pdf([LINES], packed=False),
        "two.pdf": b.pdf([two]),
        "d.docx": DOCX, "x.xlsx": XLSX, "p.pptx": PPTX,
        "bad.pdf": b"%PDF-1.5 garbage without any object",
        "enc.pdf": b.pdf([LINES]) + b"trailer << /Encrypt 9 0 R >>",
        "bad.docx": b"PK\x03\x04 broken", "old.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"0" * 99,
        "short.pdf": b"%P", "scan.pdf": b.pdf([[]]), "part.ofd": b.office({"OFD.xml": "<OFD><DocRoot>no.xml</DocRoot></OFD>"}),
    }
    got = run(spark, docs)
    assert got["t.ofd"][0] == "\n".join(t for _, _, t in THREE)
    assert got["w.ofd"][0] == "kept line"
    assert got["l.pdf"][0] == "\n".join(t for _, _, t in LINES) + "\n\n### 1.2 Heading here"
    assert got["plain.pdf"][0] == "\n".join(t for _, _, t in LINES)
    assert [x.split()[0] for x in got["two.pdf"][0].split("\n")] == ["left"] * 5 + ["right"] * 5
    assert got["d.docx"][0] == "## Head\n\nBody & more\n\n<table><tr><td>a&lt;</td><td></td></tr></table>"
    assert got["x.xlsx"][0] == "## One\n\n<table><tr><td>x</td><td></td><td>3</td></tr></table>"
    assert got["p.pptx"][0] == "## T\n\nline"
    kinds = {k: e["kind"] for k, (_, e) in got.items() if e}
    assert kinds == {"bad.pdf": "malformed", "enc.pdf": "encrypted", "bad.docx": "malformed", "old.doc": "unsupported", "short.pdf": "io", "scan.pdf": "runtime", "part.ofd": "missingPart"}
    assert run(spark, {"two.pdf": docs["two.pdf"]})["two.pdf"] == got["two.pdf"]


def test_pdf_table_and_furniture(spark):
    pages = []
    for p in range(1, 6):
        pages.append([(50, 780, "Yearbook of the office")] + [(50, 700 - 20 * i, f"page {p} line {i} is some text here") for i in range(4)])
    table = [(x, 700 - 30 * i, t) for i, row in enumerate((("ID", "Name", "Sum"), ("1", "aaaaaaaaaa", "10000000"), ("2", "bbbbbbbbbb", "20000000"), ("3", "cccccccccc", "30000000"))) for x, t in zip((50, 200, 400), row)]
    two = [(x, 700 - 30 * i, t) for i, row in enumerate((("ID", "Name"), ("1", "Alice"), ("2", "Bob"), ("3", "Carol"))) for x, t in zip((50, 300), row)]
    # a header that moves by less than a hundredth of the page is one all the same
    moved = [[(50, 780 + 0.3 * p, "Yearbook of the office")] + pages[p][1:] for p in range(5)]
    got = run(spark, {"a.pdf": b.pdf(pages), "b.pdf": b.pdf([table]), "c.pdf": b.pdf([two]), "d.pdf": b.pdf(moved), "e.pdf": b.pdf([[(50, 780, "Running head"), *[(x, y - p, t if t in ("ID", "Name") else f"{t} {p}") for x, y, t in two]] for p in range(4)])})
    assert got["c.pdf"][0] == "<table><thead><tr><td>ID</td><td>Name</td></tr></thead><tbody><tr><td>1</td><td>Alice</td></tr><tr><td>2</td><td>Bob</td></tr><tr><td>3</td><td>Carol</td></tr></tbody></table>"
    assert "Yearbook" not in got["d.pdf"][0] and "page 5 line 3" in got["d.pdf"][0]
    assert "Running" not in got["e.pdf"][0] and got["e.pdf"][0].count("<tr><td>ID</td>") == 1 and got["e.pdf"][0].count("Alice") == 4
    assert "Yearbook" not in got["a.pdf"][0] and "page 3 line 2" in got["a.pdf"][0]
    assert got["b.pdf"][0].startswith("<table><thead><tr><td>ID</td><td>Name</td><td>Sum</td></tr></thead>")


def test_last_page_tables(spark):
    docs = {"two.pdf": b.pdf([LINES, [(50, 700, "Last page of the text layer.")]]), "none.pdf": b.pdf([LINES]), "t.ofd": b.ofd([b.ofd_text(20, 35, "kept line")])}
    probed = spark.createDataFrame([("two.pdf", " | a | b |\n"), ("none.pdf", " \u3000\n"), ("t.ofd", "| no |"), ("gone.pdf", "| x |")], "path string, markdown string")
    got, plain = run(spark, docs, last_tables=probed), run(spark, docs)
    assert got["none.pdf"] == plain["none.pdf"] and got["t.ofd"] == plain["t.ofd"] and set(got) == set(docs)
    text, found = plain["two.pdf"][0], got["two.pdf"][0]
    assert found.count("| a | b |") == 1 and found.replace("| a | b |", "").split() == text.split()


def test_engine_and_retry(spark):
    box = lambda t, y, c: {"x_min": 10.0, "x_max": 90.0, "y_min": float(y), "y_max": y + 10.0, "text": t, "confidence": c}
    rec = {("tiny", "s.pdf", 1): [box("bad", 10, 0.2)], ("small", "s.pdf", 1): [box("b)", 10, 0.9), box("good", 30, 0.9)], ("tiny", "i.ofd", 0): [box("scan", 10, 0.9)]}
    docs = {"s.pdf": b.pdf([[]]), "i.ofd": b.ofd(['<ImageObject ID="1" Boundary="0 0 9 9"/>'])}
    img = spark.createDataFrame([("s.pdf", 1, bytearray(b"x")), ("i.ofd", 0, bytearray(b"x"))], "path string, page_no int, image binary")
    off = ocr.recognise_gated(img, ocr.RecordedEngine(rec))
    assert sorted(r["text"] for r in off.collect()) == ["bad", "scan"]
    on = run(spark, docs, api.Request(quality_route=True), engine=ocr.RecordedEngine(rec), images=img)
    assert on["s.pdf"][0] == "b) good" and on["i.ofd"][0] == "scan"
    assert ocr.probe_tier(img.where("path = 's.pdf'"), ocr.RecordedEngine(rec), "medium") == "small"
    assert ocr.model_specs(spark).count() == 3


def counting(log, results):
    """An engine that writes down each page that it sees; some fail. Its class is local, so it is sent by value."""

    class Counting:
        def load(self, tier, layout):
            return tier

        def predict(self, model, pages):
            if len(pages) > 1 and any(p["path"] == "f.pdf" for p in pages):
                raise ValueError("one of several")
            for p in pages:
                if p["path"] == "f.pdf":
                    raise ValueError("no such page")
                with open(os.path.join(log, f"{model}-{p['path']}-{p['page_no']}"), "a") as f:
                    f.write("x")
            return [results.get((model, p["path"], p["page_no"]), []) for p in pages]

    return Counting()


def region(t, x, y, w=80, c=0.9):
    return {"x_min": float(x), "x_max": float(x + w), "y_min": float(y), "y_max": y + 10.0, "text": t, "confidence": c}


def element(kind, x0, x1, y0, y1, order=None, text=None):
    return {"x_min": float(x0), "x_max": float(x1), "y_min": float(y0), "y_max": float(y1), "element_type": kind, "order_index": order, "text": text}


def test_recognised_pages(spark, tmp_path):
    """The whole chain: order of blocks, headings by titles, margins and tables left out, one inference a page and tier, failing pages."""
    page = {
        "regions": [region("second block", 10, 100), region("Annual plan", 10, 20), region("page head", 10, 2), region("in the table", 10, 205), region("first block", 10, 50), region("b)", 10, 62, 8), region("item text", 10, 74)],
        "elements": [element("text", 0, 400, 45, 58, 2), element("text", 0, 400, 60, 70, 3), element("text", 0, 400, 71, 95, 4), element("text", 0, 400, 96, 150, 5), element("paragraph_title", 0, 400, 15, 40, 1, "Annual plan"), element("header", 0, 400, 0, 14), element("table", 0, 400, 200, 215)],
        "tables": [element("table", 0, 400, 200, 215, text="<html><body><table><tr><td>1</td></tr></table></body></html>")],
    }
    cells = [region(t, x, y, 60) for y, row in ((10, ("ID", "Name")), (40, ("1", "first")), (70, ("2", "second"))) for x, t in zip((10, 300), row)]
    image = {"regions": cells, "elements": [element("image", 0, 400, 0, 100)]}
    rec = {("tiny", "a.pdf", 1): page, ("tiny", "a.pdf", 2): image, ("tiny", "a.pdf", 3): image, ("small", "a.pdf", 1): page, ("tiny", "g.ofd", 0): [region("drawn", 10, 10)]}
    rec |= {("tiny", "t.pdf", 1): {"regions": [region("seen", 10, 10)], "elements": [element("table", 0, 90, 0, 30)]}, ("tiny", "u.pdf", 1): {"regions": [region("not used", 10, 10)]}}
    ragged = [(x + 30 * (i % 2) * (x > 50), 700 - 30 * i, f"{t}{i}") for i in range(4) for x, t in zip((50, 200, 400), "abc")]
    docs = {"a.pdf": b.pdf([[], [], []]), "f.pdf": b.pdf([[]]), "g.ofd": b.ofd(['<ImageObject ID="1" ResourceID="7" Boundary="0 0 9 9"/>'], {"7": b"pixels"}), "t.pdf": b.pdf([ragged]), "u.pdf": b.pdf([ragged])}
    img = spark.createDataFrame([("a.pdf", k, bytearray(b"x")) for k in (1, 2, 3)] + [("f.pdf", 1, bytearray(b"x")), ("t.pdf", 1, bytearray(b"x")), ("u.pdf", 1, bytearray(b"x"))], "path string, page_no int, image binary")
    log = tmp_path / "log"
    log.mkdir()
    got = run(spark, docs, api.Request(quality_route=True), engine=counting(str(log), rec), images=img)
    grid = "<table><thead><tr><td>ID</td><td>Name</td></tr></thead><tbody><tr><td>1</td><td>first</td></tr><tr><td>2</td><td>second</td></tr><tr><td>1</td><td>first</td></tr><tr><td>2</td><td>second</td></tr></tbody></table>"
    assert got["a.pdf"][0] == f"## Annual plan\n\nfirst block\nb) item text\nsecond block\n\n\n<table><tr><td>1</td></tr></table>\n\n{grid}"
    assert got["f.pdf"][0] is None and got["f.pdf"][1]["kind"] == "runtime" and got["f.pdf"][1]["page"] == 1 and "no such page" in got["f.pdf"][1]["detail"]
    assert got["g.ofd"][0] == "drawn" and got["t.pdf"][0] == "seen" and "a0" in got["u.pdf"][0] and "not used" not in got["u.pdf"][0]
    assert {n: os.path.getsize(log / n) for n in os.listdir(log)} == dict.fromkeys(["tiny-a.pdf-1", "tiny-a.pdf-2", "tiny-a.pdf-3", "tiny-g.ofd-0", "tiny-t.pdf-1", "tiny-u.pdf-1"], 1)


def test_engines_are_told_apart(spark, tmp_path):
    img = spark.createDataFrame([("p", 1, bytearray(b"x"))], "path string, page_no int, image binary")
    assert [ocr.recognise(img, counting(str(tmp_path), {}), "tiny").count(), ocr.identity(counting("", {})) == ocr.identity(counting("", {}))] == [0, False]
    e = counting("", {})
    assert ocr.identity(e) == ocr.identity(e) and ocr.chunk_size(10, 4) == 3 and ocr.intra_threads(spark, 3) == 3 and ocr.locate("m.bin", "NOT_SET_ANYWHERE") == "m.bin"


def test_pdf_forms_filters_widths():
    from quire.sources import pdf as P

    def doc(contents, forms="", fonts="/F1 3 0 R"):
        return b"%PDF-1.4\n" + f"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [4 0 R] >> endobj 3 0 obj << /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [700 300] >> endobj 4 0 obj << /Type /Page /Resources << /Font << {fonts} >> /XObject << /X 6 0 R >> >> /Contents 5 0 R >> endobj {forms}".encode() + contents

    text = b"BT /F1 10 Tf 1 0 0 1 10 20 Tm (AAB) Tj ET"
    plain = doc(b"5 0 obj << /Length 9 >>\nstream\n" + text + b"\nendstream endobj")
    ((_, items, _),) = P.extract(plain)
    assert items == [(10, 20, pytest.approx(17.0), 10, "AAB")]
    import base64
    import zlib

    for name, data in (("ASCIIHexDecode", text.hex().encode() + b">"), ("ASCII85Decode", base64.a85encode(text) + b"~>"), ("RunLengthDecode", bytes([len(text) - 1]) + text + b"\x80")):
        assert list(P.extract(doc(f"5 0 obj << /Filter /{name} >>\nstream\n".encode() + data + b"\nendstream endobj")))[0][1] == items
    w = 8
    rows = [text[i : i + w].ljust(w) for i in range(0, len(text), w)]
    up = b"".join(b"\x02" + bytes((a - c) & 255 for a, c in zip(r, q)) for r, q in zip(rows, [bytes(w), *rows]))
    assert list(P.extract(doc(b"5 0 obj << /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 8 >> >>\nstream\n" + zlib.compress(up) + b"\nendstream endobj")))[0][1] == items
    form = "6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F1 3 0 R >> >> >>\nstream\nBT /F1 10 Tf 1 0 0 1 10 20 Tm (AAB) Tj ET /X Do\nendstream endobj "
    ((_, items, _),) = P.extract(doc(b"5 0 obj << /Length 9 >>\nstream\nq /X Do Q\nendstream endobj", form))
    assert [(round(x), t) for x, _, _, _, t in items] == [(110, "AAB")]
    assert P._lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_folder_stream_and_sink(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.pdf").write_bytes(b.pdf([LINES]))
    (src / "sub" / "b.ofd").write_bytes(b.ofd([b.ofd_text(20, 35, "x")]))
    (src / "~$c.docx").write_bytes(DOCX)
    (src / "d.txt").write_bytes(b"none")
    d = api.convert_folder(spark, str(src))
    assert [(os.path.basename(r["path"]), r["ord"], r["error"]) for r in d.orderBy("ord").collect()] == [("a.pdf", 0, None), ("b.ofd", 1, None)]
    w = api.write_markdown(d, str(tmp_path / "md"), f"file:{src}/")
    assert w.where("ok").count() == 2 and (tmp_path / "md" / "sub" / "b.md").read_text() == "x"
    q = convert_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("markdown").isNotNull()).count() == 2


@pytest.mark.parametrize("data", [b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", b"%PDF" + bytes(range(256)) * 20])
def test_odd_pdfs(spark, data):
    assert [r["error"]["kind"] for r in extract(files_df(spark, {"x": data})).where("what = 'error'").collect()] == ["malformed"]
