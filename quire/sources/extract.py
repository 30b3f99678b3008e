"""All parsers behind one ``mapInArrow``: files in, positioned rows out. A failing document is an error row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from . import office, ofd, pdf

SCHEMA = "path string, what string, page_no int, idx int, x_min float, x_max float, y_min float, y_max float, text string, n_images int, image binary, error struct<kind:string,stage:string,page:int,detail:string>"
_ARROW = pa.schema(
    [("path", pa.string()), ("what", pa.string()), ("page_no", pa.int32()), ("idx", pa.int32()), *[(c, pa.float32()) for c in ("x_min", "x_max", "y_min", "y_max")], ("text", pa.string()), ("n_images", pa.int32()), ("image", pa.binary()), ("error", pa.struct([("kind", pa.string()), ("stage", pa.string()), ("page", pa.int32()), ("detail", pa.string())]))]
)


def _rows(path: str, kind: str | None, data: bytes):
    row = lambda what, **v: {"path": path, "what": what, **v}
    yield row("file", text=kind)
    try:
        if kind is None:
            yield row("error", error={"kind": "io", "stage": "detect", "page": None, "detail": "shorter than four bytes"})
        elif kind == "pdf":
            for page, items, images in pdf.extract(data):
                yield row("page", page_no=page, n_images=images)
                for i, (x, y, w, h, t) in enumerate(items):
                    yield row("item", page_no=page, idx=i, x_min=x, x_max=x + w, y_min=-y, y_max=-y + h, text=t)
        elif kind == "ofd":
            for page, lines, images, image in ofd.extract(data):
                yield row("page", page_no=page, n_images=images)
                if image is not None:
                    yield row("image", page_no=page, image=image)
                for i, (x0, x1, y0, y1, t) in enumerate(lines):
                    yield row("line", page_no=page, idx=i, x_min=x0, x_max=x1, y_min=y0, y_max=y1, text=t)
        else:
            yield row("markdown", text=office.to_markdown(data))
    except (pdf.PdfError, ofd.OfdError, office.OfficeError) as e:
        yield row("error", error={"kind": e.kind, "stage": "extract" if kind != "other" else "convert", "page": None, "detail": e.detail})
    except Exception as e:  # a bad document never fails the job
        yield row("error", error={"kind": "malformed", "stage": "extract", "page": None, "detail": f"{type(e).__name__}: {e}"})


def extract(files: DataFrame) -> DataFrame:
    """Rows of (path, kind, content): what is file (its kind as text), page, item (PDF), line (OFD), image (of an OFD page that is nothing else), markdown or error."""

    def run(batches):
        for b in batches:
            for p, k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rows = list(_rows(p, k, c.as_py() or b""))
                for s in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_pylist(rows[s : s + 20_000], schema=_ARROW)

    return files.select("path", "kind", "content").mapInArrow(run, SCHEMA)
