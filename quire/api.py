"""Files to Markdown: one row for each document, with its text or its error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as X
from .ocr import OcrEngine, recognise, recognise_gated
from .operators import columns as C
from .operators import furniture as U
from .operators import grid as D
from .operators import lines as L
from .operators import pages as P
from .operators import routing as R
from .operators.recognised import contents
from .sources import files as files_
from .sources.extract import extract
from .staging import cut, scope

KEYS = ["path", "page_no"]


@dataclass(frozen=True)
class Request:
    dpi: int = S.DPI
    tier: str = "tiny"
    layout: str = "doc"
    quality_route: bool = False
    ofd_force_ocr: bool = False
    pdf_force_ocr: bool = False
    furniture_ratio: float = S.FURNITURE_RATIO


def _pdf_regions(items: DataFrame, ratio: float) -> DataFrame:
    """Items without furniture as regions. Furniture is told by the place on the page as the file has it, y from the foot."""
    y = -F.col("y_min")
    t = items.select("path", "page_no", F.col("idx").alias("item_idx"), F.col("x_min").alias("x"), (F.col("x_max") - F.col("x_min")).alias("width"), y.alias("y"), (F.col("y_max") - F.col("y_min")).alias("height"), "text")
    t = U.strip_furniture(U.binned(t, "path", "page_no"), "path", "page_no", "text", ["x_bin", "y_bin"], ratio)
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    return t.select(*KEYS, F.col("item_idx").alias("region_idx"), x.alias("x_min"), (x + w).alias("x_max"), (-y).alias("y_min"), (h - y).alias("y_max"), "text")


def _pdf_lines(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions to lines in reading order: the items by line, and (path, page_no, pos, y_min, text)."""
    h = r.groupBy(*KEYS).agg(D.upper_median(F.collect_list(F.greatest(F.col("y_max") - F.col("y_min"), F.lit(1.0)))).alias("__h"))
    rows = D.row_groups(r.join(h, KEYS), KEYS, F.greatest(F.col("__h") * 0.5, F.lit(1.0)))
    at = cut(rows).select(*KEYS, F.col("row_no").alias("line_no"), F.col("region_idx").alias("item_idx"), F.col("x_min").alias("x"), (F.col("x_max") - F.col("x_min")).alias("width"), "y_min", "y_max", "text")
    split = C.split_lines(at, C.gutter(at, KEYS), KEYS)
    item = F.struct("x", "item_idx", "width", "text")
    g = split.groupBy(*KEYS, "line_no", "part").agg(F.array_sort(F.collect_list(item)).alias("i"), F.min("x").alias("x_min"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.min("y_min").alias("y_min"), F.greatest(F.max("y_max"), F.min("y_min") + 1).alias("y_max"))
    start = F.struct(F.lit("").alias("s"), F.lit(None).cast("double").alias("e"))

    def join(s, v):
        gap = F.coalesce(v["x"] - s["e"] > 1.0, F.lit(False)) & ~s["s"].endswith(" ") & ~v["text"].startswith(" ") & s["s"].rlike("[A-Za-z0-9.,;:!?)]$") & v["text"].rlike("^[A-Za-z0-9(]")
        return F.struct(F.concat(s["s"], F.when(gap, F.lit(" ")).otherwise(F.lit("")), v["text"]).alias("s"), (v["x"] + v["width"]).alias("e"))

    lines = g.select(*KEYS, (F.col("line_no") * 2 + F.col("part")).alias("region_idx"), "x_min", "x_max", "y_min", "y_max", X.strip(F.aggregate("i", start, join)["s"]).alias("text")).where("text <> ''")
    return at, C.reading_order(lines, KEYS).select(*KEYS, "pos", "y_min", "text")


def _titled(lines: DataFrame) -> DataFrame:
    """STR-2, TTL-2 on (path, page_no, pos, text)."""
    m = L.merge_hyphens(lines.select(*KEYS, "pos", F.col("text").alias("line")), KEYS, "pos")
    return m.select(*KEYS, "pos", X.title_prefixed(X.half_width(F.col("line"))).alias("text"))


def _page_markdown(rows: DataFrame, grids: DataFrame, source: str) -> DataFrame:
    """Recognised pages each rendered by itself, as one block of a text-layer page."""
    html = grids.select(*KEYS, F.lit("ocr").alias("source"), F.lit("grid").alias("kind"), F.lit(0).cast("long").alias("pos"), D.to_html(grids).alias("text"))
    one = P.render_pages(rows.unionByName(html), KEYS)
    return one.select(*KEYS, F.lit(source).alias("source"), F.lit("pre_rendered").alias("kind"), F.lit(0).cast("long").alias("pos"), X.strip(F.col("segment")).alias("text"))


def convert(files: DataFrame, request: Request = Request(), engine: OcrEngine | None = None, images: DataFrame | None = None, last_tables: DataFrame | None = None) -> DataFrame:
    """(path, ord, markdown, error) for each row of (path, kind, content), see ``sources.files.list_documents``; ord by path unless given.

    ``engine`` recognises pages that have no usable text, and pages of a text
    PDF that look like tables; ``images`` (path, page_no, image) are theirs.
    OFD pages that are one picture bring it along. ``last_tables`` (path,
    markdown) are what a table extractor found on the last pages of text PDFs;
    they follow the page's lines where it shows those. Without an engine a PDF
    without usable text is an error of kind runtime. A document that can't be
    read is an error row, and never fails the job. Contents are read once.
    """
    rows = cut(extract(files))
    kinds = rows.where("what = 'file'").select("path", F.col("text").alias("kind"))
    items, lines = rows.where("what = 'item'"), rows.where("what = 'line'")
    pages = rows.where("what = 'page'").select(*KEYS, "n_images")
    bad = rows.where("what = 'error'").select("path", F.col("error").cast(S.ERROR).alias("error"))
    if engine is not None:
        own = rows.where("what = 'image'").select(*KEYS, "image")
        images = own if images is None else images.select(*KEYS, "image").unionByName(own.join(images.select(*KEYS).distinct(), KEYS, "left_anti"))

    # PDF: is there a text layer at all, and a sound one?
    health = R.shallow_health(items, "path", ["page_no", "idx"])
    per_page = R.deep_health(R.text_health(items, KEYS).select(*KEYS, "garbled"), "path")
    pdf = kinds.where("kind = 'pdf'").join(bad.select("path"), "path", "left_anti").join(health, "path", "left").join(per_page, "path", "left")
    false = F.lit(False)
    route = R.decide(F.col("n_chars").isNull(), F.coalesce("garbled", false), F.coalesce("deep_garbled", false), false, false, F.lit("doc"))
    pdf = cut(pdf.select("path", F.when(F.lit(request.pdf_force_ocr), "ocr_doc").otherwise(route).alias("route")))
    text_pdf = pdf.where("route = 'text_layer'").select("path")
    scans = pdf.where("route <> 'text_layer'").select("path")

    regions = cut(_pdf_regions(items.join(text_pdf, "path", "left_semi"), request.furniture_ratio))
    pdf_grids = cut(D.reconstruct(regions, KEYS))
    at, body = _pdf_lines(regions)
    pdf_body = _titled(body).withColumn("source", F.lit("pdf"))

    # OFD: page by page
    o = R.text_health(lines, KEYS)
    ofd = pages.join(kinds.where("kind = 'ofd'"), "path", "left_semi").join(o, KEYS, "left")
    ofd = cut(ofd.select(*KEYS, R.ofd_page_route(F.coalesce("n_chars", F.lit(0)), F.col("n_images"), F.coalesce("garbled", false), F.lit(request.ofd_force_ocr)).alias("route")))
    text_pages = ofd.where("route = 'text'") if engine is not None else ofd
    ol = lines.join(text_pages, KEYS, "left_semi").select(*KEYS, F.col("idx").alias("region_idx"), *[F.col(c).cast("double").alias(c) for c in ("x_min", "x_max", "y_min", "y_max")], "text")
    ordered = cut(C.reading_order(ol, KEYS))
    two = ordered.where("split is not null").select(*KEYS).distinct()
    ofd_grids = D.reconstruct(cut(ol.join(two, KEYS, "left_anti")), KEYS)
    ofd_body = _titled(ordered.select(*KEYS, "pos", "text")).withColumn("source", F.lit("ofd"))

    text_grids = cut(pdf_grids.unionByName(ofd_grids))
    out = pdf_body.unionByName(ofd_body).select(*KEYS, "source", F.lit("body").alias("kind"), F.col("pos").cast("long").alias("pos"), "text")
    if last_tables is not None:
        probed = R.last_page_tables(last_tables, regions, "path", "page_no").join(out.where("source = 'pdf'").select(*KEYS).distinct(), KEYS, "left_semi")
        out = out.unionByName(probed.select(*KEYS, F.lit("pdf").alias("source"), F.lit("pre_rendered").alias("kind"), F.lit(0).cast("long").alias("pos"), "text"))
    grids, waiting = text_grids, None
    if engine is not None:
        # RTE-14: pages that look like tables and have no grid; only those that recognition finds a table on change
        doubt = R.suspicious_pages(at, images, KEYS).join(pdf_grids.select(*KEYS), KEYS, "left_anti")
        looked = cut(recognise(cut(R.render_subset(images, doubt, KEYS)), engine, request.tier, request.layout))
        table = R.confirmed_tables(looked.where("what = 'element'"), KEYS)
        sure = _page_markdown(*contents(cut(looked.join(table, KEYS, "left_semi")), KEYS), "pdf")
        # pages without usable text
        want = images.join(scans, "path", "left_semi").unionByName(R.render_subset(images, ofd.where("route <> 'text'"), KEYS))
        got = cut(recognise_gated(cut(want), engine, request.tier, request.layout, request.quality_route))
        scanned, found = contents(got.join(scans, "path", "left_semi"), KEYS)
        drawn = _page_markdown(*contents(got.join(ofd.select("path").distinct(), "path", "left_semi"), KEYS), "ofd")
        out = P.page_content(KEYS, cut(sure.unionByName(drawn)), out).unionByName(scanned)
        grids = text_grids.unionByName(found)
        # a document of which no page could be recognised says why
        failed = got.where("what = 'error'").groupBy("path").agg(F.min(F.struct("page_no", "error")).alias("e"))
        waiting = failed.join(got.where("what <> 'error'").select("path").distinct(), "path", "left_anti").select("path", F.struct(F.lit("runtime").alias("kind"), F.lit("ocr").alias("stage"), F.col("e.page_no").alias("page"), F.col("e.error").alias("detail")).alias("error"))

    # RTE-16/17: a grid takes the place of a text page's other content
    out = out.join(text_grids.select(*KEYS), KEYS, "left_anti")
    merged = P.merge_tables(grids.withColumn("page_pos", F.col("page_no")), pages.withColumn("page_pos", F.col("page_no")).select("path", "page_pos"), "path", "page_pos")
    merged = merged.withColumn("html", D.to_html(merged))
    ocr = scans.select("path", F.lit(True).alias("scan"))
    source = F.when(F.col("scan"), "ocr").when(F.col("kind") == "pdf", "pdf").otherwise("ofd")
    html = merged.join(kinds, "path").join(ocr, "path", "left").select("path", F.col("page_pos").alias("page_no"), source.alias("source"), F.lit("grid").alias("kind"), F.lit(0).cast("long").alias("pos"), F.col("html").alias("text"))
    segments = P.render_pages(out.unionByName(html), KEYS).withColumn("pos", F.lit(0))
    md = cut(P.render_documents(segments, "path", "page_no", "pos"))
    # a document with pages but nothing on them is an empty text, unless it waits for recognition
    blank = pages.select("path").distinct().join(md, "path", "left_anti")
    if engine is None:
        blank = blank.join(scans, "path", "left_anti")
    else:
        blank = blank.join(scans.join(got.select("path"), "path", "left_anti"), "path", "left_anti").join(waiting.select("path"), "path", "left_anti")
        bad = bad.unionByName(waiting.join(md, "path", "left_anti").select("path", F.col("error").cast(S.ERROR).alias("error")))
    other = rows.where("what = 'markdown'").select("path", F.col("text").alias("markdown"))
    ok = md.unionByName(blank.select("path", F.lit("").alias("markdown"))).unionByName(other).withColumn("error", F.lit(None).cast(S.ERROR))
    slots = files if "ord" in files.columns else kinds
    return R.fill_slots(slots, ok.unionByName(bad.select("path", F.lit(None).cast("string").alias("markdown"), "error")), "path")


def convert_folder(spark: SparkSession, folder: str, request: Request = Request(), engine: OcrEngine | None = None, images: DataFrame | None = None) -> DataFrame:
    """All supported files below a folder, by path."""
    return convert(files_.list_documents(spark, folder), request, engine, images)


def convert_bytes(spark: SparkSession, content: bytes, request: Request = Request()) -> tuple[str | None, dict | None]:
    """One document: (markdown, error)."""
    with scope(spark):
        r = convert(files_.from_bytes(spark, content), request).first()
    return r["markdown"], r["error"].asDict() if r["error"] else None


def write_markdown(outcomes: DataFrame, folder: str, input_prefix: str = "") -> DataFrame:
    """SNK-2: writes each document's Markdown below a folder all executors see; returns (path, out, ok).

    Files are written by the tasks that hold them, each under a temporary name
    first, so a task that is run again leaves whole files.
    """
    import os

    def run(batches):
        for pdf in batches:
            for p, o, m in zip(pdf["path"], pdf["out"], pdf["markdown"]):
                if m is not None:
                    at = os.path.join(folder, o)
                    os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
                    part = f"{at}.{os.getpid()}.tmp"
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(m)
                    os.replace(part, at)
            yield pdf.assign(ok=pdf["markdown"].notna())[["path", "out", "ok"]]

    d = outcomes.select("path", files_.output_name(F.lit(input_prefix), F.col("path")).alias("out"), "markdown")
    return d.mapInPandas(run, "path string, out string, ok boolean")
