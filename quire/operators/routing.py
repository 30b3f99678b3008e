"""Text health, routing decisions and confidence-gated retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..staging import numbered


def text_health(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """FLT-2/5: (keys, n_chars, n_garbled, garbled) over all texts of a group."""
    c = F.col(text)
    g = df.groupBy(*keys).agg(F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(X.garbled(c)), F.lit(0)).alias("n_garbled"))
    return g.withColumn("garbled", X.is_garbled(F.col("n_chars"), F.col("n_garbled")))


def shallow_health(items: DataFrame, doc: str, order: list[str], text: str = "text", limit: int = S.GARBLED_ITEMS) -> DataFrame:
    """FLT-3: the same over each document's first 4000 items."""
    rn = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    return text_health(items.withColumn("__rn", rn).where(F.col("__rn") <= limit), [doc], text)


def deep_health(pages: DataFrame, doc: str = "doc_id", flag: str = "garbled") -> DataFrame:
    """FLT-4: (doc, n_pages, n_bad, deep_garbled)."""
    g = pages.groupBy(doc).agg(F.count("*").alias("n_pages"), F.count_if(F.col(flag)).alias("n_bad"))
    return g.withColumn("deep_garbled", (F.col("n_bad") >= S.DEEP_PAGES) & (F.col("n_bad") * 100 >= F.col("n_pages") * S.DEEP_PERCENT))


def decide(empty: Column, shallow: Column, deep: Column, few: Column, image: Column, scope: Column) -> Column:
    """RTE-1: text_layer, ocr_page or ocr_doc. Low confidence isn't asked: it never routes."""
    ocr = empty | shallow | deep | (few & image)
    return F.when(~F.coalesce(ocr, F.lit(False)), "text_layer").when(scope == "page", "ocr_page").otherwise("ocr_doc")


def route_document(kind: Column, has_text: Column, force: Column, error: Column) -> Column:
    """RTE-4/5: done_error, done_text, ocr or per_doc; an error wins, even over force."""
    return F.when(error.isNotNull(), "done_error").when(kind != "pdf", "per_doc").when(has_text & ~force, "done_text").otherwise("ocr")


def ofd_page_route(text_len: Column, images: Column, garbled: Column, force: Column) -> Column:
    """RTE-8: text, ocr_full (garbled, drawn at once) or ocr_pending."""
    ocr = garbled | ((text_len < S.OFD_TEXT_MIN) & (images > 0))
    return F.when(force | (ocr & ~garbled), "ocr_pending").when(garbled, "ocr_full").otherwise("text")


def page_quality(regions: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """AGG-4, RTE-3: (keys, mean_confidence, needs_upgrade); a page without any confidence needs one."""
    g = regions.groupBy(*keys).agg(F.avg(confidence).alias("mean_confidence"))
    return g.withColumn("needs_upgrade", F.coalesce(F.col("mean_confidence") < S.CONFIDENCE, F.lit(True)))


def next_tier(tier: Column) -> Column:
    """RTE-11"""
    return F.when(tier == "tiny", "small").when(tier == "small", "medium")


def merge_retry(results: DataFrame, retried: DataFrame, keys: list[str]) -> DataFrame:
    """RTE-12, JN-6: retried rows in the place of the old ones where there are any."""
    values = [c for c in results.columns if c not in keys]
    r = retried.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in values])
    j = results.join(r, keys, "left")
    return j.select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values], F.coalesce("__new", F.lit(False)).alias("retried"))


def single_image_pages(objects: DataFrame, keys: list[str], kind: str = "obj_type", text_allowed: bool = True) -> DataFrame:
    """SRC-15/16: (keys, direct): pages that are one image, whose pixels can be taken as they are."""
    c = F.col(kind)
    other = ~c.isin("image", "text") if text_allowed else c != "image"
    return objects.groupBy(*keys).agg(((F.count_if(c == "image") == 1) & (F.count_if(other) == 0)).alias("direct"))


def fill_slots(documents: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """JN-7: an outcome for every document, numbered by path where it has no number yet; one without result is a runtime error."""
    d = documents.select(key, "ord") if "ord" in documents.columns else numbered(documents.select(key), key, "ord")
    j = d.join(results.select(key, "markdown", "error"), key, "left")
    lost = F.struct(F.lit("runtime").alias("kind"), F.lit("convert").alias("stage"), F.lit(None).cast("int").alias("page"), F.lit("no result").alias("detail"))
    return j.select(key, "ord", "markdown", F.when(F.col("markdown").isNull() & F.col("error").isNull(), lost).otherwise(F.col("error")).alias("error"))


def render_subset(pages: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-14: the pages worth drawing, of those there are. The semi join comes before the expensive step, which so never sees another page."""
    return pages.join(wanted.select(*keys).distinct(), keys, "left_semi")


def suspicious_pages(items: DataFrame, available: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """SET-2: (keys) of the pages that look like tables (FLT-11) and are there."""
    from . import columns

    return columns.tabular_pages(items, keys, line).where("tabular").select(*keys).join(available.select(*keys).distinct(), keys, "left_semi")


def last_page_tables(probed: DataFrame, pages: DataFrame, doc: str, page: str, text: str = "markdown") -> DataFrame:
    """RTE-15: (doc, page, text): what a table probe found on each document's last page, for those that found anything."""
    last = pages.groupBy(doc).agg(F.max(page).alias(page))
    t = X.strip(F.col(text))
    return probed.select(doc, t.alias("__t")).where("__t <> ''").join(last, doc).select(doc, page, F.concat(F.lit("\n"), "__t", F.lit("\n")).alias("text"))


def confirmed_tables(elements: DataFrame, keys: list[str]) -> DataFrame:
    """RTE-14, AGG-14: (keys) of the recognised pages on which the layout has a table."""
    return elements.groupBy(*keys).agg(F.bool_or(F.col("element_type") == "table").alias("__t")).where("__t").select(*keys)


def document_errors(errors: DataFrame) -> DataFrame:
    """RTE-13: of (doc_id, page, error) only those of whole documents, which have no page."""
    return errors.where("page is null").select("doc_id", "error")


def error_text(stage: Column, page: Column, kind: Column, detail: Column) -> Column:
    """STR-8: ``[stage:pageN] kind: detail``."""
    shown = F.create_map(*[F.lit(v) for k, (t, _) in S.ERRORS.items() for v in (k, t)])
    return F.concat(F.lit("["), stage, F.when(page.isNotNull(), F.concat(F.lit(":page"), page.cast("string"))).otherwise(F.lit("")), F.lit("] "), F.element_at(shown, kind), F.lit(": "), detail)


def error_hint(kind: Column) -> Column:
    """Advice for an error kind."""
    hints = F.create_map(*[F.lit(v) for k, (_, h) in S.ERRORS.items() for v in (k, h)])
    return F.coalesce(F.try_element_at(hints, kind), F.lit(S.NO_HINT))
