"""Recognition engines: the protocol, an engine that plays back recorded results, and confidence-gated runs."""

from __future__ import annotations

import os
import uuid
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import routing as R
from .staging import cut

#: what: region, element (of the layout), table (its HTML as text), block (of elements) or error (why as text).
RESULT = "path string, page_no int, what string, idx int, x_min float, x_max float, y_min float, y_max float, text string, confidence float, element_type string, order_index int, element_indices array<int>, error string"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = {"regions": "region", "elements": "element", "tables": "table", "blocks": "block"}
_engines: dict = {}


class OcrEngine(Protocol):
    """Recognises pages. It is sent to the executors; ``load`` is called once in each Python worker for a tier and layout."""

    def load(self, tier: str, layout: str): ...

    def predict(self, model, pages: list[dict]) -> list:
        """For each page (path, page_no, image) its regions as dicts of the columns from x_min on, or a dict of lists of such: regions, elements, tables, blocks."""
        ...


def identity(engine: OcrEngine) -> str:
    """Tells engines apart, also those of one class; made once and sent along."""
    if getattr(engine, "identity", None) is None:
        engine.identity = uuid.uuid4().hex
    return engine.identity


class RecordedEngine:
    """Plays back regions by (tier, path, page_no)."""

    def __init__(self, results: dict):
        self.results = results
        self.identity = uuid.uuid4().hex

    def load(self, tier: str, layout: str):
        return tier

    def predict(self, model, pages):
        return [self.results.get((model, p["path"], p["page_no"]), []) for p in pages]


def clear_cache() -> None:
    """OCR-5: forget the models of this worker."""
    _engines.clear()


def chunk_size(n: int, threads: int) -> int:
    """MTH-6: pages of one inference when n are shared by so many threads."""
    return max(1, -(-n // max(1, threads)))


def intra_threads(spark: SparkSession, explicit: int | None = None) -> int:
    """OCR-7: threads of one inference: the environment's, else the given ones, else the cores of a task."""
    for v in (os.environ.get("QUIRE_INTRA_THREADS"), explicit, spark.conf.get("spark.task.cpus", "1")):
        if v and str(v).isdigit() and int(v) > 0:
            return int(v)
    return 1


def locate(name: str, variable: str, folders: tuple[str, ...] = ()) -> str:
    """SRC-19: where a resource is: the folder or file that the environment names, else the first folder that has it, else its bare name."""
    given = os.environ.get(variable)
    if given:
        return os.path.join(given, name) if os.path.isdir(given) else given
    return next((p for f in folders if os.path.exists(p := os.path.join(f, name))), name)


def recognise(pages: DataFrame, engine: OcrEngine, tier: str = "tiny", layout: str = "doc", batch: int = 8) -> DataFrame:
    """OCR-1..4: rows (see ``RESULT``) of (path, page_no, image) pages.

    A batch that fails is tried page by page, and a page that fails is an error
    row (OCR-3). Whoever uses the result more than once stages it: inference
    would run again.
    """
    who = identity(engine)

    def rows(page, got):
        if isinstance(got, list):
            got = {"regions": got}
        for k, what in _KINDS.items():
            for i, r in enumerate(got.get(k) or []):
                yield {"path": page["path"], "page_no": page["page_no"], "what": what, "idx": i, **r}

    def predict(part):
        key = (who, tier, layout)
        if key not in _engines:
            _engines[key] = engine.load(tier, layout)
        got = engine.predict(_engines[key], part)
        if len(got) != len(part):
            raise RuntimeError(f"engine gave {len(got)} results for {len(part)} pages")
        return [r for p, g in zip(part, got) for r in rows(p, g)]

    def safe(part):
        try:
            return predict(part)
        except Exception as e:  # a page never fails the job
            if len(part) == 1:
                return [{"path": part[0]["path"], "page_no": part[0]["page_no"], "what": "error", "idx": 0, "error": f"{type(e).__name__}: {e}"}]
            return [r for p in part for r in safe([p])]

    def run(frames):
        for pdf in frames:
            for s in range(0, len(pdf), batch):
                out = pd.DataFrame(safe(pdf.iloc[s : s + batch].to_dict("records")), columns=_COLUMNS)
                for c in ("order_index", "idx", "page_no"):
                    out[c] = out[c].astype("Int32")
                for c in ("text", "element_type", "element_indices", "error"):
                    out[c] = pd.Series([v if isinstance(v, (str, list, tuple)) else None for v in out[c]], dtype=object)
                yield out

    return pages.mapInPandas(run, RESULT)


def recognise_gated(pages: DataFrame, engine: OcrEngine, tier: str = "tiny", layout: str = "doc", auto: bool = False) -> DataFrame:
    """RTE-3, RTE-9/10, RTE-12: the same; with ``auto`` the first page decides the tier of all, and pages of low confidence are recognised once more, a tier up, and replaced where that gave anything.

    Each page is recognised once a tier: results are staged, also the probe's.
    """
    if not auto:
        return recognise(pages, engine, tier, layout)
    tier, seen = _probe(pages, engine, tier, layout)
    if seen is not None and tier == "tiny":
        rest = pages.join(seen.select("path", "page_no").distinct(), ["path", "page_no"], "left_anti")
        first = cut(seen.unionByName(recognise(rest, engine, tier, layout)))
    else:
        first = cut(recognise(pages, engine, tier, layout))
    up = dict((m[0], m[3]) for m in S.MODELS)[tier]
    if up is None:
        return first
    q = R.page_quality(pages.select("path", "page_no").join(first.where("what = 'region'"), ["path", "page_no"], "left"), ["path", "page_no"]).where("needs_upgrade")
    again = cut(recognise(R.render_subset(pages, q, ["path", "page_no"]), engine, up, layout))
    new = again.where("what <> 'error'").select("path", "page_no").distinct()
    return first.join(new, ["path", "page_no"], "left_anti").unionByName(again.where("what <> 'error'"))


def model_specs(spark: SparkSession) -> DataFrame:
    """D-16: the model tiers as a dimension table."""
    return spark.createDataFrame(S.MODELS, S.MODEL_SPEC)


def _probe(pages: DataFrame, engine: OcrEngine, tier: str, layout: str) -> tuple[str, DataFrame | None]:
    """The tier, and what the smallest one found on the first page; without that if it failed."""
    first = pages.orderBy("path", "page_no").limit(1)
    seen = cut(recognise(first, engine, "tiny", layout))
    if not seen.where("what = 'error'").isEmpty():
        return tier, None
    bad = R.page_quality(first.select("path", "page_no").join(seen.where("what = 'region'"), ["path", "page_no"], "left"), ["path", "page_no"]).select("needs_upgrade").collect()
    return (tier, None) if not bad else ("small" if bad[0][0] else "tiny", seen)


def probe_tier(pages: DataFrame, engine: OcrEngine, tier: str, layout: str = "doc") -> str:
    """RTE-9/10: tier of a whole batch, by the first page recognised with the smallest one; the given tier if that fails."""
    return _probe(pages, engine, tier, layout)[0]


def has_region(results: DataFrame) -> DataFrame:
    """Pages that were recognised at all."""
    return results.groupBy("path", "page_no").agg(F.count("*").alias("n"))
