"""Command line: ``python -m quire INPUT [-o OUTPUT]``; - reads one document from standard input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, api
from .operators import routing as R


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quire", description="Office documents to Markdown.")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--ocr-tier", choices=["tiny", "small", "medium"], default="tiny")
    p.add_argument("--ocr-layout", choices=["doc", "table"], default="doc")
    p.add_argument("--ofd-force-ocr", action="store_true")
    p.add_argument("--pdf-force-ocr", action="store_true")
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--dpi", type=int, default=100)
    p.add_argument("--quality-route", choices=["auto", "off"], default="off")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    req = api.Request(a.dpi, a.ocr_tier, a.ocr_layout, a.quality_route == "auto", a.ofd_force_ocr, a.pdf_force_ocr)
    if os.path.isdir(a.input):
        if not a.output:
            print("a folder needs --output", file=sys.stderr)
            return 1
        d = api.convert_folder(spark, a.input, req).cache()
        for r in d.where("error is not null").select("path", R.error_text(F.col("error.stage"), F.col("error.page"), F.col("error.kind"), F.col("error.detail")).alias("e"), R.error_hint(F.col("error.kind")).alias("h")).toLocalIterator():
            print(f"{r['path']}: {r['e']} ({r['h']})", file=sys.stderr)
        prefix = "file:" + os.path.abspath(a.input) + "/"
        n = {r["ok"]: r["count"] for r in api.write_markdown(d, a.output, prefix).groupBy("ok").count().collect()}
        print(f"{n.get(True, 0)} converted, {n.get(False, 0)} failed", file=sys.stderr)
        return 0
    data = sys.stdin.buffer.read() if a.input == "-" else open(a.input, "rb").read()
    md, err = api.convert_bytes(spark, data, req)
    if err:
        print(f"[{err['stage']}] {err['kind']}: {err['detail']}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(md)
    else:
        print(md)
    return 0


if __name__ == "__main__":
    sys.exit(main())
