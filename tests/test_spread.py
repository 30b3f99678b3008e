"""Steps by page run in as many tasks as the input calls for, and give the same."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import staging
from quire.operators import blocks as B

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["reading_order", "order_within_block", "vertical_columns", "tabular_pages", "line_gutters", "block_claim_first", "leftover_regions"])
def test_tasks_grow(spark, monkeypatch, name):
    run = entry.queries()[name]
    want = sorted(map(repr, run(spark, SF).collect()))
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(staging, "PART_BYTES", size // 20)
    d = run(spark, SF)
    assert d.rdd.getNumPartitions() >= math.ceil(size / (size // 20))
    assert sorted(map(repr, d.collect())) == want


def test_parts_count_files_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    d = spark.read.parquet(path)
    n = staging.parts(d)
    assert n == staging.parts(d, d.selectExpr("id + 1 as id"), spark.createDataFrame([(1,)], "id int")) == 1
    monkeypatch.setattr(staging, "PART_BYTES", 100)
    (a,) = staging.spread(["id"], d)
    assert a.rdd.getNumPartitions() == staging.parts(d) > 8
    named = a.select(F.col("id").alias("doc"))
    assert staging.spread(["doc"], named)[0] is named  # it is there already
    assert staging.spread(["id"], d.select((F.col("id") % 3).alias("id")))[0].rdd.getNumPartitions() == staging.parts(d)


def test_claim(spark):
    """Nulls and points on an edge; the least rank of several boxes; a page without boxes."""
    r = spark.createDataFrame([(1, 0, 0.0, 10.0, 5.0), (1, 1, 20.0, 40.0, 5.0), (1, 2, None, 4.0, 5.0), (2, 0, 0.0, 10.0, 5.0), (None, 0, 0.0, 10.0, 5.0)], "p int, region_idx int, x_min double, x_max double, y_min double")
    b = spark.createDataFrame([(1, 7, 0.0, 50.0, 0.0, 9.0), (1, 3, 5.0, 5.0, 5.0, 5.0), (1, 1, None, 50.0, 0.0, 9.0), (None, 1, 0.0, 50.0, 0.0, 9.0)], "p int, block_rank int, x_min double, x_max double, y_min double, y_max double")
    got = {(x["p"], x["region_idx"]): x["block_rank"] for x in B.claim(r, b, ["p"]).collect()}
    assert got == {(1, 0): 3, (1, 1): 7, (1, 2): None, (2, 0): None, (None, 0): None}
