"""Steps within a page that is one array against the table forms, on odd pages; and plans that bring a page's rows together once."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import staging
from quire.functions import text as X
from quire.operators import blocks as B
from quire.operators import columns as C
from quire.operators import grid as D
from quire.operators import lines as L

SF = "/root/testdata/sf0.001"
COLUMNS = "p int, region_idx int, x_min double, x_max double, y_min double, y_max double, text string"


def odd_pages(spark, n=60):
    rng, rows = random.Random(7), []
    for p in range(n):
        for i in range(rng.randrange(1, 14)):
            x, y, tall = rng.choice([0.0, 0.0, 5.0, 300.0, 310.0, 600.0]), rng.choice([0.0, -0.0, 20.0, 40.0, 55.0, 300.0, None if p % 9 == 0 else 70.0]), rng.random() < 0.4
            w = rng.choice([3.0, 4.0]) if tall else rng.choice([80.0, 250.0, 900.0])
            rows.append((p, i, None if p % 11 == 0 and i == 2 else x, x + w, y, None if y is None else y + (60.0 if tall else 10.0), rng.choice(["a", "1.2 b", "# c", "　", "", "Abstract", "tail", None])))
    return spark.createDataFrame(rows, COLUMNS)


def paged(d):
    return d.groupBy("p").agg(F.collect_list(F.struct(*[c for c in d.columns if c != "p"], L.is_head(F.col("text")).alias("head"))).alias("r"))


@pytest.mark.parametrize("in_block", [False, True])
def test_ordered(spark, in_block):
    d = odd_pages(spark)
    want = {(r["p"], r["pos"]): r["region_idx"] for r in C.reading_order(d, ["p"], in_block).collect()}
    got = paged(d).select("p", F.posexplode(C.ordered(F.col("r"), in_block)).alias("i", "o")).select("p", (F.col("i") + 1).alias("pos"), "o.region_idx")
    assert {(r["p"], r["pos"]): r["region_idx"] for r in got.collect()} == want
    assert any(r["split"] is not None for r in C.with_column_split(d, ["p"]).collect())


def test_joined(spark):
    d = odd_pages(spark)
    want = sorted(map(repr, map(tuple, L.paragraphs(d.withColumnRenamed("text", "line"), ["p"], "region_idx", "y_min").collect())))
    made = L.joined(F.sort_array("r"))
    got = paged(d).select("p", F.explode(made).alias("o")).select("p", F.col("o.pos") - 1, "o.line")
    assert sorted(map(repr, map(tuple, got.collect()))) == want


def test_tall_texts(spark):
    d = odd_pages(spark)
    want = {}
    for r in C.vertical_paragraphs(d, ["p"]).orderBy("p", "col_no").collect():
        want.setdefault(r["p"], []).append(r["text"])
    width = F.greatest(F.array_max(F.transform("r", lambda x: x["x_max"])), F.lit(0))
    got = paged(d).select("p", C.tall_texts(F.filter("r", lambda x: C.is_tall(x, width))).alias("t"))
    assert {r["p"]: r["t"] for r in got.collect() if r["t"]} == want and len(want) > 10


def test_strip(spark):
    chars = [chr(c) for c in [*range(0x300), *range(0x1670, 0x1690), *range(0x1800, 0x1810), *range(0x2000, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF]]
    texts = [f"{a}{a}x{a}y{a}" for a in chars] + ["", " ", "\r\n", " a\n", "\n a b　\x85", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    white = r"[\p{IsWhite_Space}]+"
    both = d.select(X.strip(F.col("t")), F.regexp_replace("t", f"^{white}|{white}$", ""), X.lstrip(F.col("t")), F.regexp_replace("t", f"^{white}", ""), X.rstrip(F.col("t")), F.regexp_replace("t", f"{white}$", "")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in both)


def test_is_title(spark):
    d = spark.createDataFrame([(t,) for t in ("1 a", "1.", "2.1 b", " abstract ", "（一）x", "（一）", "三、y", "x", "", None, "References", "(3) z")], "t string")
    assert all(r[0] == r[1] for r in d.select(X.is_title(F.col("t")), X.title_level(F.col("t")).isNotNull()).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["fallback_order", "order_structure", "block_assembly"])
def test_brought_together_once(spark, name):
    """Regions are numbered, then come together with their layout: no join or sort of the table besides."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Window [") == 1
    assert plan.count("Join ") == plan.count("Join Cross")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["image_tables", "grid_reconstruct", "grid_structure", "cell_assignment"])
def test_grids_brought_together_once(spark, name):
    """No table is staged, and a page's regions come together once after their numbering."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Window [") == 1 and "Join " not in plan
    assert plan.count("Relation [") <= 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["fallback_order", "cell_assignment"])
def test_parts_by_input(spark, monkeypatch, name):
    """Pages are gathered in the parts that the input calls for, without another shuffle into a fixed number."""
    monkeypatch.setattr(staging, "PART_BYTES", os.path.getsize(f"{SF}/lineitem.parquet") // 20)
    d = entry.queries()[name](spark, SF)
    assert d.rdd.getNumPartitions() >= 20
    assert "ENSURE_REQUIREMENTS" not in d._jdf.queryExecution().executedPlan().toString()


def test_place(spark):
    """The same as rows, cells, columns and nearest columns made one after the other."""
    rng = random.Random(3)
    rows = [(p, i, float(x), float(x + 40), float(y), float(y + 10), rng.choice(["a", " b ", "", "c1"])) for p in range(40) for i, (x, y) in enumerate((rng.choice([0, 2, 45, 100, 210]), rng.choice([0, 3, 20, 40, 60])) for _ in range(rng.randrange(1, 14)))]
    d = spark.createDataFrame(rows, COLUMNS)
    c = D.cells(D.row_groups(d, ["p"], F.lit(8.0)), ["p"], F.lit(6.0))
    want = sorted(map(repr, map(tuple, D.assign_cells(c, D.column_centers(c, D.column_count(c, ["p"]), ["p"]), ["p"]).collect())))
    assert sorted(map(repr, map(tuple, D.place(d, ["p"], F.lit(8.0), F.lit(6.0)).collect()))) == want and len(want) > 50


def test_grid_nulls(spark):
    """Null tops and sides neither fail nor join rows."""
    rows = [(1, i, x, x + 50 if i != 3 else None, y, y + 10 if y is not None else None, "t") for i, (x, y) in enumerate([(0.0, 0.0), (300.0, 0.0), (0.0, 20.0), (300.0, 20.0), (0.0, None), (300.0, None)])]
    g = D.reconstruct(spark.createDataFrame(rows, COLUMNS), ["p"]).first()
    assert g["cols"] == 2 and len(g["rows"]) == 1


def test_empty_and_missing(spark):
    """A page without layout, one without regions, one whose boxes are all noise, and null keys."""
    r = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0, 5.0, "alone"), (3, 0, 0.0, 10.0, 0.0, 5.0, "in noise"), (3, 1, 0.0, 10.0, 90.0, 95.0, "out"), (None, 0, 0.0, 10.0, 0.0, 5.0, "null")], COLUMNS)
    kind = "p int, el_idx int, element_type string, order_index int, x_min double, x_max double, y_min double, y_max double"
    e = spark.createDataFrame([(2, 0, "text", 1, 0.0, 9.0, 0.0, 9.0), (3, 0, "footer", None, 0.0, 10.0, 0.0, 50.0), (3, 1, "header", None, 0.0, 10.0, 390.0, 400.0)], kind)
    b = spark.createDataFrame([(3, 0, 1, None), (3, 1, 2, [0])], "p int, rb_idx int, order_index int, element_indices array<int>")
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    assert rows(B.assemble(r, e, ["p"])) == sorted(map(repr, [(1, 2147483647, 1, "alone"), (3, 2147483647, 1, "out"), (None, 2147483647, 1, "null")]))
    assert rows(B.fallback_order(r, e, b, ["p"])) == sorted(map(repr, [(1, 0, 1, "alone"), (3, 0, 1, "in noise"), (3, 0, 2, "out"), (None, 0, 1, "null")]))
    assert rows(B.order_structure(r, e, b, ["p"])) == sorted(map(repr, [(1, 1, "alone"), (3, 1, "in noise"), (3, 2, "out"), (None, 1, "null")]))
