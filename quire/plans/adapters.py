"""Relations of the layout model made from the driver's tables, each for Spark and, as a CTE, for DuckDB.

The expressions are the same text in both engines; what the tables lack
(numbered lines, markers, full-width letters) is put in by expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: CTE of document lines.
LINES = "l as (select doc_id, cast(unnest(range(len(a))) as integer) as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents))"

NUMBERED = "case line_no % 8 when 0 then line_no || ' ' || line when 1 then '2.1 ' || line when 2 then '（一）' || line when 3 then '三、' || line when 4 then '(3) ' || line when 5 then '# ' || line when 6 then '  1.2.3.4.5.6 x' else line end"
HYPHENED = "case line_no % 4 when 1 then line || '-' when 2 then lower(line) when 3 then line || '- ' else line end"
MARKED = "case line_no % 11 when 0 then 'b)' when 1 then ' 52 ' when 2 then '  ' || line when 3 then '（十二）' when 4 then '-' when 5 then '# t' when 6 then '馆' when 7 then 'c.' when 8 then '7' when 9 then '12345' else line end"
FULLWIDTH = "translate(line, 'aeT0.', 'ａｅＴ０．')"


def document_lines(spark: SparkSession, sf_dir: str, expr: str = "line") -> DataFrame:
    d = L.explode_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "line_no", F.expr(expr).alias("line"))


_WIDTH = "(case when l_quantity >= 48 and l_partkey % 2 = 0 then 640 else 50 + l_quantity end)"
_X = "(l_partkey % 2) * 500 + (l_suppkey % 8) * 5"
_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
REGION_COLUMNS = [
    "l_orderkey as doc_id",
    f"cast(row_number() over ({_ORDER}) as integer) as region_idx",
    f"cast({_X} as double) as x_min",
    f"cast({_X} + {_WIDTH} as double) as x_max",
    "cast(l_linenumber * 20 + cast(l_quantity as integer) % 7 as double) as y_min",
    "cast(l_linenumber * 20 + cast(l_quantity as integer) % 7 + 10 as double) as y_max",
    "l_returnflag || l_linestatus as text",
]
#: CTE of positioned regions, one page an order.
REGIONS = f"r as (select {', '.join(REGION_COLUMNS)} from lineitem)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's rows in one task, as their numbering and all that follows by page want them."""
    (d,) = spread(["l_orderkey"], table(spark, sf_dir, "lineitem"))
    return d


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).selectExpr(*REGION_COLUMNS)


#: CTE of layout boxes, three on each page, and noise boxes.
_BOX = "(values (1, 0.0, 300.0, 0.0, 62.0), (2, 0.0, 1000.0, 41.0, 103.0), (3, 480.0, 560.0, 0.0, 200.0)) as v(block_rank, x_min, x_max, y_min, y_max)"
_NOISE = "(values (400.0, 700.0, 0.0, 66.0), (0.0, 120.0, 110.0, 400.0)) as v(x_min, x_max, y_min, y_max)"


def _cast(cols: str) -> str:
    return ", ".join(f"cast({c} as {'integer' if c == 'block_rank' else 'double'}) as {c}" for c in cols.split())


BOXES = f"b as (select o_orderkey as doc_id, {_cast('block_rank x_min x_max y_min y_max')} from orders, {_BOX})"
NOISE = f"z as (select o_orderkey as doc_id, {_cast('x_min x_max y_min y_max')} from orders, {_NOISE})"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql(f"select {_cast('block_rank x_min x_max y_min y_max')} from {_BOX}")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).crossJoin(v)


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql(f"select {_cast('x_min x_max y_min y_max')} from {_NOISE}")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).crossJoin(v)


_GRID = "case when role = 'assistant' or length(text) % 3 > 0 then 2 + length(text) % 2 end"
PAGES = f"p as (select conv_id as doc_id, cast(turn as integer) as page_pos, cast({_GRID} as integer) as cols, text from conversations)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "cast(turn as integer) as page_pos", f"cast({_GRID} as integer) as cols", "text")


_ITEM = [
    "l_orderkey as doc_id",
    "cast(l_linenumber as integer) as line_no",
    f"cast(row_number() over ({_ORDER}) as integer) as item_idx",
    f"cast((l_partkey % 3) * 200 + (l_suppkey % 2) * 3 as double) as x",
    "cast(40 + l_quantity as double) as width",
]
ITEMS = f"t as (select {', '.join(_ITEM)} from lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).selectExpr(*_ITEM)
