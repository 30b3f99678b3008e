"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) % 1000003 as bigint))")).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node of its component.

    Nodes are of any orderable type. Null ends and loops are left out, repeated
    edges count once, and an empty table gives an empty result. A round is two
    aggregations with map-side combining and two joins, which AQE may split
    where a hub is skewed; its result is written to the shared folder, so the
    plan doesn't grow and a lost executor costs one round. The number of
    rounds is about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    e, path = cut(e)
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u > v").distinct()
        e2, path2 = cut(small)
        drop(spark, path)
        e, path, now = e2, path2, _mark(e2)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
