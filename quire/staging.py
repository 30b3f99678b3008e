"""Tables between the steps of a long plan, in the folder that all executors share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_open: list[list[str]] = []

#: Bytes of input files for each task of a step by page; some 400,000 regions.
PART_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's; a folder of this machine only where neither is set and the master runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = at.get()
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write and read back: what several later steps use is computed once, plans stay small, and a lost executor loses nothing.

    The table goes when its ``scope`` ends, and with the application at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(*dfs: DataFrame) -> int:
    """Tasks for steps over these, one for each ``PART_BYTES`` of the files that they read (each file counts once)."""
    sizes: dict[int, int] = {}
    for d in dfs:
        leaves = d._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            size = int(str(leaf.stats().sizeInBytes()))
            if size < 1 << 60:  # more is Spark's word for unknown
                sizes[leaf.semanticHash()] = size
    return math.ceil(sum(sizes.values()) / PART_BYTES)


def _placed(df: DataFrame, keys: list[str]) -> int:
    """Number of parts into which the plan already brings the rows by some of ``keys``; 0 if it doesn't."""
    plan = df._jdf.queryExecution().analyzed()
    out = plan.output()
    own = {out.apply(i).exprId().id() for i in range(out.size()) if out.apply(i).name() in keys}
    while True:
        kind = plan.getClass().getSimpleName()
        if kind == "RepartitionByExpression":
            by = plan.partitionExpressions()
            return plan.numPartitions() if by.size() and all(by.apply(i).getClass().getSimpleName() == "AttributeReference" and by.apply(i).exprId().id() in own for i in range(by.size())) else 0
        if kind == "Project":  # a key may be another name of what the rows went by
            made = plan.projectList()
            for e in (made.apply(i) for i in range(made.size())):
                if e.getClass().getSimpleName() == "Alias" and e.exprId().id() in own and e.child().getClass().getSimpleName() == "AttributeReference":
                    own.add(e.child().exprId().id())
        if kind in ("Project", "Filter", "Window", "SubqueryAlias"):
            plan = plan.child()
        elif kind == "Join":
            plan = plan.left()
        else:
            return 0


def spread(keys: list[str], *dfs: DataFrame) -> tuple[DataFrame, ...]:
    """The same rows, those of a page in one task, in as many parts as the input calls for.

    Spark makes a fixed number of parts or joins small ones until the cores are
    busy, so that a task's sorts grow with the input. Where that number does,
    nothing is changed. Tables that are joined by page come in one call: parts
    of equal number meet without another shuffle.
    """
    spark = dfs[0].sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(_placed(d, keys) for d in dfs)
    if not n:
        n = parts(*dfs)
        if n <= min(usual, spark.sparkContext.defaultParallelism):
            return dfs
    n = max(n, usual)
    return tuple(d if _placed(d, keys) == n else d.repartition(n, *keys) for d in dfs)


def gathered(keys: list[str], **kinds: DataFrame) -> DataFrame:
    """One row for each page: (keys, an array for each kind). Each kind has its rows as a column of its name beside the keys.

    What belongs to a page comes together in one aggregation, so no table is
    sorted or joined for the steps within a page, and their memory is that of
    a page.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), spread(keys, *kinds.values()))
    return every.groupBy(*keys).agg(*[F.collect_list(k).alias(k) for k in kinds])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within are removed at its end: use or write what was returned before that."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds ``out``, the row's place from 0 in the order of ``by``: counted within ranges of it, in parallel, of which only the sizes meet in one task."""
    d = cut(df.repartitionByRange(by).withColumn("__p", F.spark_partition_id()))
    sizes = d.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sizes.select("__p", before.alias("__base")), "__p")
    return d.withColumn(out, (F.col("__base") + F.row_number().over(W.partitionBy("__p").orderBy(by)) - 1).cast("int")).drop("__p", "__base")
