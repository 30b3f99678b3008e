"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, else the context's.

    Only a master that runs in this process, as in tests, may do without: there
    a folder of this machine is set. On a cluster a missing setting is an error.
    """
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


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, outlive: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` into the shared folder and read it back; lineage ends there. Also its path, for ``drop``.

    The table goes when its ``scope`` ends (with ``outlive``, the one around that), and with the application at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    at, fs = _file(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(at)
    if len(_open) > outlive:
        _open[-1 - outlive].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``cut`` that nothing will read any more."""
    at, fs = _file(spark, path)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)
    for paths in _open:
        if path in paths:
            paths.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that operators stage within are removed at its end: write what they return before that."""
    _open.append([])
    try:
        yield
    finally:
        for path in list(_open[-1]):
            drop(spark, path)
        _open.pop()


class Frame:
    """A table whose columns are c0, c1, ... for as long as an operator works on it, so that no name can clash with its own.

    ``self["name"]`` is a column by its name: as written, or else the only one
    that differs in case only.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        if name not in self.names:
            same = [n for n in self.names if n.lower() == name.lower()]
            if len(same) != 1:
                raise ValueError(f"no column {name} in {self.names}")
            name = same[0]
        return f"c{self.names.index(name)}"

    def __getitem__(self, name: str) -> Column:
        return F.col(self.at(name))

    def close(self, df: DataFrame, **new: Column) -> DataFrame:
        """The columns of the input, then the new ones; an input column that bears a new one's name (in any case) gives way."""
        low = {k.lower() for k in new}
        keep = [i for i, n in enumerate(self.names) if n.lower() not in low]
        return df.select(*[F.col(f"c{i}") for i in keep], *[v.alias(f"n{i}") for i, v in enumerate(new.values())]).toDF(*[self.names[i] for i in keep], *new)


def few_rows(spark: SparkSession, most: int = 2000) -> None:
    """Hands Python ``most`` rows at a time from here on, unless the session has a bound of its own: texts are long, and a worker holds a batch more than once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns, by name; extra columns of any kind are left behind."""
    f = Frame(df)
    return f.df.select(*[f[n] for n in names]).toDF(*names)


def arrow(f, kind: str):
    """``f`` (Arrow arrays to one) as a column function. It counts as nondeterministic, or a filter over it would run it twice."""
    return F.arrow_udf(f, kind).asNondeterministic()
