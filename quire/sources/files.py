"""Listing, detecting and naming document files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_temporary(path: Column) -> Column:
    """SRC-5"""
    name = F.regexp_extract(path, "[^/]+$", 0)
    return name.endswith(".tmp") | name.endswith(".crdownload") | name.startswith("~$")


def is_supported(path: Column) -> Column:
    """SRC-4"""
    return extension(path).isin(*S.SUPPORTED) & ~is_temporary(path)


def output_name(prefix: Column, path: Column) -> Column:
    """SNK-3: the path below ``prefix`` with the extension md; one that already has it gets it again."""
    rel = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    return F.when(rel.endswith(".md"), F.concat(rel, F.lit(".md"))).when(rel.rlike(r"[^/]\.[^./]*$"), F.regexp_replace(rel, r"\.[^./]*$", ".md")).otherwise(F.concat(rel, F.lit(".md")))


def magic(content: Column) -> Column:
    """pdf, zip or other by the first four bytes; null if there are fewer."""
    four = F.substring(content, 1, 4)
    return F.when(F.octet_length(content) < 4, F.lit(None).cast("string")).when(four == F.unhex(F.lit("25504446")), "pdf").when(four == F.unhex(F.lit("504B0304")), "zip").otherwise("other")


def _has_ofd(content: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return False
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                return any(n.upper() == "OFD.XML" or n.endswith("/OFD.xml") for n in z.namelist())
        except (zipfile.BadZipFile, ValueError, OSError):
            return False

    return content.map(one).astype(bool)


def with_kind(files: DataFrame) -> DataFrame:
    """SRC-1/2: adds kind (null: unreadable). One pass; only the bytes of zips leave the JVM, to be opened."""
    m = magic(F.col("content"))
    probe = F.pandas_udf(_has_ofd, "boolean")
    ofd = probe(F.when(m == "zip", F.col("content")))
    return files.withColumn("kind", F.when(m == "zip", F.when(ofd, "ofd").otherwise("other")).otherwise(m))


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-3: (path, content, length, kind) of the supported files below a folder.

    Spark's listing leaves out names that begin with a dot or an underscore,
    and follows symbolic links.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return with_kind(d.where(is_supported(F.col("path"))).select("path", "content", "length"))


def from_bytes(spark: SparkSession, content: bytes, path: str = "-") -> DataFrame:
    """SRC-6: one document given as bytes."""
    d = spark.createDataFrame([(path, bytearray(content), len(content), 0)], "path string, content binary, length bigint, ord int")
    return with_kind(d)
