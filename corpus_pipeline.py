"""From raw documents to packed training sequences, in five stages that each write a Parquet table.

Every stage works on all that the former kept; all but the last return the
columns of documents, without the rows that they reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, gam, langid, packing, simhash
from quire.llm.shared import cut, drop, few_rows, scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, rejects go; null texts stay."""
    few_rows(spark)
    return gam.accept(docs, gam.fit(docs, table(spark, sf_dir, "labels")), out=False)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is plainly in another language than declared go; undecided and unlabelled ones stay."""
    few_rows(spark)
    return langid.accept(docs, langid.fit(docs), out=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id; texts without words stay."""
    few_rows(spark)
    return simhash.dedup(docs, out_simhash=None, out_size=None)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    few_rows(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token's place in sequences of 2048; documents without tokens have a row without place."""
    few_rows(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pack", packed)]

#: The stages aren't expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next.

    What a stage staged goes when its result is written, and that when the next one's is.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scope(spark):
            docs, new = cut(stage(spark, docs, sf_dir), outlive=True)
        if path:
            drop(spark, path)
        path = new
    return docs
