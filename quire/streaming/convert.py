"""The conversion as a stream over a folder: each micro-batch of new files is converted by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Request, convert
from ..sources import files as files_
from ..staging import scope

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, request: Request = Request(), per_trigger: int = 100) -> StreamingQuery:
    """Reads files as they come and writes Parquet of (path, ord, markdown, error, batch).

    Documents are independent, so no state is kept. Each batch overwrites its
    own folder, so one that is run again after a failure writes no row twice.
    """
    src = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    src = src.where(files_.is_supported(F.col("path"))).select("path", "content", "length")

    def batch(df: DataFrame, epoch: int) -> None:
        with scope(df.sparkSession):
            convert(files_.with_kind(df), request).withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
