"""Folders of subtitles and logs that grow, as streams. An extension: the batch functions on new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vanika.sources import srt


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse each new SRT file of the folder once, into Parquet; the checkpoint keeps what is done. Ends when all is read."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("path"), "value")

    def add(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        srt.parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new log files as they come."""
    return spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
