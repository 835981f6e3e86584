"""Folder ingestion: every file that appears becomes rows of text and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.sources.containers import with_format
from foliant.sources.packages import read_any


def files(spark: SparkSession, folder: str, stream: bool = False, pattern: str = "*") -> DataFrame:
    """(doc_id, path, content) of a folder's files; ids are hashes of paths."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", pattern)
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(folder).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def status(found: DataFrame) -> DataFrame:
    """(doc_id, path, format, status, paragraphs, chars): ok, rejected (no known format) or failed (no text read)."""
    known = with_format(found)
    text = read_any(known.filter("format is not null").select("doc_id", "content", "format")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
    state = F.when(F.col("format").isNull(), "rejected").when(F.col("paragraphs").isNull(), "failed").otherwise("ok")
    return known.drop("content").join(text, "doc_id", "left").select("doc_id", "path", "format", state.alias("status"), "paragraphs", "chars")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the status of each new file to a Parquet table, batch by batch."""

    def batch(df: DataFrame, _: int) -> None:
        status(df).write.mode("append").parquet(target)

    return files(spark, folder, stream=True).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
