"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts are long, so batches are short.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are over."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null texts as empty; all other columns are pruned."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Bytes that a broadcast side may have.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, *sized: str, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if it is measured to be small: 32 bytes a row and the bytes of the `sized` columns."""
    most = BROADCAST_BYTES if most is None else most
    size = F.lit(32)
    for c in sized:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def nested(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(row, id, hash): each row of docs as one struct, so that no column name clashes, beside its id and text hash."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return docs.select(row, docs[id_col].cast("long").alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"))


def unnested(rows: DataFrame, columns: list[str], **changes: Column) -> DataFrame:
    """The rows of nested(), as they were but for the changed columns."""
    return rows.select(*[changes.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def split_rows(frames: Iterator[pd.DataFrame], most_chars: int, column: str = "text") -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that one piece holds about most_chars characters (one row at least)."""
    for pdf in frames:
        total = pdf[column].str.len().fillna(0).cumsum() // most_chars
        for _, part in pdf.groupby(total.to_numpy(), sort=True):
            yield part


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")
