"""Operator 7, token-ID output: length-delimited binary records.

A shard file is a sequence of records, each framed as
    length (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4),
all little-endian; the mask rotates the checksum by 15 bits and adds a constant,
so that a checksum of data that holds checksums stays meaningful. The payload is
the document id (8 bytes, signed), one byte for "the id is null", one for the
width of an id, then the ids. A separate index (Parquet: shard, ordinal, doc_id,
byte offset, byte length, n_tokens) serves shuffled reads of single records.

Documents are range-partitioned and sorted by id, then by text hash, so shards
follow each other in ascending order (null ids first), an attempt that is run again
writes the same shard, and ids that repeat, or are null, fall on as many shards as
their rows need (equal rows are told apart by the place that they were read from). A shard is written under an attempt's own name
and renamed when whole, so a lost executor leaves no half shard under the final
name. Empty and null texts give a record with the end id alone; very long texts
are one record; repeated rows are written once each; ties of ids go by text hash,
and equal rows give equal records; columns of other names are not read; an empty
table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import small, small_batches, split_rows, texts
from foliant.llm.tokens import encoder, vocabulary
from foliant.session import scratch_path

MASK_DELTA = 0xA282EAD8
HEAD, FOOT, LEAD = "<QI", "<I", "<q??"
#: Bytes of text that make a shard.
SHARD_BYTES = 12 << 20
#: Shards whose sizes are added up in one group.
BLOCK = 1000
INDEX = "shard string, ordinal long, doc_id long, offset long, bytes long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload of a stream, None at its end; raises ValueError where a checksum fails."""
    head = stream.read(struct.calcsize(HEAD))
    if not head:
        return None
    if len(head) < struct.calcsize(HEAD):
        raise ValueError("a record's head is cut off")
    size, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    body = stream.read(size + struct.calcsize(FOOT))
    if len(body) < size + struct.calcsize(FOOT) or masked(body[:size]) != struct.unpack(FOOT, body[size:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:size]


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack(LEAD, doc_id or 0, doc_id is None, ids.itemsize == 4) + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, wide = struct.unpack_from(LEAD, payload)
    return None if null else doc_id, np.frombuffer(payload, "<u4" if wide else "<u2", offset=struct.calcsize(LEAD))


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_records(docs: DataFrame, path: str, vocab: str, end_id: int | None = 0, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards to path/data and the index to path/index; returns the index."""
    spark = docs.sparkSession
    small_batches(spark)
    source = texts(docs, text_col, id_col)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    data = f"{path}/data"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, root = open_fs(data)
        name = f"shard-{task.partitionId():07d}.rec"
        own, encode, at, ordinal, stream = f"{root}/_attempt-{task.taskAttemptId()}-{name}", encoder(vocab).encode, 0, 0, None
        for pdf in split_rows(frames, 1 << 21):
            if stream is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(own)
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode(pdf["text"].tolist())):
                ids = ids if end_id is None else np.append(ids, ids.dtype.type(end_id))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                record = frame(pack(doc_id, ids))
                stream.write(record)
                rows.append((name, ordinal, doc_id, at, len(record), len(ids)))
                at, ordinal = at + len(record), ordinal + 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"doc_id": "Int64"})
        if stream is not None:
            stream.close()
            store.move(own, f"{root}/{name}")

    order = ["doc_id", "hash", "place"]
    placed = source.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    index = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(write, INDEX)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, summary: bool = True) -> DataFrame:
    """Every record of the shards, read record by record with both checksums verified, one task per shard.

    summary=True: shard, ordinal, doc_id, shard_start, start_in_shard, n_tokens, ids_crc32; else also ids (array of int).
    shard_start: ids of all shards before; the index gives it, and a shard that does not hold the index's ids is an error.
    """
    index = index if index is not None else spark.read.schema(INDEX).parquet(f"{path}/index")
    shards = index.groupBy("shard").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))
    n = max(1, shards.count())
    # ids before a shard: those of the blocks of shards before, and of the shards before in its block
    shards = shards.withColumn("block", F.floor(F.regexp_extract("shard", r"(\d+)", 1).cast("long") / BLOCK))
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = shards.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", earlier(W.orderBy("block")).alias("before"))  # a row per BLOCK shards
    shards = shards.withColumn("within", earlier(W.partitionBy("block").orderBy("shard"))).join(small(blocks), "block")
    shards = shards.select("shard", "records", "tokens", (F.col("before") + F.col("within")).alias("base")).repartition(n)
    data = f"{path}/data"
    schema = "shard string, ordinal long, doc_id long, shard_start long, start_in_shard long, n_tokens long, ids_crc32 long" + ("" if summary else ", ids array<int>")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for shard, records, tokens, base in zip(pdf["shard"], pdf["records"], pdf["tokens"], pdf["base"]):
                store, root = open_fs(data)
                rows, at, ordinal = [], 0, 0
                with store.open_input_stream(f"{root}/{shard}", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        row = (shard, ordinal, doc_id, base, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append(row if summary else (*row, ids.astype("int32")))
                        at, ordinal = at + len(ids), ordinal + 1
                        if len(rows) >= (4096 if summary else 64):
                            yield _rows(rows, schema)
                            rows = []
                if (ordinal, at) != (records, tokens):
                    raise ValueError(f"{shard} holds {ordinal} records of {at} ids, the index {records} of {tokens}")
                yield _rows(rows, schema)

    return shards.mapInPandas(read, schema)


def _rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})


def read_record(path: str, shard: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    store, root = open_fs(f"{path}/data")
    with store.open_input_file(f"{root}/{shard}") as f:
        f.seek(offset)
        return unpack(read_frame(f))


def token_starts(records: DataFrame) -> DataFrame:
    """Adds start: ids of all records before a record."""
    return records.withColumn("start", F.col("shard_start") + F.col("start_in_shard")).drop("shard_start")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary())
    return token_starts(read_records(spark, path, index)).select("doc_id", "start", "n_tokens", "ids_crc32")
