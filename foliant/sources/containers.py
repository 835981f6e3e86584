"""Containers: zip and compound files as rows. Python only turns bytes into rows here; what the rows mean is Spark's."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import bounded_batches

CFB_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Path of the entry that tells a zip's format.
MARKERS = {"docx": "word/document.xml", "hwpx": "Contents/header.xml", "odt": "content.xml"}
ENTRY = "doc_id long, path string, ord int, method int, data binary, error string"
#: Bytes of the entries of a frame, about, and its entries.
FRAME_BYTES, FRAME_ROWS = 8 << 20, 10_000
RECORD = "doc_id long, stream string, seq int, tag int, level int, payload binary, error string"


def read_cfb(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by path."""
    if data[:8] != CFB_MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir = struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<5I", data, 56)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]  # noqa: E731 - the head fills the first sector
    fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x < 0xFFFFFFFC]
    while first_difat < 0xFFFFFFFC and n_difat > 0:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        fat_at += [x for x in more[:-1] if x < 0xFFFFFFFC]
        first_difat, n_difat = more[-1], n_difat - 1
    fat = [x for k in fat_at for x in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(k: int, table: list[int], block) -> bytes:
        out, seen = [], set()
        while k < 0xFFFFFFFC and k not in seen and k < len(table):
            seen.add(k)
            out.append(block(k))
            k = table[k]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    nodes = []
    for at in range(0, len(entries) - 127, 128):
        n = struct.unpack_from("<H", entries, at + 64)[0]
        name = entries[at : at + max(n - 2, 0)].decode("utf-16-le", "replace")
        kind = entries[at + 66]
        left, right, child = struct.unpack_from("<III", entries, at + 68)
        start, length = struct.unpack_from("<II", entries, at + 116)
        nodes.append((name, kind, left, right, child, start, length))
    root = nodes[0]
    small = chain(root[5], fat, sector)
    minis = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(minis) // 4}I", minis))
    found: dict[str, bytes] = {}
    todo = [(root[4], "")]
    seen = set()
    while todo:
        k, prefix = todo.pop()
        if k >= len(nodes) or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, start, length = nodes[k]
        todo += [(left, prefix), (right, prefix)]
        if kind == 1:
            todo.append((child, f"{prefix}{name}/"))
        elif kind == 2:
            body = chain(start, mini_fat, lambda i: small[i * mini : (i + 1) * mini]) if length < cutoff else chain(start, fat, sector)
            found[prefix + name] = body[:length]
    return found


def names_of(content: bytes) -> list[str] | None:
    """The entries of a container, null for other bytes."""
    try:
        if content[:2] == b"PK":
            return zipfile.ZipFile(io.BytesIO(content)).namelist()
        if content[:8] == CFB_MAGIC:
            return sorted(read_cfb(content))
    except Exception:  # a damaged container has no entries that could be named
        return []
    return None


def entry_names(content: Column) -> Column:
    @F.pandas_udf("array<string>")
    def names(col: pd.Series) -> pd.Series:
        return col.map(lambda b: names_of(b) if b is not None else None)

    return names(content)


def with_format(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds format: hwpx, docx, odt by a zip's marker entry, doc or hwp by a compound file's streams, else null."""
    names = F.col("_names")
    zipped = F.col(content).substr(1, 2) == F.lit(b"PK")
    by_marker = F.coalesce(*[F.when(F.array_contains(names, m), F.lit(f)) for f, m in MARKERS.items()])
    word = F.exists(names, lambda n: n.isin("WordDocument"))
    compound = F.col(content).substr(1, 8) == F.lit(CFB_MAGIC)
    return files.withColumn("_names", entry_names(F.col(content))).withColumn("format", F.when(zipped, by_marker).when(compound & F.coalesce(word, F.lit(False)), "doc").when(compound, "hwp")).drop("_names")


def _entry_frames(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of entries that hold no more bytes at once than a few pictures have."""
    frame = lambda: pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")]).astype({"ord": "Int32", "method": "Int32"})
    rows: list[tuple] = []
    size = 0
    for row in found:
        rows.append(row)
        size += len(row[4] or b"")
        if size >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
            yield frame()
            rows, size = [], 0
    if rows:
        yield frame()


def zip_entries(files: DataFrame, parts: list[str] | str | None = None, content: str = "content") -> DataFrame:
    """One row per entry (of the named parts, or those that match a pattern); a damaged package gives one row with an error."""
    wanted = (lambda name: True) if parts is None else re.compile(parts).fullmatch if isinstance(parts, str) else frozenset(parts).__contains__

    def entries(doc_id, data: bytes) -> Iterator[tuple]:
        """The wanted entries one by one, once all of these were read to their checksums."""
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            found = [(k, i) for k, i in enumerate(z.infolist()) if wanted(i.filename)]
            for _, info in found:
                with z.open(info) as f:
                    while f.read(1 << 16):
                        pass
        except Exception as e:
            yield doc_id, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for k, info in found:
            yield doc_id, info.filename, k, info.compress_type, z.read(info), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _entry_frames(row for pdf in frames for doc_id, data in zip(pdf["doc_id"], pdf[content]) for row in entries(doc_id, data))

    bounded_batches(files.sparkSession)
    return files.select("doc_id", content).mapInPandas(run, ENTRY)


def cfb_streams(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per stream of compound files; streams that are raw deflate (hwp's compressed bit) are inflated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, data in zip(pdf["doc_id"], pdf[content]):
                try:
                    streams = read_cfb(data)
                    packed = bool(streams.get("FileHeader", b"\0" * 40)[36] & 1)
                    for k, (path, body) in enumerate(sorted(streams.items())):
                        if packed and (path.startswith("BodyText/") or path == "DocInfo"):
                            body = zlib.decompress(body, -15)
                        rows.append((doc_id, path, k, 0, body, None))
                except Exception as e:
                    rows.append((doc_id, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")]).astype({"ord": "Int32", "method": "Int32"})

    return files.select("doc_id", content).mapInPandas(run, ENTRY)


def hwp_records(streams: DataFrame) -> DataFrame:
    """Records of hwp streams: a 32-bit head of tag (10 bits), level (10), size (12, 4095: in the next four bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, path, data in zip(pdf["doc_id"], pdf["path"], pdf["data"]):
                at, seq = 0, 0
                while at + 4 <= len(data):
                    head = struct.unpack_from("<I", data, at)[0]
                    at, size = at + 4, head >> 20
                    if size == 0xFFF:
                        if at + 4 > len(data):
                            break
                        size, at = struct.unpack_from("<I", data, at)[0], at + 4
                    short = at + size > len(data)
                    rows.append((doc_id, path, seq, head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size], "cut off" if short else None))
                    at, seq = at + size, seq + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return streams.filter("error is null").select("doc_id", "path", "data").mapInPandas(run, RECORD)


def record_parents(records: DataFrame) -> DataFrame:
    """Adds parent: the seq of the last record one level up; levels are as deep as the record's ten bits say.

    Between two records of a level, all that is deeper belongs to the first: a
    record's parent is the last record of the level above, which one window over
    records paired with the level that they open finds, whatever the depth.
    """
    from pyspark.sql import Window as W

    own = records.select("*", F.col("level").alias("_opens"), F.lit(1).alias("_side"))
    asks = records.select("*", (F.col("level") - 1).alias("_opens"), F.lit(0).alias("_side"))
    w = W.partitionBy("doc_id", "stream", "_opens").orderBy("seq", "_side").rowsBetween(W.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("_side") == 1, F.col("seq")), ignorenulls=True).over(w)
    return own.unionByName(asks).withColumn("parent", parent).filter("_side = 0").drop("_opens", "_side")
