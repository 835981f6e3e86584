"""Saving documents back to the folders that they came from, as a data source with a commit.

`df.write.format("saveback").option("path", root)...save()` takes rows (target, content,
overwrote, note), target a path below the root. A task writes each file under an attempt's
own name beside its target and hands the names on as its message; the driver's commit
renames them, so a target is there whole or not at all, whatever is run again. An aborted
write leaves none of its files. Two rows for one target, or one that is there already and
was not asked to be overwritten, are told in the result and not written: the target
stays as it was. The result of a run is one JSON line a file at root/saved-<run>.result.json, in
the order of the targets: the messages hold names and sizes only, never contents.

Paths are the cluster's: any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "target string, content binary, overwrote boolean, note string"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


@dataclass
class Saved(WriterCommitMessage):
    """(attempt's name, target, bytes, overwrote, note) of the files of a task."""

    files: list[tuple[str, str, int, bool, str | None]]


class SaveBackWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Saved:
        store, base = _open(self.root)
        files = []
        for row in rows:
            path = posixpath.normpath(row.target)
            if path.startswith(("/", "..")):
                raise ValueError(f"{row.target} is no path below the root")
            folder, name = posixpath.split(path)
            own = posixpath.join(folder, f".{name}.{self.run}.{uuid.uuid4().hex}.part")
            store.create_dir(posixpath.join(base, folder), recursive=True)
            data = bytes(row.content or b"")
            with store.open_output_stream(posixpath.join(base, own)) as out:
                out.write(data)
            files.append((own, path, len(data), bool(row.overwrote), row.note))
        return Saved(files)

    def commit(self, messages: list[Saved | None]) -> None:
        from pyarrow import fs

        store, base = _open(self.root)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1], f[0]))
        done: set[str] = set()
        lines = []
        for own, target, size, over, note in files:
            there = store.get_file_info(posixpath.join(base, target)).type != fs.FileType.NotFound
            why = "two rows for one target" if target in done else "the target is there" if there and not over else None
            if why:
                store.delete_file(posixpath.join(base, own))
            else:
                store.move(posixpath.join(base, own), posixpath.join(base, target))
                done.add(target)
            lines.append(json.dumps({"path": target, "bytes": size, "saved": why is None, "overwrote": bool(there and over and why is None), "note": why or note}, ensure_ascii=False))
        with store.open_output_stream(posixpath.join(base, f"saved-{self.run}.result.json")) as out:
            out.write("".join(f"{x}\n" for x in lines).encode())

    def abort(self, messages: list[Saved | None]) -> None:
        from pyarrow import fs

        store, base = _open(self.root)
        # the files of tasks that came to their end, and those of tasks that did not: all bear the run's name
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if info.type == fs.FileType.File and f".{self.run}." in info.base_name and info.base_name.endswith(".part"):
                store.delete_file(info.path)


class SaveBack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saveback"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> SaveBackWriter:
        return SaveBackWriter(self.options["path"])


def targets(decided: DataFrame, folder: str = "folder") -> DataFrame:
    """What a save writes, of requests that sessions.decide granted (with folder, target, content): a token saves once, its
    last request by `asked_at`; names lose what would lead out of their folder."""
    from pyspark.sql import Window as W

    w = W.partitionBy("token").orderBy(F.col("asked_at").desc(), F.col("target"))
    once = decided.filter("status = 200").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    name = F.regexp_replace("target", r"^.*[/\\]", "")
    return once.select(F.concat_ws("/", F.nullif(folder, F.lit("")), name).alias("target"), F.col("content").cast("binary").alias("content"), "overwrote", "note")


def save(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (target, content, overwrote, note) below the root; the result of the run (path, bytes, saved, overwrote, note)."""
    spark = rows.sparkSession
    before = set(_results(spark, root))
    spark.dataSource.register(SaveBack)
    rows.select("target", "content", "overwrote", "note").write.format("saveback").mode("append").option("path", root).save()
    made = sorted(set(_results(spark, root)) - before)
    return spark.read.schema("path string, bytes long, saved boolean, overwrote boolean, note string").json(made)


def _results(spark: SparkSession, root: str) -> list[str]:
    """The result files of earlier runs: one a run."""
    from pyarrow import fs

    store, base = _open(root)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return [root.rstrip("/") + "/" + i.base_name for i in found if i.base_name.startswith("saved-") and i.base_name.endswith(".result.json")]
