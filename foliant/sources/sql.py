"""The engine from SQL: table functions over bytes and pages, scalar functions, and the data source `office`."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from foliant import functions
from foliant.sources.containers import names_of, read_cfb
from foliant.sources.markup import html_rows, xml_rows


@udtf(returnType="path string, ord int, method int, data binary")
class ZipEntries:
    """SELECT * FROM files, LATERAL zip_entries(content)"""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None and names_of(content):
            z = zipfile.ZipFile(io.BytesIO(content))
            for k, info in enumerate(z.infolist()):
                yield info.filename, k, info.compress_type, z.read(info)


@udtf(returnType="path string, data binary")
class CfbStreams:
    """SELECT * FROM files, LATERAL cfb_streams(content)"""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None and names_of(content):
            yield from sorted(read_cfb(content).items())


_NODE = "node_id int, parent_id int, depth int, name string, attrs map<string,string>, text string, path string"


@udtf(returnType=_NODE)
class HtmlNodes:
    """SELECT * FROM pages, LATERAL html_nodes(html)"""

    def eval(self, html: str) -> Iterator[tuple]:
        for r in html_rows(0, html or "", frozenset()):
            yield r[2], r[3], r[4], r[5], r[6], r[7], r[9]


@udtf(returnType=_NODE)
class XmlNodes:
    """SELECT * FROM parts, LATERAL xml_nodes(data)"""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for r in xml_rows(0, "", data or b"", frozenset()):
            yield r[2], r[3], r[4], r[5], r[6], r[7], r[9]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _OfficeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        return [_File(f.path) for f in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path) if f.is_file] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with store.open_input_stream(partition.path) as f:
            content = f.read()
        for name in names_of(content) or []:
            data = zipfile.ZipFile(io.BytesIO(content)).read(name) if content[:2] == b"PK" else read_cfb(content)[name]
            yield partition.path, name, data


class OfficeSource(DataSource):
    """spark.read.format("office").load(folder): (path, entry, data) of every container in a folder, a task per file."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return "path string, entry string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _OfficeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make all of it known to a session."""
    functions.register(spark)
    for name, function in (("zip_entries", ZipEntries), ("cfb_streams", CfbStreams), ("html_nodes", HtmlNodes), ("xml_nodes", XmlNodes)):
        spark.udtf.register(name, function)
    spark.dataSource.register(OfficeSource)
