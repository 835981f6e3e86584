"""Markup as rows: one row per element or text of XML parts and HTML pages, in document order."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import chain, groupby
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import bounded_batches

MAX_DEPTH = 256
NODE = "doc_id long, part string, node_id int, parent_id int, depth int, name string, attrs map<string,string>, text string, block_id int, path string, parent_name string, error string, last_id int, post_id int, cell_id int, outer_id int"
#: The same for Arrow: workers make its batches themselves, as one with pandas loaded is half as large again.
NODE_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(t, pa.map_(pa.string(), pa.string()))) for n, t in map(str.split, NODE.split(", "))])
#: Nodes and characters of a frame, about, and what is parsed at once: bytes of XML, characters of HTML.
FRAME_ROWS, FRAME_CHARS = 4_000, 2_000_000
PIECE, HTML_PIECE = 1 << 16, 1 << 20
#: Bytes of a page that a worker is given at once: as many as HTML_PIECE characters have at most.
PAGE_BYTES = 4 * HTML_PIECE
# fixed values: elements without content, elements whose text is raw, and the vocabulary of blocks
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
CLOSES_P = frozenset("p div article section nav footer header aside main ul ol li dl dt dd table h1 h2 h3 h4 h5 h6 form pre blockquote hr figure doc-section doc-footnote doc-textbox".split())
CLOSES = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "td": ("td", ("tr",)), "th": ("td", ("tr",)), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "option": ("option", ("select",))}


class _Rows:
    """Nodes with their parents, depths, paths, nearest ancestors that are blocks, cells and outer parts, and their intervals.

    A node's descendants are the nodes after it up to last_id, so "inside of" is a range of numbers; post_id numbers
    nodes in the order in which they end. A node is done when it ends, so no more is held than the open ones and what
    was not taken yet.
    """

    def __init__(self, doc_id, part: str, blocks: frozenset[str], cells: frozenset[str] = frozenset(), outers: frozenset[str] = frozenset()):
        self.done: list[list] = []
        self.open: list[tuple[list, str, int | None, str, int | None, int | None]] = []  # row, name, block, path, cell, outer
        self.doc_id, self.part, self.blocks, self.cells, self.outers = doc_id, part, blocks, cells, outers
        self.count = self.ended = 0
        self.words: list | None = None  # the text that may go on
        self.pieces: list[str] = []

    def taken(self) -> list[list]:
        done, self.done = self.done, []
        return done

    def add(self, name: str, attrs: dict | None) -> list:
        self._say()
        parent, parent_name, block, path, cell, outer = (self.open[-1][0][2], *self.open[-1][1:]) if self.open else (None, None, None, "", None, None)
        if name != "#text":
            key = (attrs or {}).get("data-id") or (attrs or {}).get("id")
            path = f"{path} > {name}" if path else name
            path = f"{path}#{key}" if key else path
        row = [self.doc_id, self.part, self.count, parent, len(self.open), name, attrs, None, block, path, parent_name, None, self.count, None, cell, outer]
        self.count += 1
        return row

    def _say(self) -> None:
        if self.words is not None:
            self.words[7] = "".join(self.pieces)
            self.done.append(self.words)
            self.words, self.pieces = None, []

    def _end(self, row: list) -> None:
        row[12], row[13] = self.count - 1, self.ended
        self.ended += 1

    def leave(self, down_to: int) -> None:
        """Closes the open nodes down to a depth."""
        while len(self.open) > down_to:
            self._say()
            row = self.open.pop()[0]
            self._end(row)
            self.done.append(row)

    def fail(self, e: Exception) -> None:
        self._say()
        self.leave(0)
        self.done.append([self.doc_id, self.part, self.count, None, 0, "#error", None, None, None, "", None, f"{type(e).__name__}: {e}", self.count, self.ended, None, None])

    def enter(self, name: str, attrs: dict) -> None:
        row = self.add(name, attrs)
        if len(self.open) >= MAX_DEPTH:
            self.done.append(row)
            raise ValueError(f"nested deeper than {MAX_DEPTH}")
        k = row[2]
        self.open.append((row, name, k if name in self.blocks else row[8], row[9], k if name in self.cells else row[14], k if name in self.outers else row[15]))

    def text(self, data: str) -> None:
        if self.words is None:
            row = self.add("#text", None)
            self._end(row)
            self.words = row
        self.pieces.append(data)


def xml_stream(doc_id, part: str, data: Iterable[bytes], blocks: frozenset[str], cells: frozenset[str] = frozenset(), outers: frozenset[str] = frozenset()) -> Iterator[list[list]]:
    """The nodes of a part that comes in pieces, as they end. Names and attribute names lose their prefixes; too deep or
    broken parts end in a row with an error."""
    rows = _Rows(doc_id, part, blocks, cells, outers)
    local = lambda n: n.rpartition(":")[2]
    p = expat.ParserCreate()  # unbuffered, so that no text before a break is lost
    p.StartElementHandler = lambda n, a: rows.enter(local(n), {local(k): v for k, v in a.items()})
    p.EndElementHandler = lambda n: rows.leave(len(rows.open) - 1)
    p.CharacterDataHandler = rows.text
    try:
        for some in data:
            p.Parse(some, False)
            yield rows.taken()
        p.Parse(b"", True)
        rows.leave(0)
    except Exception as e:
        rows.fail(e)
    yield rows.taken()


def _in_order(found: Iterable[list[list]]) -> list[list]:
    return sorted((row for some in found for row in some), key=lambda row: row[2])


def xml_rows(doc_id, part: str, data: bytes, blocks: frozenset[str], cells: frozenset[str] = frozenset(), outers: frozenset[str] = frozenset()) -> list[list]:
    """All nodes of a part, in document order."""
    return _in_order(xml_stream(doc_id, part, [data], blocks, cells, outers))


class _Html(HTMLParser):
    """A tree from tags: implied ends of p, li and cells; end tags close what they name if it is open."""

    def __init__(self, rows: _Rows):
        super().__init__(convert_charrefs=True)
        self.to = rows

    def handle_starttag(self, tag, attrs):
        self._imply(tag)
        self.to.enter(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.to.leave(len(self.to.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _imply(self, tag: str) -> None:
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])

    def _close(self, name: str, stop) -> None:
        for k in range(len(self.to.open) - 1, -1, -1):
            if self.to.open[k][1] == name:
                self.to.leave(k)
                return
            if self.to.open[k][1] in stop:
                return

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        self.to.text(data)


def html_stream(doc_id, html: Iterable[str], blocks: frozenset[str], cells: frozenset[str] = frozenset(), outers: frozenset[str] = frozenset()) -> Iterator[list[list]]:
    """The nodes of a page that comes in pieces, as they end."""
    rows = _Rows(doc_id, "html", blocks, cells, outers)
    try:
        parser = _Html(rows)
        for some in html:
            for at in range(0, len(some), HTML_PIECE):
                parser.feed(some[at : at + HTML_PIECE])
                yield rows.taken()
        parser.close()
        rows._say()
        rows.leave(0)
    except Exception as e:
        rows.fail(e)
    yield rows.taken()


def html_rows(doc_id, html: str, blocks: frozenset[str], cells: frozenset[str] = frozenset(), outers: frozenset[str] = frozenset()) -> list[list]:
    """All nodes of a page, in document order."""
    return _in_order(html_stream(doc_id, [html], blocks, cells, outers))


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[6] = [None if a is None else list(a.items()) for a in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_ARROW)], schema=NODE_ARROW)


def _frames(found: Iterator[list[list]]) -> Iterator[list[list]]:
    """Few large lists of many small ones."""
    rows: list[list] = []
    size = 0
    for some in found:
        for row in some:
            rows.append(row)
            size += len(row[7] or "") + len(row[9]) + sum(map(len, (row[6] or {}).values()))
            if len(rows) >= FRAME_ROWS or size >= FRAME_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one by one."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def xml_nodes(parts: DataFrame, blocks: list[str], cells: list[str] = (), outers: list[str] = ()) -> DataFrame:
    """The nodes of XML parts (doc_id, path, data); block_id, cell_id and outer_id are the nearest ancestors of these names."""
    names = [frozenset(x) for x in (blocks, cells, outers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_batch, _frames(some for i, part, data in _rows(batches) if data is not None for some in xml_stream(i, part, (data[at : at + PIECE] for at in range(0, len(data), PIECE)), *names)))

    bounded_batches(parts.sparkSession)
    return parts.select("doc_id", "path", "data").mapInArrow(run, NODE)


def package_nodes(files: DataFrame, parts: str, blocks: list[str], cells: list[str] = (), outers: list[str] = (), content: str = "content", only: list[str] | None = None) -> DataFrame:
    """The nodes of the XML parts of packages whose path matches a pattern, none of a damaged package; with `only`, those of
    these names, and no others leave their worker.

    Parts are inflated and parsed by pieces: a worker holds packages as they are and one frame of nodes, however long a
    part is.
    """
    names = [frozenset(x) for x in (blocks, cells, outers)]
    kept = None if only is None else frozenset(only)
    wanted = re.compile(parts).fullmatch

    def pieces(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[bytes]:
        with z.open(info) as f:
            while some := f.read(PIECE):
                yield some

    def opened(data: bytes) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]] | None:
        """The package and its wanted parts, once all of these were read to their checksums."""
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            found = [i for i in z.infolist() if wanted(i.filename)]
            for info in found:
                for _ in pieces(z, info):
                    pass
            return z, found
        except Exception:  # zip_entries says what is wrong with it
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packages = ((i, *p) for i, data in _rows(batches) if (p := opened(data)) is not None)
        found = (some for i, z, parts in packages for info in parts for some in xml_stream(i, info.filename, pieces(z, info), *names))
        yield from map(_batch, _frames(found if kept is None else ([row for row in some if row[5] in kept] for some in found)))

    bounded_batches(files.sparkSession)
    return files.select("doc_id", content).mapInArrow(run, NODE)


def page_pieces(pages: DataFrame) -> DataFrame:
    """(doc_id, at, data): the bytes of pages (doc_id, html) in pieces, at least one a page, those of a page in order."""
    count = F.greatest(F.ceil(F.octet_length("html") / PAGE_BYTES), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col("html").cast("binary"), k * PAGE_BYTES + 1, PAGE_BYTES))
    return pages.select("doc_id", F.posexplode_outer(cut).alias("at", "data"))


def _pages(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, texts) of the pages whose pieces (doc_id, at, data) follow one another."""
    nth = 0

    def page(row: tuple) -> int:
        nonlocal nth
        nth += row[1] == 0
        return nth

    for _, own in groupby(rows, page):
        first = next(own)
        yield first[0], codecs.iterdecode((row[2] for row in chain([first], own)), "utf-8", "replace")


#: What is block, cell and outer part in a page.
PAGE_NAMES = (["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "doc-footnote"], ("td", "th"), ("doc-footnote", "doc-header", "doc-footer"))


def _page_nodes(pieces: DataFrame, blocks: list[str], cells: list[str], outers: list[str]) -> DataFrame:
    """The nodes of pages from pieces (doc_id, at, data) as they come; one whose `at` is 0 begins a page."""
    names = [frozenset(x) for x in (blocks, cells, outers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_batch, _frames(some for i, html in _pages(_rows(batches)) for some in html_stream(i, html, *names)))

    bounded_batches(pieces.sparkSession)
    return pieces.mapInArrow(run, NODE)


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", blocks: list[str] | None = None, cells: list[str] = PAGE_NAMES[1], outers: list[str] = PAGE_NAMES[2]) -> DataFrame:
    """The nodes of HTML pages. Pages leave Spark by pieces: a worker holds one of these and one frame of nodes, however
    long a page is."""
    return _page_nodes(page_pieces(pages.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))), blocks or PAGE_NAMES[0], cells, outers)


def piece_nodes(pieces: DataFrame, blocks: list[str] | None = None, cells: list[str] = PAGE_NAMES[1], outers: list[str] = PAGE_NAMES[2]) -> DataFrame:
    """The nodes of HTML pages that come in pieces (doc_id, seg, at, sub, xml): they are sorted and parsed one after the
    other, and no page is a string of its own, in Spark neither."""
    order = ["doc_id", "seg", "at", "sub"]
    own = pieces.withColumn("doc_id", F.col("doc_id").cast("long")).repartition("doc_id").sortWithinPartitions(*order)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(*order[1:])) == 1
    marked = own.withColumn("_at", F.when(first, 0).otherwise(1)).select("doc_id", F.col("_at").alias("at"), F.col("xml").cast("binary").alias("data"))
    return _page_nodes(marked, blocks or PAGE_NAMES[0], cells, outers)
