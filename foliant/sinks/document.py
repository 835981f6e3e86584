"""Writers of whole documents: headings, styled runs, lists, links, footnotes, tables, bands and fields, in three formats.

A document is a handful of tables, all keyed by doc_id:
    blocks(doc_id, ord, tag [, list_id, level, ordered, numbered, align, left, first_line, band, page_break, inside])
    runs(doc_id, ord, run, text [, bold, italic, underline, strike, color, size, font, position, link, note, field, picture, pic_width, pic_height])
    cells(doc_id, ord, row, col, row_span, col_span, width, text [, cell, b_left, ..., p_left, ..., background, valign]): the cells of
        the block `ord`, whose tag is table, with their borders and padding by side
    notes(doc_id, note, text), images(doc_id, image, ext, data)
A cell holds the blocks whose `inside` is its `cell` (tables among them, to any depth), or
its text where it has none. A run whose picture names an image shows it. XML is made by
Catalyst, bottom up: runs into paragraphs, paragraphs into cells and parts, the deepest
tables first; styles that a format names are interned per document. Pictures are keys
until the end: their bytes meet the parts of their document just before Python zips them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import units
from foliant.functions.text import BULLETS, escape, xml_safe
from foliant.operators.ordered import asof_join, intern, islands
from foliant.operators.tables import BORDER, SIDES, shared_edges
from foliant.session import written_by_rows as written
from foliant.sinks import packages, parts
from foliant.sinks.packages import XML

BLOCK = {"list_id": "int", "level": "int", "ordered": "boolean", "numbered": "boolean", "align": "string", "left": "double", "first_line": "double", "band": "string", "page_break": "boolean", "inside": "int"}
RUN = {"bold": "boolean", "italic": "boolean", "underline": "boolean", "strike": "boolean", "color": "string", "size": "double", "font": "string", "position": "string", "link": "string", "note": "int", "field": "string", "picture": "string", "pic_width": "double", "pic_height": "double"}
CELL = {"width": "double", "cell": "int", **{f"b_{s}": BORDER for s in SIDES}, **parts.FORMAT}
#: What a text style is made of, and what a paragraph style is.
TEXT_STYLE = ["bold", "italic", "underline", "strike", "color", "size", "font", "position"]
PARA_STYLE = ["align", "left", "first_line", "page_break"]
# fixed values: the colour of a link that has none of its own, and the numbering of the outline
LINK_COLOR, OUTLINE_NUM = "#0563C1", 900
BASE_FONT = "함초롬바탕"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that no Python worker makes, as those do that createDataFrame makes of a list."""
    return spark.range(1).limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in map(str.split, schema.split(", "))])


@dataclass
class Document:
    blocks: DataFrame
    runs: DataFrame
    cells: DataFrame | None = None
    notes: DataFrame | None = None
    images: DataFrame | None = None

    def __post_init__(self):
        fill = lambda df, known: df.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in df.columns})
        self.blocks, self.runs = fill(self.blocks, BLOCK), fill(self.runs, RUN)
        spark = self.blocks.sparkSession
        self.cells = self.cells if self.cells is not None else _empty(spark, "doc_id long, ord int, row int, col int, row_span int, col_span int, width double, text string")
        self.cells = fill(self.cells, CELL)
        self.images = self.images if self.images is not None else _empty(spark, "doc_id long, image string, ext string, data binary")
        self.notes = self.notes if self.notes is not None else _empty(spark, "doc_id long, note int, text string")

    def stored(self) -> Document:
        """With its tables written once, as writers use each of them several times, and each edge of a table as one border."""
        return Document(*[written(df, name) for df, name in ((self.blocks, "blocks"), (self.runs, "runs"), (shared_edges(self.cells, ["doc_id", "ord"], ["row", "col"]), "cells"), (self.notes, "notes"))], self.images)


def _joined(value: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "")


def _tag(name: str, **attrs: Column | str) -> Column:
    """An empty element; an attribute that is null makes all of it empty."""
    said = [x for k, v in attrs.items() for x in (F.lit(f' {name.split(":")[0]}:{k}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"'))]
    return F.coalesce(F.concat(F.lit(f"<{name}"), *said, F.lit("/>")), F.lit(""))


def _if(test: Column, xml: str | Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), xml if isinstance(xml, Column) else F.lit(xml)).otherwise("")


def _wrapped(before: Column | str, inner: Column, after: str) -> Column:
    return F.concat(before if isinstance(before, Column) else F.lit(before), inner, F.lit(after))


def _linked(runs: DataFrame, before: Column, after: str) -> DataFrame:
    """(doc_id, ord, xml): runs of one block joined; neighbours of one link are wrapped together (columns xml, link)."""
    grouped = islands(runs, ["doc_id", "ord"], ["run"], ["link"])
    one = grouped.groupBy("doc_id", "ord", "island", "link").agg(_joined("xml", "run").alias("xml"), F.first("rid").alias("rid"))
    one = one.withColumn("xml", F.when(F.col("link").isNotNull(), _wrapped(before, F.col("xml"), after)).otherwise(F.col("xml")))
    return one.groupBy("doc_id", "ord").agg(_joined("xml", "island").alias("xml"))


def _pieces(path: str | Column, df: DataFrame, seg: int = 1, at: Column | str = "ord", sub: Column | None = None, xml: Column | str = "xml") -> DataFrame:
    """Pieces of a part: a part's segments come in order, and inside of one its pieces by `at` and `sub`."""
    at, xml = (F.col(c) if isinstance(c, str) else c for c in (at, xml))
    path = path if isinstance(path, Column) else F.lit(path)
    return df.select("doc_id", path.alias("path"), F.lit(seg).alias("seg"), at.cast("int").alias("at"), (F.lit(0) if sub is None else sub).cast("int").alias("sub"), xml.alias("xml"))


def package(pieces: list[DataFrame], fixed: dict[str, str], media: DataFrame | None = None) -> DataFrame:
    """(doc_id, content) from pieces of parts, with the fixed parts that a document does not replace and the pictures of
    media (doc_id, path, data). No part is ever a string of its own: pieces are sorted and zipped one after the other."""
    rows = reduce(DataFrame.unionByName, pieces).withColumn("data", F.lit(None).cast("binary"))
    if media is not None:
        zero = F.lit(0)
        rows = rows.unionByName(media.select("doc_id", "path", zero.alias("seg"), zero.alias("at"), zero.alias("sub"), F.lit(None).cast("string").alias("xml"), "data"))
    return packages.packed(rows, fixed)


def pictures(doc: Document, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, picture, bin, ext, path) of the pictures that runs show, equal ones of a document as one, and the media
    (doc_id, path, data) of a package. The first holds keys only; pictures that no run shows are not written."""
    images = doc.images.withColumn("ext", F.lower("ext"))
    used = doc.runs.filter("picture is not null").select("doc_id", F.col("picture").alias("image")).distinct()
    keyed = images.select("doc_id", "image", "ext", F.sha2("data", 256).alias("sha")).join(used, ["doc_id", "image"])
    groups, named = intern(keyed, ["doc_id"], F.col("image"), ["ext", "sha"], "nth")
    path = F.concat(F.lit(f"{folder}/image"), F.col("nth") + 1, F.lit("."), F.col("ext"))
    names = written(named.select("doc_id", F.col("image").alias("picture"), (F.col("nth") + 1).alias("bin"), "ext", path.alias("path")), "pictures")
    first = names.groupBy("doc_id", "path").agg(F.min("picture").alias("image"))
    return names, images.select("doc_id", "image", "data").join(first, ["doc_id", "image"]).select("doc_id", "path", "data")


#: Stands in the XML of a table whose rows are pieces of their own; texts cannot hold it.
ROWS = "<?rows?>"


def assemble(rows: DataFrame, cells: DataFrame, rows_of: Callable[[DataFrame], DataFrame], around: tuple[Column, Column], listed: Callable[[DataFrame], DataFrame] = lambda rows: rows, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The blocks that stand in no cell, with xml: `rows` has the xml of paragraphs, `rows_of` makes (doc_id, ord, r, xml, cols)
    of cells with a body, `around` is what stands before and after a table's rows (it may use the table's numbers of rows and
    cols), `listed` puts list items of one place into lists.

    Blocks get the depth of the cells that they stand in by joining each level's tables with their cells and what is inside
    of these; then the deepest level goes into the cells of the one above, and so on: as many rounds as tables nest.
    Tables of the body have ROWS in place of their rows, which are the second result, as a table may be as long as its
    document; with `whole` they have their rows as well.
    """
    rows, cells = written(rows, "rows"), written(cells, "cells")
    levels = [rows.filter("inside is null")]
    while True:
        held = cells.filter("cell is not null").join(levels[-1].filter("tag = 'table'").select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").select("doc_id", F.col("cell").alias("inside"))
        below = written(rows.join(held, ["doc_id", "inside"], "left_semi").select(*rows.columns), "level")
        if below.isEmpty():
            break
        levels.append(below)
    content = None
    for depth in reversed(range(len(levels))):
        here = levels[depth]
        own = cells.join(here.filter("tag = 'table'").select("doc_id", "ord", (F.lit(depth == 0 and not whole) & F.col("band").isNull()).alias("apart")), ["doc_id", "ord"])
        own = own.withColumn("body", F.lit(None).cast("string")) if content is None else own.join(content, ["doc_id", "cell"], "left")
        inner = _whole_tables(rows_of(own.filter("not apart").drop("apart")), around, _joined("xml", "r"))
        if depth == 0:
            apart = written(rows_of(own.filter("apart").drop("apart")), "table-rows")
            inner = inner.unionByName(_whole_tables(apart, around, F.first(F.lit(ROWS))))
        made = here.join(inner, ["doc_id", "ord"], "left")
        made = listed(made.withColumn("xml", F.when(F.col("tag") == "table", F.coalesce("table_xml", F.lit(""))).otherwise(F.col("xml"))).drop("table_xml"))
        content = made.groupBy("doc_id", F.col("inside").alias("cell")).agg(_joined("xml", "ord").alias("body"))
    return written(made, "made"), apart


def _whole_tables(rows: DataFrame, around: tuple[Column, Column], inner: Column) -> DataFrame:
    """(doc_id, ord, table_xml)."""
    whole = rows.groupBy("doc_id", "ord").agg(inner.alias("xml"), F.count("*").alias("rows"), F.max("cols").alias("cols"))
    return whole.select("doc_id", "ord", F.concat(around[0], F.col("xml"), around[1]).alias("table_xml"))


def _body(path: str, blocks: DataFrame, docs: DataFrame, before: Column | str, after: Column | str, table_rows: DataFrame | None = None, first: int = 0) -> list[DataFrame]:
    """The pieces of a part from the xml of its blocks; documents without blocks have an empty one."""
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    zero, xml = F.lit(0), F.col("xml")
    found = [_pieces(path, docs, first, zero, xml=lit(before)), _pieces(path, blocks, first + 1, xml=F.substring_index(xml, ROWS, 1) if table_rows is not None else xml), _pieces(path, docs, first + 2, zero, xml=lit(after))]
    if table_rows is not None:
        rest = F.substr(xml, F.instr(xml, ROWS) + len(ROWS))
        found += [_pieces(path, table_rows, first + 1, sub=F.col("r") + 1), _pieces(path, blocks.filter(F.contains(xml, F.lit(ROWS))), first + 1, sub=F.lit(2_147_483_647), xml=rest)]
    return found


def _list_shape(blocks: DataFrame) -> DataFrame:
    """Adds opens, closes and deeper of list items: how many levels an item opens, how many follow-ups close, by its neighbours."""
    marked = islands(blocks.withColumn("_list", F.when(F.col("tag") == "li", F.coalesce("list_id", F.lit(0)))), ["doc_id", "band", "inside"], ["ord"], ["_list"], "_run")
    w = W.partitionBy("doc_id", "band", "inside", "_run").orderBy("ord")
    level = F.coalesce("level", F.lit(0))
    return marked.withColumn("_before", F.coalesce(F.lag(level).over(w), F.lit(-1))).withColumn("_last", F.lead(level).over(w).isNull()).withColumn("_level", level)


def _closing_kinds(shaped: DataFrame, kind: Column) -> DataFrame:
    """(doc_id, ord, _kinds): for every item the levels that close at it, each with the kind of the item that opened it.

    Openings and closings are rows of their level, so an as-of join by level finds the opener, at any depth.
    """
    level, before, by = F.col("_level"), F.col("_before"), ["doc_id", "band", "inside", "_run", "k"]
    items = shaped.filter("_list is not null").withColumn("_kind", kind)
    opens = items.filter(level > before).select("*", F.explode(F.sequence(before + 1, level)).alias("k")).select(*by, "ord", "_kind")
    low = F.when(F.col("_last"), F.lit(0)).otherwise(level + 1)
    closes = items.withColumn("_high", F.greatest(before, level)).filter(F.col("_high") >= low).select("*", F.explode(F.sequence(low, F.col("_high"))).alias("k")).select(*by, "ord")
    found = asof_join(closes, opens, by, "ord", ["_kind"])
    return found.groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("k", "_kind"))).alias("_kinds"))


def nested_lists(blocks: DataFrame, open_list: Column, close_list: str | tuple[Column, str, str], open_item: Column | str, close_item: str) -> DataFrame:
    """blocks with the xml of list items put into lists: levels open and close between neighbours, by windows alone.

    A deeper item stands inside the item before it; a jump of several levels opens
    empty ones. close_list is one end tag, or (kind, tag, other tag): then a level
    closes by the kind of the item that opened it, at any depth.
    """
    shaped = _list_shape(blocks)
    item = open_item if isinstance(open_item, Column) else F.lit(open_item)
    level, before = F.col("_level"), F.col("_before")
    if isinstance(close_list, str):
        close = lambda k: F.lit(close_item + close_list)
    else:
        kind, yes, no = close_list
        shaped = shaped.join(_closing_kinds(shaped, kind), ["doc_id", "ord"], "left")
        close = lambda k: F.concat(F.lit(close_item), F.when(F.coalesce(F.try_element_at("_kinds", k), F.lit(False)), yes).otherwise(no))
    down = lambda high, low: F.array_join(F.transform(F.filter(F.sequence(F.greatest(high, low), low, F.lit(-1)), lambda k: k <= high), close), "")
    opened = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(level - before, F.lit(1))), lambda i: F.concat(open_list, item)), "")
    start = F.when(level > before, opened).otherwise(F.concat(down(before, level + 1), F.lit(close_item), item))
    end = F.when(F.col("_last"), down(level, F.lit(0))).otherwise("")
    xml = F.when(F.col("_list").isNotNull(), F.concat(start, F.col("xml"), end)).otherwise(F.col("xml"))
    return shaped.withColumn("xml", xml).drop("_list", "_run", "_before", "_last", "_level", "_kinds")


def _rows_of(make: Callable[[DataFrame], DataFrame], cells: DataFrame) -> DataFrame:
    """(doc_id, ord, r, xml, cols) of cells."""
    return make(cells.withColumn("table", F.col("ord"))).select("doc_id", F.col("table").alias("ord"), "r", "xml", F.lit(None).cast("int").alias("cols"))


def _around(before: str, after: str) -> tuple[Column, Column]:
    return F.lit(before), F.lit(after)


# ---- docx


def _docx_runs(runs: DataFrame) -> DataFrame:
    link = F.col("link").isNotNull()
    tint = F.when((F.col("color") != "#000000"), F.col("color")).when(link, F.lit(LINK_COLOR))
    place = F.when(F.col("position") == "super", "superscript").when(F.col("position") == "sub", "subscript")
    font = escape(F.col("font"))
    props = F.concat(
        F.coalesce(F.concat(F.lit('<w:rFonts w:ascii="'), font, F.lit('" w:hAnsi="'), font, F.lit('" w:eastAsia="'), font, F.lit('"/>')), F.lit("")),
        _if(F.col("bold"), "<w:b/>"), _if(F.col("italic"), "<w:i/>"), _if(F.col("strike"), "<w:strike/>"), _if(F.col("underline") | link, '<w:u w:val="single"/>'),
        _tag("w:color", val=F.substring(tint, 2, 6)), _tag("w:vertAlign", val=place), _tag("w:sz", val=F.greatest(F.lit(2), F.round(F.col("size") * 2).cast("int")).cast("string")),
    )
    text = F.concat(F.lit("<w:r>"), F.when(props != "", F.concat(F.lit("<w:rPr>"), props, F.lit("</w:rPr>"))).otherwise(""), packages.docx_text(F.col("text")), F.lit("</w:r>"))
    note = F.concat(F.lit('<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:footnoteReference w:id="'), F.col("note"), F.lit('"/></w:r>'))
    field = F.concat(F.lit('<w:fldSimple w:instr="'), F.when(F.col("field") == "pages", " NUMPAGES ").otherwise(" PAGE "), F.lit('"><w:r><w:t>1</w:t></w:r></w:fldSimple>'))
    return runs.withColumn("xml", F.when(F.col("note").isNotNull(), note).when(F.col("field").isNotNull(), field).when(F.col("bin").isNotNull(), _docx_picture()).otherwise(text))


def _num(list_id: Column) -> Column:
    """A list's number in a docx: the outline's own is passed over."""
    return F.when(list_id >= OUTLINE_NUM, list_id + 1).otherwise(list_id)


def _emu(c: str) -> Column:
    """Points, 3 inches where a picture's size is unsaid."""
    return F.round(F.coalesce(F.col(c), F.lit(216.0)) * 12700).cast("long")


def _docx_picture() -> Column:
    size = lambda name: F.concat(F.lit(f"<{name} cx=\""), _emu("pic_width"), F.lit('" cy="'), _emu("pic_height"), F.lit('"/>'))
    named = lambda name: F.concat(F.lit(f"<{name} id=\""), F.col("bin"), F.lit('" name="image'), F.col("bin"), F.lit('"/>'))
    return F.concat(
        F.lit("<w:r><w:drawing><wp:inline>"), size("wp:extent"), named("wp:docPr"), F.lit(f'<a:graphic><a:graphicData uri="{packages.DRAWING}/picture"><pic:pic><pic:nvPicPr>'), named("pic:cNvPr"), F.lit('<pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rIdImage'), F.col("bin"),
        F.lit('"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/>'), size("a:ext"), F.lit('</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'),
    )


def write_docx(doc: Document) -> DataFrame:
    docs = doc.blocks.select("doc_id").distinct()
    links = parts.docx_links(doc.runs.filter("link is not null").select("doc_id", F.col("link").alias("href")))
    names, media = pictures(doc, "word/media")
    runs = _docx_runs(doc.runs.join(names, ["doc_id", "picture"], "left")).join(links.select("doc_id", F.col("href").alias("link"), "rid"), ["doc_id", "link"], "left")
    target = F.coalesce(F.concat(F.lit('<w:hyperlink r:id="'), F.col("rid"), F.lit('">')), F.concat(F.lit('<w:hyperlink w:anchor="'), escape(F.substr("link", F.lit(2))), F.lit('">')))
    inner = _linked(runs, target, "</w:hyperlink>")
    sizes = doc.runs.groupBy("doc_id", "ord").agg(F.max("size").alias("most"))  # the line is as high as the largest run
    rows = doc.blocks.join(inner, ["doc_id", "ord"], "left").join(sizes, ["doc_id", "ord"], "left")
    head = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    num = F.when(F.col("tag") == "li", _num(F.coalesce("list_id", F.lit(1)))).when(head.isNotNull() & F.col("numbered"), F.lit(OUTLINE_NUM))
    level = F.when(F.col("tag") == "li", F.coalesce("level", F.lit(0))).otherwise(head - 1)
    props = F.concat(_tag("w:pStyle", val=F.concat(F.lit("Heading"), head)), _if(F.col("page_break"), "<w:pageBreakBefore/>"), parts.docx_paragraph_properties(num, level, F.col("most"), head, F.col("align"), F.coalesce("left", F.lit(0.0)), F.coalesce("first_line", F.lit(0.0))))
    para = F.concat(F.lit("<w:p><w:pPr>"), props, F.lit("</w:pPr>"), F.coalesce("xml", F.lit("")), F.lit("</w:p>"))
    rows, table_rows = assemble(rows.select("doc_id", "ord", "tag", "band", "inside", para.alias("xml")), doc.cells, lambda cells: _rows_of(parts.docx_rows, cells), _around(*parts.DOCX_TABLE))
    ns = f"{packages.W_NS} {packages.DRAWING_NS}"
    band = lambda name: rows.filter(F.col("band") == name)
    has = docs.join(band("header").select("doc_id", F.lit(True).alias("h")).distinct(), "doc_id", "left").join(band("footer").select("doc_id", F.lit(True).alias("f")).distinct(), "doc_id", "left")
    refs = F.concat(_if(F.col("h"), '<w:headerReference w:type="default" r:id="rId10"/>'), _if(F.col("f"), '<w:footerReference w:type="default" r:id="rId11"/>'))
    sect = F.concat(F.lit("<w:sectPr>"), refs, F.lit('<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr></w:body></w:document>'))
    body = _body("word/document.xml", rows.filter("band is null"), has, f"{XML}<w:document {ns}><w:body>", sect, table_rows)
    lists = doc.blocks.filter("tag = 'li'").select("doc_id", _num(F.coalesce("list_id", F.lit(1))).alias("list_id"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered"))
    defined = parts.docx_lists(lists.groupBy("doc_id", "list_id", "level").agg(F.first("ordered").alias("ordered")))
    outline = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/></w:lvl>' for k, kind, text in parts.outline_levels())
    whole = lambda path, before, after: [_pieces(path, docs, seg, F.lit(0), xml=F.lit(x)) for seg, x in ((0, before), (9, after))]
    numbering = whole("word/numbering.xml", f'{XML}<w:numbering {ns}><w:abstractNum w:abstractNumId="{OUTLINE_NUM}">{outline}</w:abstractNum>', f'<w:num w:numId="{OUTLINE_NUM}"><w:abstractNumId w:val="{OUTLINE_NUM}"/></w:num></w:numbering>')
    numbering += [_pieces("word/numbering.xml", defined, seg, "list_id", xml=c) for seg, c in ((1, "abstract"), (2, "num"))]
    noted = doc.notes.select("doc_id").distinct().withColumn("xml", F.lit(parts.SEPARATORS))
    notes = [*whole("word/footnotes.xml", f"{XML}<w:footnotes {ns}>", "</w:footnotes>"), _pieces("word/footnotes.xml", noted, 1, F.lit(0)), _pieces("word/footnotes.xml", parts.docx_notes(doc.notes.withColumnRenamed("note", "n")), 2, "n")]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    relation = lambda i, name, path: f'<Relationship Id="{i}" Type="{rel}/{name}" Target="{path}"/>'
    fixed = "".join(relation(i, n, f"{n}.xml") for i, n in (("rId1", "styles"), ("rId2", "numbering"), ("rId3", "footnotes")))
    shown = names.select("doc_id", "bin", F.concat(F.lit('<Relationship Id="rIdImage'), F.col("bin"), F.lit(f'" Type="{rel}/image" Target="'), F.substring("path", 6, 1000), F.lit('"/>')).alias("xml")).distinct()
    rels = "word/_rels/document.xml.rels"
    of_bands = F.concat(_if(F.col("h"), relation("rId10", "header", "header1.xml")), _if(F.col("f"), relation("rId11", "footer", "footer1.xml")))
    relations = [*whole(rels, f'{XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{fixed}', "</Relationships>"), _pieces(rels, has, 1, F.lit(0), xml=of_bands), _pieces(rels, links, 2, F.substr("rid", F.lit(4))), _pieces(rels, shown, 3, "bin")]
    bands = [x for n, t in (("header", "hdr"), ("footer", "ftr")) for x in _body(f"word/{n}1.xml", band(n), band(n).select("doc_id").distinct(), f"{XML}<w:{t} {ns}>", f"</w:{t}>")]
    return package([*body, *numbering, *notes, *relations, *bands], packages.DOCX | {"[Content_Types].xml": packages.docx_content_types()}, media)


# ---- odt


def _odt_style(family: str, name: Column, inner: Column) -> Column:
    return F.concat(F.lit('<style:style style:name="'), name, F.lit(f'" style:family="{family}">'), inner, F.lit("</style:style>"))


def _odt_text_properties() -> Column:
    """Every value for western, asian and complex scripts alike."""
    three = lambda key, value: F.coalesce(F.concat(*[x for s in ("fo:{}", "style:{}-asian", "style:{}-complex") for x in (F.lit(f' {s.format(key)}="'), value, F.lit('"'))]), F.lit(""))
    one = lambda key, value: F.coalesce(F.concat(F.lit(f' {key}="'), value, F.lit('"')), F.lit(""))
    size = F.when(F.col("size").isNotNull(), F.format_string("%.2fpt", F.col("size")))
    return F.concat(
        F.lit("<style:text-properties"), three("font-weight", F.when(F.col("bold"), "bold")), three("font-style", F.when(F.col("italic"), "italic")), three("font-size", size), one("fo:color", F.when(F.col("color") != "#000000", F.col("color"))), one("fo:font-family", escape(F.col("font"))),
        one("style:text-underline-style", F.when(F.col("underline"), "solid")), one("style:text-line-through-style", F.when(F.col("strike"), "solid")), one("style:text-position", F.when(F.col("position").isNotNull(), F.concat(F.col("position"), F.lit(" 58%")))), F.lit("/>"),
    )


def _odt_list_levels(blocks: DataFrame) -> DataFrame:
    """(doc_id, list_id, xml): a list style for every list, its levels numbered or with the level's bullet."""
    each = blocks.filter("tag = 'li'").groupBy("doc_id", F.coalesce("list_id", F.lit(1)).alias("list_id"), F.coalesce("level", F.lit(0)).alias("level")).agg(F.coalesce(F.first("ordered"), F.lit(False)).alias("ordered"))
    n = F.col("level") + 1
    number = F.concat(F.lit('<text:list-level-style-number text:level="'), n, F.lit('" style:num-format="1" style:num-suffix="."/>'))
    bullet = F.concat(F.lit('<text:list-level-style-bullet text:level="'), n, F.lit('" text:bullet-char="'), F.element_at(F.array(*map(F.lit, BULLETS)), F.least(n, F.lit(3))), F.lit('"/>'))
    levels = each.withColumn("xml", F.when(F.col("ordered"), number).otherwise(bullet)).groupBy("doc_id", "list_id").agg(_joined("xml", "level").alias("xml"))
    return levels.withColumn("xml", F.concat(F.lit('<text:list-style style:name="L'), F.col("list_id"), F.lit('">'), F.col("xml"), F.lit("</text:list-style>")))


def write_odt(doc: Document) -> DataFrame:
    docs = doc.blocks.select("doc_id").distinct()
    text_styles, runs = intern(doc.runs, ["doc_id"], F.struct("ord", "run"), TEXT_STYLE, "style")
    para_styles, blocks = intern(doc.blocks, ["doc_id"], F.col("ord"), PARA_STYLE, "style")
    names, media = pictures(doc, "Pictures")
    runs = runs.join(doc.notes.select("doc_id", "note", F.col("text").alias("note_text")), ["doc_id", "note"], "left").join(names, ["doc_id", "picture"], "left")
    body = F.concat(F.lit('<text:span text:style-name="T'), F.col("style"), F.lit('">'), packages.odt_text(F.col("text")), F.lit("</text:span>"))
    note = F.concat(F.lit('<text:note text:note-class="footnote" text:id="ftn'), F.col("note"), F.lit('"><text:note-citation>'), F.col("note"), F.lit("</text:note-citation><text:note-body><text:p>"), packages.odt_text(F.coalesce("note_text", F.lit(""))), F.lit("</text:p></text:note-body></text:note>"))
    field = F.when(F.col("field") == "pages", "<text:page-count>1</text:page-count>").otherwise('<text:page-number text:select-page="current">1</text:page-number>')
    length = lambda c: F.format_string("%.2fpt", F.coalesce(F.col(c), F.lit(216.0)))
    frame = F.concat(F.lit('<draw:frame text:anchor-type="as-char" svg:width="'), length("pic_width"), F.lit('" svg:height="'), length("pic_height"), F.lit('"><draw:image xlink:href="'), F.col("path"), F.lit('" xlink:type="simple"/></draw:frame>'))
    runs = runs.withColumn("xml", F.when(F.col("note").isNotNull(), note).when(F.col("field").isNotNull(), field).when(F.col("bin").isNotNull(), frame).otherwise(body)).withColumn("rid", F.lit(None).cast("string"))
    inner = _linked(runs, F.concat(F.lit('<text:a xlink:type="simple" xlink:href="'), escape(F.col("link")), F.lit('">')), "</text:a>")
    rows = blocks.join(inner, ["doc_id", "ord"], "left")
    head = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1))
    named = F.concat(F.lit(' text:style-name="P'), F.col("style"), F.lit('">'))
    content = F.coalesce("xml", F.lit(""))
    para = F.when(head.isNotNull(), F.concat(F.lit('<text:h text:outline-level="'), head, F.lit('"'), _if(~F.coalesce("numbered", F.lit(False)), ' text:is-list-header="true"'), named, content, F.lit("</text:h>"))).otherwise(F.concat(F.lit("<text:p"), named, content, F.lit("</text:p>")))
    open_list = F.concat(F.lit('<text:list text:style-name="L'), F.coalesce("list_id", F.lit(1)), F.lit('">'))
    listed = lambda rows: nested_lists(rows, open_list, "</text:list>", "<text:list-item>", "</text:list-item>")
    cell_styles, cells = intern(doc.cells, ["doc_id"], F.struct("ord", "row", "col"), [*[f"b_{s}" for s in SIDES], *parts.FORMAT], "cell_style")
    rows, table_rows = assemble(rows.withColumn("xml", para), cells, lambda held: _rows_of(parts.odt_rows, held), _around(*parts.ODT_TABLE), listed)
    boxes = cell_styles.withColumn("xml", _odt_style("table-cell", F.concat(F.lit("C"), "cell_style"), parts.odt_cell_style()))
    texts = text_styles.withColumn("xml", _odt_style("text", F.concat(F.lit("T"), "style"), _odt_text_properties()))
    pt = lambda name, c: F.coalesce(F.concat(F.lit(f' fo:{name}="'), F.format_string("%.2fpt", F.when(F.col(c) != 0, F.col(c))), F.lit('"')), F.lit(""))
    margins = F.concat(F.lit("<style:paragraph-properties"), F.coalesce(F.concat(F.lit(' fo:text-align="'), F.col("align"), F.lit('"')), F.lit("")), F.when(F.col("left").isNotNull(), pt("margin-left", "left")).otherwise(""), F.when(F.col("first_line").isNotNull(), pt("text-indent", "first_line")).otherwise(""), _if(F.col("page_break"), ' fo:break-before="page"'), F.lit("/>"))
    paras = para_styles.withColumn("xml", _odt_style("paragraph", F.concat(F.lit("P"), "style"), margins))
    # both parts have all automatic styles: of texts, paragraphs, cells and lists
    both = F.explode(F.array(F.lit("content.xml"), F.lit("styles.xml")))
    automatic = [_pieces(both, df, seg, at) for seg, df, at in ((1, texts, "style"), (2, paras, "style"), (3, boxes, "cell_style"), (4, _odt_list_levels(doc.blocks), "list_id"))]
    ns, begin, end = packages.ODF_NS, "<office:automatic-styles>", "</office:automatic-styles>"
    start = lambda path, root: _pieces(path, docs, 0, F.lit(0), xml=F.lit(f'{XML}<office:document-{root} {ns} office:version="1.2">{begin}'))
    main = [start("content.xml", "content"), *_body("content.xml", rows.filter("band is null"), docs, f"{end}<office:body><office:text>", "</office:text></office:body></office:document-content>", table_rows, 5)]
    bands = rows.filter("band is not null").groupBy("doc_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == n, F.struct("ord", "xml")))), lambda x: x["xml"]), "").alias(n) for n in ("header", "footer")])
    some = lambda n: F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"<style:{n}>"), F.col(n), F.lit(f"</style:{n}>"))).otherwise("")
    master = F.concat(F.lit(f'{end}<office:master-styles><style:master-page style:name="Standard">'), some("header"), some("footer"), F.lit("</style:master-page></office:master-styles></office:document-styles>"))
    page = [start("styles.xml", "styles"), _pieces("styles.xml", docs.join(bands, "doc_id", "left"), 5, F.lit(0), xml=master)]
    entry = F.concat(F.lit('<manifest:file-entry manifest:full-path="'), F.col("path"), F.lit('" manifest:media-type="'), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in packages.MEDIA.items() for x in kv]), F.col("ext")), F.lit("application/octet-stream")), F.lit('"/>'))
    entries = names.select("doc_id", F.col("bin").alias("ord"), entry.alias("xml")).distinct()
    before, after = packages.odt_manifest(["content.xml", "styles.xml"]).rsplit("</manifest:manifest>", 1)[0], "</manifest:manifest>"
    return package([*automatic, *main, *page, *_body("META-INF/manifest.xml", entries, docs, before, after)], packages.ODT, media)


# ---- hwpx


def _hwpx_char(name: str) -> Column:
    font = F.coalesce(F.col("font_id"), F.lit(0))
    refs = F.concat(F.lit("<hh:fontRef"), *[x for g in packages.HWPX_LANGUAGES for x in (F.lit(f' {g.lower()}="'), font, F.lit('"'))], F.lit("/>"))
    flags = F.concat(_if(F.col("italic"), "<hh:italic/>"), _if(F.col("bold"), "<hh:bold/>"), _if(F.col("underline"), '<hh:underline type="BOTTOM" shape="SOLID" color="#000000"/>'), _if(F.col("strike"), '<hh:strikeout shape="SOLID" color="#000000"/>'), _if(F.col("position") == "super", "<hh:supscript/>"), _if(F.col("position") == "sub", "<hh:subscript/>"))
    return F.concat(F.lit('<hh:charPr id="'), F.col(name), F.lit('" height="'), F.coalesce(units.pt_to_units(F.col("size")), F.lit(1000)), F.lit('" textColor="'), F.coalesce("color", F.lit("#000000")), F.lit('">'), refs, flags, F.lit("</hh:charPr>"))


def _hwpx_lists(blocks: DataFrame) -> DataFrame:
    """(doc_id, list_id, xml): ten levels in every list's definition; a caret in the format makes it a number."""
    each = blocks.filter("tag = 'li'").groupBy("doc_id", F.coalesce("list_id", F.lit(1)).alias("list_id")).agg(F.map_from_entries(F.collect_set(F.struct(F.coalesce("level", F.lit(0)).alias("k"), F.coalesce("ordered", F.lit(False)).alias("v")))).alias("kinds"), F.coalesce(F.first("ordered"), F.lit(False)).alias("ordered"))

    def head(k: Column) -> Column:
        kind = F.coalesce(F.try_element_at("kinds", k - 1), F.col("ordered"))
        mark = F.when(kind, F.concat(F.lit("^"), k, F.lit("."))).otherwise(F.element_at(F.array(*map(F.lit, BULLETS)), F.least(k, F.lit(3))))
        return F.concat(F.lit('<hh:paraHead start="1" level="'), k, F.lit('" numFormat="DIGIT">'), mark, F.lit("</hh:paraHead>"))

    heads = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), head), "")
    return each.select("doc_id", "list_id", F.concat(F.lit('<hh:numbering id="'), F.col("list_id"), F.lit('" start="0">'), heads, F.lit("</hh:numbering>")).alias("xml"))


def _hwpx_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, ord, r, xml, cols)."""
    unit = lambda c: F.coalesce(units.pt_to_units(F.col(c)), F.lit(6000))
    para = parts._content(cells, F.concat(F.lit('<hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">'), packages.hwpx_text(F.col("text")), F.lit("</hp:run></hp:p>")))
    place = F.upper(F.when(F.col("valign") == "middle", "center").otherwise(F.coalesce("valign", F.lit("center"))))
    room = F.concat(F.lit("<hp:cellMargin"), *[x for s in ("left", "right", "top", "bottom") for x in (F.lit(f' {s}="'), F.coalesce(units.pt_to_units(F.col(f"p_{s}")), F.lit(0)), F.lit('"'))], F.lit("/>"))
    room = F.when(F.coalesce(*[f"p_{s}" for s in SIDES]).isNotNull(), room).otherwise("")
    xml = F.concat(F.lit('<hp:tc borderFillIDRef="'), F.col("fill") + 1, F.lit('"><hp:subList vertAlign="'), place, F.lit('">'), para, F.lit('</hp:subList><hp:cellAddr colAddr="'), F.col("col"), F.lit('" rowAddr="'), F.col("row"), F.lit('"/><hp:cellSpan colSpan="'), F.col("col_span"), F.lit('" rowSpan="'), F.col("row_span"), F.lit('"/><hp:cellSz width="'), unit("width"), F.lit('" height="1500"/>'), room, F.lit("</hp:tc>"))
    rows = cells.withColumn("xml", xml).groupBy("doc_id", "ord", "row").agg(_joined("xml", "col").alias("xml"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    return rows.select("doc_id", "ord", F.col("row").alias("r"), F.concat(F.lit("<hp:tr>"), F.col("xml"), F.lit("</hp:tr>")).alias("xml"), "cols")


def _hwpx_fill() -> Column:
    """A border fill; widths are the format's, and an unsaid border is none."""
    line = lambda s: F.concat(F.lit(f'<hh:{s}Border type="'), F.coalesce(parts.style_of("hwpx", s), F.lit("NONE")), F.lit('" width="'), F.format_string("%s mm", F.regexp_replace(F.coalesce(units.snap_border_mm(units.pt_to_mm(F.col(f"b_{s}.width"))), F.lit(0.1)).cast("string"), r"\.0$", "")), F.lit('" color="'), F.coalesce(F.col(f"b_{s}.color"), F.lit("#000000")), F.lit('"/>'))
    brush = F.coalesce(F.concat(F.lit('<hc:fillBrush><hc:winBrush faceColor="'), F.col("background"), F.lit('" hatchColor="#000000" alpha="0"/></hc:fillBrush>')), F.lit(""))
    return F.concat(F.lit('<hh:borderFill id="'), F.col("fill") + 1, F.lit('">'), *map(line, ("left", "right", "top", "bottom")), brush, F.lit("</hh:borderFill>"))


def _in_run(tag: str, xml: str) -> Column:
    """What stands in a paragraph: its runs, or one that holds a table."""
    return F.when(F.col(tag) == "table", F.concat(F.lit('<hp:run charPrIDRef="0">'), F.coalesce(xml, F.lit("")), F.lit("</hp:run>"))).otherwise(F.coalesce(xml, F.lit('<hp:run charPrIDRef="0"/>')))


def write_hwpx(doc: Document) -> DataFrame:
    docs = doc.blocks.select("doc_id").distinct()
    base = docs.select("doc_id", F.lit(-1).alias("ord"), F.lit(-1).alias("run"), F.lit("").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in RUN.items()])
    chars, runs = intern(doc.runs.select(*base.columns).unionByName(base), ["doc_id"], F.struct("ord", "run"), TEXT_STYLE, "shape")
    fonts, named = intern(chars.filter("font is not null"), ["doc_id"], F.col("shape"), ["font"], "font_nth")
    chars = chars.join(named.select("doc_id", "shape", (F.col("font_nth") + 1).alias("font_id")), ["doc_id", "shape"], "left")
    keys = [*PARA_STYLE[:3], "list_id", "level"]
    listed = doc.blocks.withColumn("list_id", F.when(F.col("tag") == "li", F.coalesce("list_id", F.lit(1)))).withColumn("level", F.when(F.col("tag") == "li", F.coalesce("level", F.lit(0))).when(F.col("tag").rlike("^h[1-6]$"), F.lit(-1) - F.substring("tag", 2, 1).cast("int")))
    plain = docs.select("doc_id", F.lit(-1).alias("ord"), *[F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in keys])
    shapes, blocks = intern(listed.select("doc_id", "ord", "tag", "band", "inside", "page_break", "numbered", *keys).unionByName(plain, allowMissingColumns=True), ["doc_id"], F.col("ord"), keys, "para")
    names, media = pictures(doc, "BinData")
    runs = runs.filter("ord >= 0").join(doc.notes.select("doc_id", "note", F.col("text").alias("note_text")), ["doc_id", "note"], "left").join(names, ["doc_id", "picture"], "left")
    run = lambda inner: F.concat(F.lit('<hp:run charPrIDRef="'), F.col("shape"), F.lit('">'), inner, F.lit("</hp:run>"))
    sub = lambda inner: F.concat(F.lit('<hp:subList><hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">'), inner, F.lit("</hp:run></hp:p></hp:subList>"))
    note = F.concat(F.lit('<hp:ctrl><hp:footNote number="'), F.col("note"), F.lit('">'), sub(packages.hwpx_text(F.coalesce("note_text", F.lit("")))), F.lit("</hp:footNote></hp:ctrl>"))
    field = F.concat(F.lit('<hp:ctrl><hp:autoNum num="1" numType="'), F.when(F.col("field") == "pages", "TOTAL_PAGE").otherwise("PAGE"), F.lit('"/></hp:ctrl>'))
    units_of = lambda c: F.coalesce(units.pt_to_units(F.col(c)), F.lit(21600))
    picture = F.concat(F.lit('<hp:pic textWrap="TOP_AND_BOTTOM"><hp:sz width="'), units_of("pic_width"), F.lit('" widthRelTo="ABSOLUTE" height="'), units_of("pic_height"), F.lit('" heightRelTo="ABSOLUTE"/><hp:pos treatAsChar="1"/><hc:img binaryItemIDRef="image'), F.col("bin"), F.lit('" bright="0" contrast="0" effect="REAL_PIC"/></hp:pic>'))
    runs = runs.withColumn("xml", run(F.when(F.col("note").isNotNull(), note).when(F.col("field").isNotNull(), field).when(F.col("bin").isNotNull(), picture).otherwise(packages.hwpx_text(F.col("text"))))).withColumn("rid", F.col("shape").cast("string"))
    begin = F.concat(F.lit('<hp:run charPrIDRef="0"><hp:ctrl><hp:fieldBegin type="HYPERLINK"><hp:parameters cnt="1"><hp:stringParam name="Command">'), escape(F.replace("link", F.lit(";"), F.lit("\\;"))), F.lit(";1;0;0;</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl></hp:run>"))
    inner = _linked(runs, begin, '<hp:run charPrIDRef="0"><hp:ctrl><hp:fieldEnd/></hp:ctrl></hp:run>')
    rows = blocks.filter("ord >= 0").join(inner, ["doc_id", "ord"], "left")
    start = F.concat(F.lit('<hp:p id="0" paraPrIDRef="'), F.col("para"), F.lit('" styleIDRef="0" pageBreak="'), F.when(F.coalesce("page_break", F.lit(False)), "1").otherwise("0"), F.lit('">'))
    listed = lambda rows: rows.withColumn("xml", F.when(F.col("inside").isNotNull(), F.concat("start", _in_run("tag", "xml"), F.lit("</hp:p>"))).otherwise(_in_run("tag", "xml")))
    none = docs.select("doc_id", F.lit(-1).alias("ord"), F.lit(-1).alias("row"), F.lit(-1).alias("col"))
    fills, cells = intern(doc.cells.unionByName(none, allowMissingColumns=True), ["doc_id"], F.struct("ord", "row", "col"), [*[f"b_{s}" for s in SIDES], "background"], "fill")
    fill_xml = fills.withColumn("xml", _hwpx_fill()).groupBy("doc_id").agg(_joined("xml", "fill").alias("b"), F.count("*").alias("bn"))
    around = F.concat(F.lit('<hp:tbl rowCnt="'), F.col("rows"), F.lit('" colCnt="'), F.col("cols"), F.lit('">')), F.lit("</hp:tbl>")
    rows, table_rows = assemble(rows.withColumn("start", start), cells.filter("ord >= 0"), _hwpx_rows, around, listed)
    rows = rows.withColumn("inner", F.col("xml"))
    # bands are controls in the document's first paragraph
    bands = rows.filter("band is not null").withColumn("xml", F.concat("start", "inner", F.lit("</hp:p>"))).groupBy("doc_id", "band").agg(_joined("xml", "ord").alias("xml"))
    control = F.concat(F.lit('<hp:run charPrIDRef="0"><hp:ctrl><hp:'), F.col("band"), F.lit("><hp:subList>"), F.col("xml"), F.lit("</hp:subList></hp:"), F.col("band"), F.lit("></hp:ctrl></hp:run>"))
    controls = bands.withColumn("xml", control).groupBy("doc_id").agg(_joined("xml", "band").alias("controls"))
    body = rows.filter("band is null").join(controls, "doc_id", "left").withColumn("first", F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) == 1)
    body = body.withColumn("xml", F.concat("start", F.when(F.col("first"), F.coalesce("controls", F.lit(""))).otherwise(""), "inner", F.lit("</hp:p>")))
    ns = packages.HP_NS
    section = _body("Contents/section0.xml", body, docs, f"{XML}<hs:sec {ns}>", "</hs:sec>", table_rows)
    char_xml = chars.withColumn("xml", _hwpx_char("shape")).groupBy("doc_id").agg(_joined("xml", "shape").alias("c"), F.count("*").alias("cn"))
    heading = F.when(F.col("list_id").isNotNull(), F.concat(F.lit('<hh:heading type="NUMBER" idRef="'), F.col("list_id"), F.lit('" level="'), F.col("level"), F.lit('"/>'))).when(F.col("level") < -1, F.concat(F.lit('<hh:heading type="OUTLINE" idRef="0" level="'), -2 - F.col("level"), F.lit('"/>'))).otherwise("")
    unit = lambda name, c: F.concat(F.lit(f'<hc:{name} value="'), F.coalesce(units.pt_to_units(F.col(c)), F.lit(0)), F.lit('" unit="HWPUNIT"/>'))
    shape = F.concat(F.lit('<hh:paraPr id="'), F.col("para"), F.lit('"><hh:align horizontal="'), F.upper(F.coalesce("align", F.lit("justify"))), F.lit('"/>'), heading, F.lit("<hh:margin>"), unit("intent", "first_line"), unit("left", "left"), F.lit("</hh:margin></hh:paraPr>"))
    paras, lists = shapes.withColumn("xml", shape), written(_hwpx_lists(doc.blocks), "lists")
    counted = paras.groupBy("doc_id").agg(F.count("*").alias("pn")).join(lists.groupBy("doc_id").agg(F.count("*").alias("ln")), "doc_id", "left")
    font_xml = fonts.withColumn("xml", F.concat(F.lit('<hh:font id="'), F.col("font_nth") + 1, F.lit('" face="'), escape(F.col("font")), F.lit('" type="TTF"/>'))).groupBy("doc_id").agg(_joined("xml", "font_nth").alias("f"), F.count("*").alias("fn"))
    head = docs.join(char_xml, "doc_id").join(counted, "doc_id").join(font_xml, "doc_id", "left").join(fill_xml, "doc_id")
    number = lambda c, plus=0: (F.coalesce(c, F.lit(0)) + plus).cast("string")
    faces = F.concat(*[x for g in packages.HWPX_LANGUAGES for x in (F.lit(f'<hh:fontface lang="{g}" fontCnt="'), number("fn", 1), F.lit(f'"><hh:font id="0" face="{BASE_FONT}" type="TTF"/>'), F.coalesce("f", F.lit("")), F.lit("</hh:fontface>"))])
    top = F.concat(
        F.lit(f'{XML}<hh:head {ns} version="1.4" secCnt="1"><hh:refList><hh:fontfaces itemCnt="7">'), faces, F.lit('</hh:fontfaces><hh:borderFills itemCnt="'), number("bn"), F.lit('">'), F.col("b"), F.lit('</hh:borderFills><hh:charProperties itemCnt="'), number("cn"), F.lit('">'), F.col("c"), F.lit('</hh:charProperties><hh:numberings itemCnt="'), number("ln"), F.lit('">'),
    )
    part, zero = "Contents/header.xml", F.lit(0)
    middle = F.concat(F.lit('</hh:numberings><hh:paraProperties itemCnt="'), number("pn"), F.lit('">'))
    header = [_pieces(part, head, 0, zero, xml=top), _pieces(part, lists, 1, "list_id"), _pieces(part, head, 2, zero, xml=middle), _pieces(part, paras, 3, "para"), _pieces(part, head, 4, zero, xml=F.lit("</hh:paraProperties></hh:refList></hh:head>"))]
    item = F.concat(F.lit('<opf:item id="image'), F.col("bin"), F.lit('" href="'), F.col("path"), F.lit('" media-type="'), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in packages.MEDIA.items() for x in kv]), F.col("ext")), F.lit("application/octet-stream")), F.lit('" isEmbeded="1"/>'))
    items = names.select("doc_id", F.col("bin").alias("ord"), item.alias("xml")).distinct()
    before, after = packages.HWPX["Contents/content.hpf"].split("</opf:manifest>")
    content = _body("Contents/content.hpf", items, docs, before, "</opf:manifest>" + after)
    return package([*section, *header, *content], packages.HWPX, media)


WRITERS = {"docx": write_docx, "odt": write_odt, "hwpx": write_hwpx}


def write(doc: Document, kind: str) -> DataFrame:
    """(doc_id, content): a package of the format for every document."""
    return WRITERS[kind](doc.stored())
