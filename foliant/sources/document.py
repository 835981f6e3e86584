"""Readers of whole documents: what the writers in sinks.document make, and what other programs write alike.

Every reader ends in the same tables:
    blocks(doc_id, ord, tag, level, ordered, numbered, align, left, first_line, band, page_break, inside, text)
    runs(doc_id, ord, run, text, bold, italic, underline, strike, color, size, font, position, link, note, field, picture, pic_width, pic_height)
    cells(doc_id, ord, cell, row, col, row_span, col_span, width, text), notes(doc_id, note, text), images(doc_id, image, ext, data)
Tables are blocks too; what a cell holds - paragraphs, lists, tables - are blocks whose
`inside` is the cell, to any depth. Lengths are hwpunits. A package is opened and shredded
once: all its parts are one node table, in which a node knows its nearest paragraph, cell
and outer part (note or band), so properties are one aggregation per paragraph, and runs
are windows over a paragraph's nodes. Bytes of pictures are read when they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import units
from foliant.operators.intervals import open_count
from foliant.operators.ordered import islands
from foliant.operators.tables import SIDES
from foliant.session import written_by_rows as written
from foliant.sinks.document import Document
from foliant.sources import packages, rules, styles
from foliant.sources.containers import zip_entries
from foliant.sources.markup import package_nodes

KEY = ["doc_id", "part", "bid"]
CELL_FORMAT = [*[f"b_{s}" for s in SIDES], *[f"p_{s}" for s in SIDES], "background", "valign"]
FORMAT = packages.FORMAT
#: What is shredded of a package: the parts, and the names of blocks, cells and outer parts in them.
SHRED = {
    "docx": (r"word/(document|styles|numbering|footnotes|header\d*|footer\d*)\.xml|word/_rels/document\.xml\.rels", ["p", "lvl", "num"], ["tc"], ["footnote"]),
    "odt": (r"content\.xml|styles\.xml", ["p", "h"], ["table-cell"], ["note", "header", "footer"]),
    "hwpx": (r"Contents/(header|section\d+)\.xml|Contents/content\.hpf", ["p", "paraHead"], ["tc"], ["footNote", "endNote", "header", "footer"]),
}
IMAGES = r"(?i).*\.(png|jpe?g|gif|bmp|tiff?|wmf|emf|svg)"


def _name() -> Column:
    return F.col("name")


def _attr(name: str) -> Column:
    return F.try_element_at(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.lit(name))


def _joined(value: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "")


def shred(files: DataFrame, kind: str) -> DataFrame:
    """The nodes of all parts of a format's packages that readers look at, in one scan, written. bid is the paragraph that
    a node belongs to (a paragraph to itself)."""
    parts, blocks, cells, outers = SHRED[kind]
    nodes = package_nodes(files, parts, blocks, cells, outers)
    return written(nodes.withColumn("bid", F.when(_name().isin(*blocks), F.col("node_id")).otherwise(F.col("block_id"))), "nodes")


def images_of(files: DataFrame) -> DataFrame:
    """(doc_id, image, ext, data): the pictures of packages, whether a paragraph names them or not."""
    return zip_entries(files, IMAGES).filter("error is null").select("doc_id", F.col("path").alias("image"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), "data")


def orphan_images(doc: Document) -> DataFrame:
    """(doc_id, image): pictures that no run shows."""
    return packages.orphan_entries(doc.images.select("doc_id", F.col("image").alias("path")), doc.runs.select("doc_id", F.col("picture").alias("path"))).withColumnRenamed("path", "image")


def _last(value: Column) -> Column:
    """The last value that is not null at or before a node of its paragraph."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*KEY).orderBy("node_id").rowsBetween(W.unboundedPreceding, 0))


def _pick(name: str, value: Column, parent: str | None = None) -> Column:
    return F.max(F.when((_name() == name) & (F.lit(True) if parent is None else F.col("parent_name") == parent), value))


def _finish(paras: DataFrame, runs: DataFrame, tables: DataFrame, grid: DataFrame, images: DataFrame, carriers: DataFrame | None = None, fillers: bool = False) -> Document:
    """Blocks and runs in document order.

    paras has `where` (body, header, footer or note) and cell_id, tables (KEY, where, cell_id) one row per table, grid one
    row per cell (doc_id, part, cell_id, table and its place); carriers are paragraphs that hold a table, no blocks if that
    is all. fillers: the empty paragraph that must end a cell after a table is no block either.
    """
    runs = written(runs, "runs")
    order = [packages.part_number(), "part", "cell_id"]
    grid = grid.withColumn("cell", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    plain = F.when(F.coalesce(F.col("note").cast("string"), "field", "picture").isNull(), F.struct("run", "text"))
    texts = runs.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(plain)), lambda x: x["text"]), "").alias("text"), F.lit(True).alias("said"))
    whole = paras.join(texts, KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))
    if carriers is not None:
        whole = whole.join(carriers.select(*KEY, F.lit(True).alias("carrier")), KEY, "left").filter("carrier is null or said").drop("carrier")
    whole = whole.unionByName(tables.withColumns({"tag": F.lit("table"), "text": F.lit("")}), allowMissingColumns=True)
    if fillers:
        w = W.partitionBy("doc_id", "part", "cell_id").orderBy("bid")
        filler = F.col("cell_id").isNotNull() & F.col("said").isNull() & (F.col("tag") == "p") & (F.lag("tag").over(w) == "table") & F.lead("tag").over(w).isNull()
        whole = whole.withColumn("filler", F.coalesce(filler, F.lit(False))).filter("not filler").drop("filler")
    whole = written(whole.drop("said"), "paragraphs")
    cells = whole.filter("cell_id is not null and tag <> 'table'").groupBy("doc_id", "part", "cell_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bid", "text"))), lambda x: x["text"]), "\n").alias("text"))
    shown = whole.filter("where in ('body', 'header', 'footer')").withColumn("band", F.when(F.col("where") != "body", F.col("where")))
    # what stands in a cell that a merge has swallowed goes with it
    placed = shown.join(grid.select("doc_id", "part", "cell_id", F.col("cell").alias("inside")), ["doc_id", "part", "cell_id"], "left").filter("cell_id is null or inside is not null")
    w = W.partitionBy("doc_id").orderBy(F.col("band").isNotNull(), "band", packages.part_number(), "part", "bid")
    blocks = written(placed.withColumn("ord", F.row_number().over(w) - 1).drop("where", "note", "cell_id"), "blocks")
    at = blocks.select(*KEY, "ord")
    starts = blocks.filter("tag = 'table'").select("doc_id", "part", F.col("bid").alias("table"), "ord")
    found = grid.join(starts, ["doc_id", "part", "table"]).join(cells, ["doc_id", "part", "cell_id"], "left")
    found = found.withColumn("text", F.coalesce("text", F.lit(""))).drop("part", "cell_id", "table")
    numbered = runs.join(at, KEY).withColumn("run", F.row_number().over(W.partitionBy("doc_id", "ord").orderBy("run")) - 1)
    notes = whole.filter("where = 'note' and note is not null and tag <> 'table'").groupBy("doc_id", "note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bid", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return Document(blocks.drop("part", "bid"), numbered.drop("part", "bid"), found, notes, images)


# ---- docx


def docx_lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, num, level, format): a list's number names a definition, the definition its levels: two hops."""
    nodes = nodes.filter("part = 'word/numbering.xml'")
    w = W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    lvl = nodes.withColumn("abstract", F.last(F.when(_name() == "abstractNum", _attr("abstractNumId")), ignorenulls=True).over(w))
    formats = lvl.filter("name = 'numFmt' and block_id is not null").select("doc_id", F.col("block_id").alias("node_id"), "abstract", _attr("val").alias("format"))
    levels = nodes.filter("name = 'lvl'").select("doc_id", "node_id", _attr("ilvl").try_cast("int").alias("level")).join(formats, ["doc_id", "node_id"])
    nums = nodes.filter("name = 'num'").select("doc_id", F.col("node_id").alias("num_id"), _attr("numId").alias("num"))
    of = nodes.filter("name = 'abstractNumId'").select("doc_id", F.col("block_id").alias("num_id"), _attr("val").alias("abstract"))
    return nums.join(of, ["doc_id", "num_id"]).join(levels, ["doc_id", "abstract"]).select("doc_id", "num", "level", "format")


def docx_relations(nodes: DataFrame) -> DataFrame:
    """(doc_id, rid, target, external)."""
    return nodes.filter("part = 'word/_rels/document.xml.rels' and name = 'Relationship'").select("doc_id", _attr("Id").alias("rid"), _attr("Target").alias("target"), F.coalesce(_attr("TargetMode") == "External", F.lit(False)).alias("external"))


def docx_defaults(nodes: DataFrame) -> DataFrame:
    """(doc_id, default_style, d_bold, ...): the paragraph style of paragraphs without one, and docDefaults."""
    nodes = nodes.filter("part = 'word/styles.xml'")
    named = nodes.groupBy("doc_id").agg(F.max(F.when((_name() == "style") & (_attr("type") == "paragraph") & _attr("default").isin("1", "true"), _attr("styleId"))).alias("default_style"))
    whole = nodes.filter("name = 'docDefaults'").select("doc_id", F.col("node_id").alias("low"), F.col("last_id").alias("high"))
    inner = nodes.join(whole, "doc_id").filter("node_id > low and node_id <= high")
    val = _attr("val")
    said = {"bold": _pick("b", packages._on(val)), "italic": _pick("i", packages._on(val)), "size": _pick("sz", units.half_points_to_units(val.try_cast("int"))), "font": _pick("rFonts", F.coalesce(_attr("eastAsia"), _attr("ascii"), _attr("hAnsi")))}
    return named.join(inner.groupBy("doc_id").agg(*[v.alias(f"d_{k}") for k, v in said.items()]), "doc_id", "left")


def _sides(value: Callable[[str], Column]) -> list[Column]:
    return [value(s) for s in SIDES]


def _border(style: Column, width: Column, tint: Column) -> Column:
    return F.when(style.isNotNull(), F.struct(style.alias("style"), width.cast("double").alias("width"), tint.alias("color")))


def _docx_cell_format(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, cell_id, b_left, ..., p_left, ..., background, valign): what a cell says itself, margins else by its table."""
    also = {"left": ("left", "start"), "right": ("right", "end"), "top": ("top",), "bottom": ("bottom",)}
    none = F.lower(_attr("val")).isin("nil", "none")
    line = _border(F.when(none, "none").otherwise(rules.border_style(_attr("val"), "docx")), F.when(none, 0.0).otherwise(units.eighths_to_pt(_attr("sz").try_cast("double"))), packages.color.six_digits(_attr("color")))
    room = units.twips_to_units(_attr("w").try_cast("int")).cast("double")
    of = lambda parent, value: lambda s: F.max(F.when((F.col("parent_name") == parent) & _name().isin(*also[s]), value))
    place = F.when(_attr("val") == "center", "middle").otherwise(_attr("val"))
    said = nodes.filter("cell_id is not null and parent_name in ('tcBorders', 'tcMar', 'tcPr')").groupBy("doc_id", "part", "cell_id").agg(*[c.alias(f"b_{s}") for s, c in zip(SIDES, _sides(of("tcBorders", line)))], *[c.alias(f"_{s}") for s, c in zip(SIDES, _sides(of("tcMar", room)))], _pick("shd", packages.color.six_digits(_attr("fill")), "tcPr").alias("background"), _pick("vAlign", place, "tcPr").alias("valign"))
    # a table's own margins: tblCellMar stands in the properties of the table
    mar = nodes.filter("name = 'tblCellMar'").select("doc_id", "part", F.col("node_id").alias("mar"), F.col("parent_id").alias("pr"))
    whose = mar.join(nodes.filter("name = 'tblPr'").select("doc_id", "part", F.col("node_id").alias("pr"), F.col("parent_id").alias("table")), ["doc_id", "part", "pr"])
    own = nodes.filter("parent_name = 'tblCellMar'").withColumn("mar", F.col("parent_id")).join(whose, ["doc_id", "part", "mar"])
    tables = own.groupBy("doc_id", "part", "table").agg(*[c.alias(f"t_{s}") for s, c in zip(SIDES, _sides(of("tblCellMar", room)))])
    cells = nodes.filter("name = 'tc'").select("doc_id", "part", F.col("node_id").alias("cell_id"), F.col("parent_id").alias("tr"))
    rows = nodes.filter("name = 'tr'").select("doc_id", "part", F.col("node_id").alias("tr"), F.col("parent_id").alias("table"))
    each = cells.join(rows, ["doc_id", "part", "tr"]).join(tables, ["doc_id", "part", "table"], "left").join(said, ["doc_id", "part", "cell_id"], "left")
    return each.select("doc_id", "part", "cell_id", *[f"b_{s}" for s in SIDES], *[rules.inherited_side(F.col(f"_{s}"), F.col(f"t_{s}")).cast("double").alias(f"p_{s}") for s in SIDES], "background", "valign")


def docx_grid(nodes: DataFrame) -> DataFrame:
    """(doc_id, part, cell_id, table, row, col, row_span, col_span, width): grid columns from spans, vertical merges folded."""
    from foliant.operators.tables import fold_vertical_merges, grid_columns

    tc = nodes.filter("name = 'tc'").select("doc_id", "part", F.col("node_id").alias("cell_id"), F.col("parent_id").alias("tr"))
    tr = nodes.filter("name = 'tr'").select("doc_id", "part", F.col("node_id").alias("tr"), F.col("parent_id").alias("table"))
    own = nodes.filter("name in ('gridSpan', 'vMerge', 'tcW') and parent_name = 'tcPr'")
    props = own.groupBy("doc_id", "part", "cell_id").agg(
        _pick("gridSpan", _attr("val").try_cast("int")).alias("col_span"), _pick("vMerge", F.coalesce(_attr("val"), F.lit("continue"))).alias("merge"), _pick("tcW", F.coalesce(_attr("type"), F.lit("dxa"))).alias("kind"), _pick("tcW", _attr("w")).alias("w")
    )
    cells = tc.join(tr, ["doc_id", "part", "tr"]).join(props, ["doc_id", "part", "cell_id"], "left").withColumn("col_span", F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)))
    cells = grid_columns(cells, ["doc_id", "part", "table", "tr"], "cell_id")
    ranked = cells.withColumn("row", F.dense_rank().over(W.partitionBy("doc_id", "part", "table").orderBy("tr")) - 1)
    folded = fold_vertical_merges(ranked, ["doc_id", "part", "table", "col"], "row")
    columns = nodes.filter("name = 'gridCol'").select("doc_id", "part", F.col("parent_id").alias("grid"), "node_id", units.twips_to_units(_attr("w").try_cast("int")).alias("w"))
    columns = columns.groupBy("doc_id", "part", "grid").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "w"))), lambda c: c["w"]).alias("columns"))
    columns = nodes.filter("name = 'tblGrid'").select("doc_id", "part", F.col("node_id").alias("grid"), F.col("parent_id").alias("table")).join(columns, ["doc_id", "part", "grid"]).drop("grid")
    spanned = F.aggregate(F.slice("columns", F.col("col").cast("int") + 1, F.col("col_span")), F.lit(0), lambda total, c: total + F.coalesce(c, F.lit(0)).cast("int"))
    width = rules.docx_cell_width(F.col("w"), F.col("kind"), F.when(spanned > 0, spanned)).cast("double")
    return folded.join(columns, ["doc_id", "part", "table"], "left").join(_docx_cell_format(nodes), ["doc_id", "part", "cell_id"], "left").select("doc_id", "part", "cell_id", "table", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("row_span").cast("int").alias("row_span"), "col_span", width.alias("width"), *CELL_FORMAT)


def _in_word(target: str) -> Column:
    """The path in the package of a relationship's target."""
    return F.concat(F.lit("word/"), F.regexp_replace(target, "^/?(word/)?", ""))


def read_docx(files: DataFrame) -> Document:
    shredded = shred(files, "docx")
    nodes = shredded.filter(F.col("part").rlike(r"^word/(document|footnotes|header\d*|footer\d*)\.xml$"))
    relations = written(docx_relations(shredded), "relations")
    val = _attr("val")
    twips = lambda *keys: units.twips_to_units(F.coalesce(*[_attr(k) for k in keys]).try_cast("int"))
    note = F.last(F.when((_name() == "footnote") & _attr("type").isNull(), _attr("id").try_cast("int")).when(_name() == "footnote", F.lit(-1)), ignorenulls=True).over(W.partitionBy("doc_id", "part").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0))
    marked = nodes.withColumn("in_note", F.when(F.col("part") == "word/footnotes.xml", note))
    paras = marked.filter("bid is not null").groupBy(*KEY).agg(
        F.max(F.when(_name() == "p", F.col("cell_id"))).alias("cell_id"), F.max("in_note").alias("note"), _pick("pStyle", val).alias("pstyle"), _pick("ilvl", val.try_cast("int"), "numPr").alias("ilvl"), _pick("numId", val, "numPr").alias("num"),
        _pick("outlineLvl", val, "pPr").alias("outline"), _pick("jc", rules.docx_align(val), "pPr").alias("align"), _pick("ind", twips("left", "start"), "pPr").alias("left"),
        _pick("ind", rules.docx_first_line(twips("firstLine"), twips("hanging")), "pPr").alias("first_line"), F.coalesce(_pick("pageBreakBefore", packages._on(val), "pPr"), F.lit(False)).alias("page_break"),
    )
    # bands are the parts that a section names, those of first pages aside
    refs = nodes.filter("name in ('headerReference', 'footerReference')").filter(F.coalesce(_attr("type"), F.lit("default")) != "first").select("doc_id", _attr("id").alias("rid"), F.regexp_extract("name", "^(header|footer)", 1).alias("band"))
    bands = refs.join(relations, ["doc_id", "rid"]).select("doc_id", _in_word("target").alias("part"), "band").distinct()
    lists = docx_lists(shredded)
    paras = paras.join(bands, ["doc_id", "part"], "left").join(lists.select("doc_id", "num", F.col("level").alias("ilvl"), "format"), ["doc_id", "num", "ilvl"], "left")
    head = rules.docx_heading(F.col("outline"), F.col("pstyle"))
    listed = F.coalesce(F.col("num"), F.lit("0")) != "0"
    tag = F.when(head.isNotNull(), F.concat(F.lit("h"), F.least(head, F.lit(6)))).when(listed, F.lit("li")).otherwise("p")
    where = F.when(F.col("part") == "word/footnotes.xml", F.when(F.col("note") > 0, "note")).when(F.col("part") != "word/document.xml", F.col("band")).otherwise("body")
    shaped = paras.select(*KEY, "note", "cell_id", "pstyle", where.alias("where"), tag.alias("tag"), F.when(tag == "li", F.coalesce("ilvl", F.lit(0))).alias("level"), F.when(tag == "li", F.coalesce(F.col("format") != "bullet", F.lit(True))).alias("ordered"), (head.isNotNull() & listed).alias("numbered"), "align", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("first_line", F.lit(0)).alias("first_line"), "page_break")
    # runs: a run's nodes follow it; what stands before the first run belongs to the paragraph's mark
    each = nodes.filter("bid is not null").withColumn("run", _last(F.when(_name() == "r", F.col("node_id")))).withColumn("link_ref", _last(F.when(_name() == "hyperlink", F.coalesce(_attr("id"), F.concat(F.lit("#"), _attr("anchor")))))).withColumn("instr", _last(F.when(_name() == "fldSimple", _attr("instr")))).filter("run is not null")
    piece = F.when((_name() == "#text") & (F.col("parent_name") == "t"), F.col("text")).when((_name() == "br") & (F.coalesce(_attr("type"), F.lit("")) != "page"), "\n").when(_name() == "tab", "\t")
    direct = {"bold": _pick("b", packages._on(val), "rPr"), "italic": _pick("i", packages._on(val), "rPr"), "underline": _pick("u", packages._on(val), "rPr"), "strike": _pick("strike", packages._on(val), "rPr"), "color": _pick("color", packages.color.six_digits(val), "rPr"), "size": _pick("sz", units.half_points_to_units(val.try_cast("int")), "rPr"), "font": _pick("rFonts", F.coalesce(_attr("eastAsia"), _attr("ascii"), _attr("hAnsi")), "rPr"), "position": _pick("vertAlign", F.when(val == "superscript", "super").when(val == "subscript", "sub"), "rPr")}
    runs = each.withColumn("t", piece).groupBy(*KEY, "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("node_id", "t")))), lambda x: x["t"]), "").alias("text"), *[v.alias(k) for k, v in direct.items()], _pick("rStyle", val, "rPr").alias("rstyle"), _pick("footnoteReference", _attr("id").try_cast("int")).alias("note"),
        F.max(F.when((_name() == "r") & (F.col("parent_name") == "hyperlink"), F.col("link_ref"))).alias("link_ref"), F.max(F.when((_name() == "r") & (F.col("parent_name") == "fldSimple"), rules.field_kind(F.col("instr")))).alias("field"),
        _pick("blip", _attr("embed")).alias("embed"), *[_pick("extent", units.emu_to_units(_attr(k).try_cast("long"))).cast("double").alias(n) for k, n in (("cx", "pic_width"), ("cy", "pic_height"))],
    )
    known = written(packages.docx_styles(shredded), "styles")
    side = lambda p: known.select("doc_id", F.col("style").alias(f"{p}style"), *[F.col(c).alias(f"{p}_{c}") for c in FORMAT])
    defaults = docx_defaults(shredded)
    runs = runs.join(shaped.select(*KEY, "pstyle"), KEY).join(defaults, "doc_id", "left").withColumn("pstyle", F.coalesce("pstyle", "default_style"))
    runs = runs.join(side("r"), ["doc_id", "rstyle"], "left").join(side("p"), ["doc_id", "pstyle"], "left").join(relations.select("doc_id", F.col("rid").alias("link_ref"), "target"), ["doc_id", "link_ref"], "left")
    runs = runs.join(relations.filter("not external").select("doc_id", F.col("rid").alias("embed"), _in_word("target").alias("picture")), ["doc_id", "embed"], "left")
    layers = lambda c: F.coalesce(c, f"r_{c}", f"p_{c}", *([f"d_{c}"] if c in ("bold", "italic", "size", "font") else []), *([F.lit(packages.DEFAULT[c])] if c in packages.DEFAULT else []))
    link = F.coalesce("target", F.when(F.col("link_ref").startswith("#"), F.col("link_ref")))
    done = runs.select(*KEY, "run", "text", *[layers(c).alias(c) for c in FORMAT], link.alias("link"), "note", "field", "picture", "pic_width", "pic_height").filter("text <> '' or note is not null or field is not null or picture is not null")
    tables = nodes.filter("name = 'tbl'").select("doc_id", "part", F.col("node_id").alias("bid"), "cell_id").join(bands, ["doc_id", "part"], "left")
    tables = tables.withColumn("where", F.when(F.col("part") == "word/document.xml", "body").otherwise(F.col("band"))).drop("band")
    return _finish(shaped.drop("pstyle"), done, tables, docx_grid(nodes), images_of(files), fillers=True)


# ---- odt


def odt_grid(nodes: DataFrame) -> DataFrame:
    """Cells by grid place: covered cells advance the column, repeated ones by as much as they say (512 at most)."""
    number = lambda k: F.greatest(F.coalesce(_attr(k).try_cast("int"), F.lit(1)), F.lit(1))
    cell = nodes.filter("name in ('table-cell', 'covered-table-cell')").select("doc_id", "part", F.col("node_id").alias("cell_id"), F.col("parent_id").alias("tr"), (_name() == "table-cell").alias("own"), _attr("style-name").alias("style"), number("number-columns-spanned").alias("col_span"), number("number-rows-spanned").alias("row_span"), F.least(number("number-columns-repeated"), F.lit(512)).alias("again"))
    w = W.partitionBy("doc_id", "part", "tr").orderBy("cell_id").rowsBetween(W.unboundedPreceding, -1)
    cell = cell.withColumn("col", F.coalesce(F.sum("again").over(w), F.lit(0)).cast("int"))
    rows = nodes.filter("name = 'table-row'").select("doc_id", "part", F.col("node_id").alias("tr"), F.col("parent_id").alias("table"))
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("doc_id", "part", "table").orderBy("tr")) - 1)
    known = styles.odt_cell_styles(nodes)
    return cell.filter("own").join(rows, ["doc_id", "part", "tr"]).join(known, ["doc_id", "style"], "left").select("doc_id", "part", "cell_id", "table", "row", "col", "row_span", "col_span", F.lit(None).cast("double").alias("width"), *CELL_FORMAT)


def _of_outer(nodes: DataFrame, number: Column) -> DataFrame:
    """(doc_id, part, outer_id, outer, in_note): the notes and bands that nodes may stand in."""
    return nodes.select("doc_id", "part", F.col("node_id").alias("outer_id"), _name().alias("outer"), number.alias("in_note"))


def read_odt(files: DataFrame) -> Document:
    nodes = shred(files, "odt")
    known = written(styles.odt_styles(nodes), "styles")
    number = F.regexp_extract(F.coalesce(_attr("id"), F.lit("")), r"(\d+)$", 1).try_cast("int")
    outers = _of_outer(nodes.filter("name in ('note', 'header', 'footer')"), F.when(_name() == "note", number))
    w = W.partitionBy("doc_id", "part").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    list_style = F.last(F.when((_name() == "list") & _attr("style-name").isNotNull(), _attr("style-name")), ignorenulls=True).over(w)
    marked = open_count(nodes, F.col("name") == "list", ["doc_id", "part"], "lists").withColumn("list_style", list_style)
    where = F.coalesce("outer", F.when(F.col("part") == "content.xml", "body"))
    own = marked.filter("name in ('p', 'h')").join(outers, ["doc_id", "part", "outer_id"], "left").withColumn("where", where).filter("where is not null")
    in_list = (F.col("lists") > 0) & (F.col("where") != "note")
    paras = own.select(*KEY, "where", "cell_id", F.col("in_note").alias("note"), _attr("style-name").alias("style"), F.when(_name() == "h", F.coalesce(_attr("outline-level").try_cast("int"), F.lit(1))).alias("head"), (F.coalesce(_attr("is-list-header"), F.lit("false")) != "true").alias("counted"), F.when(in_list, F.col("lists") - 1).alias("level"), "list_style")
    kinds = nodes.filter("name in ('list-level-style-number', 'list-level-style-bullet')").select("doc_id", "part", "parent_id", (_attr("level").try_cast("int") - 1).alias("level"), (_name() == "list-level-style-number").alias("ordered"))
    named = nodes.filter("name = 'list-style'").select("doc_id", "part", F.col("node_id").alias("parent_id"), _attr("name").alias("list_style"))
    lists = kinds.join(named, ["doc_id", "part", "parent_id"]).groupBy("doc_id", "list_style", "level").agg(F.bool_or("ordered").alias("ordered"))
    paras = paras.join(lists, ["doc_id", "list_style", "level"], "left").join(known.select("doc_id", "style", *[F.col(c).alias(f"p_{c}") for c in styles.ODT_VALUES]), ["doc_id", "style"], "left")
    tag = F.when(F.col("head").isNotNull(), F.concat(F.lit("h"), F.least("head", F.lit(6)))).when(F.col("level").isNotNull(), "li").otherwise("p")
    shaped = paras.select(*KEY, "note", "where", "cell_id", tag.alias("tag"), F.when(tag == "li", F.col("level")).alias("level"), F.when(tag == "li", F.coalesce("ordered", F.lit(True))).alias("ordered"), (F.col("head").isNotNull() & F.col("counted")).alias("numbered"), F.col("p_align").alias("align"), F.coalesce("p_left", F.lit(0)).alias("left"), F.coalesce("p_first_line", F.lit(0)).alias("first_line"), F.coalesce("p_page_break", F.lit(False)).alias("page_break"), *[f"p_{c}" for c in FORMAT])
    spaces = F.expr("repeat(' ', least(coalesce(try_cast(try_element_at(attrs, 'c') as int), 1), 256))")
    fields = F.when(_name() == "page-number", "page").when(_name() == "page-count", "pages")
    shown = F.when((_name() == "#text") & ~F.col("parent_name").isin("page-number", "page-count", "note-citation"), F.col("text")).when(_name() == "line-break", "\n").when(_name() == "tab", "\t").when(_name() == "s", spaces)
    # what stands in a link knows it by the link's interval
    until = _last(F.when(_name() == "a", F.col("last_id")))
    href = F.when(F.col("node_id") <= until, _last(F.when(_name() == "a", _attr("href"))))
    frame = lambda k: _last(F.when(_name() == "frame", units.odf_length(_attr(k)).cast("double")))
    pieces = nodes.filter("bid is not null").withColumn("href", href).withColumn("t", shown).withColumn("note", F.when(_name() == "note", number)).withColumn("field", fields)
    picture = F.when((_name() == "image") & (F.col("parent_name") == "frame"), F.regexp_replace(_attr("href"), r"^\./", ""))
    pieces = pieces.withColumn("picture", picture).withColumn("pic_width", F.when(picture.isNotNull(), frame("width"))).withColumn("pic_height", F.when(picture.isNotNull(), frame("height")))
    pieces = pieces.filter("t is not null or note is not null or field is not null or picture is not null")
    spans = nodes.filter("name = 'span'").select("doc_id", "part", F.col("node_id").alias("parent_id"), _attr("style-name").alias("style"))
    # a run is a stretch of pieces with one parent
    grouped = islands(pieces, KEY, ["node_id"], ["parent_id", "note", "field", "picture"], "run")
    runs = grouped.groupBy(*KEY, "run").agg(_joined("t", "node_id").alias("text"), F.max("href").alias("link"), *[F.max(c).alias(c) for c in ("note", "field", "picture", "pic_width", "pic_height", "parent_id")])
    runs = runs.join(spans, ["doc_id", "part", "parent_id"], "left").join(known.select("doc_id", "style", *[F.col(c).alias(f"s_{c}") for c in FORMAT]), ["doc_id", "style"], "left").join(shaped.select(*KEY, *[f"p_{c}" for c in FORMAT]), KEY)
    layers = lambda c: F.coalesce(f"s_{c}", f"p_{c}", *([F.lit(packages.DEFAULT[c])] if c in packages.DEFAULT else []))
    done = runs.select(*KEY, "run", "text", *[layers(c).alias(c) for c in FORMAT], "link", "note", "field", "picture", "pic_width", "pic_height")
    tables = nodes.filter("name = 'table'").join(outers, ["doc_id", "part", "outer_id"], "left").select("doc_id", "part", F.col("node_id").alias("bid"), "cell_id", where.alias("where"))
    return _finish(shaped.drop(*[f"p_{c}" for c in FORMAT]), done, tables, odt_grid(nodes), images_of(files))


# ---- hwpx


def hwpx_fills(nodes: DataFrame) -> DataFrame:
    """(doc_id, fill, b_left, ..., background): the border fills of the header."""
    nodes = nodes.filter("part = 'Contents/header.xml'")
    none = F.coalesce(_attr("type"), F.lit("NONE")) == "NONE"
    width = units.mm_to_pt(F.regexp_extract(F.coalesce(_attr("width"), F.lit("")), r"^([0-9.]+)", 1).try_cast("double"))
    line = _border(F.when(none, "none").otherwise(rules.border_style(_attr("type"), "hwpx")), F.when(none, 0.0).otherwise(width), packages.color.six_digits(_attr("color")))
    sides = nodes.filter("parent_name = 'borderFill'").groupBy("doc_id", F.col("parent_id").alias("node")).agg(*[_pick(f"{s}Border", line).alias(f"b_{s}") for s in SIDES])
    face = nodes.filter("name = 'winBrush'").join(nodes.filter("name = 'fillBrush'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("node")), ["doc_id", "parent_id"]).select("doc_id", "node", packages.color.six_digits(_attr("faceColor")).alias("background"))
    own = nodes.filter("name = 'borderFill'").select("doc_id", F.col("node_id").alias("node"), _attr("id").alias("fill"))
    return own.join(sides, ["doc_id", "node"], "left").join(face, ["doc_id", "node"], "left").drop("node")


def hwpx_grid(nodes: DataFrame, fills: DataFrame) -> DataFrame:
    """Cells by the address that they give."""
    own = ["doc_id", "part", "cell_id"]
    number = lambda name, key: F.max(F.when(_name() == name, _attr(key).try_cast("int")))
    cells = nodes.filter("name in ('cellAddr', 'cellSpan', 'cellSz') and parent_name = 'tc'").groupBy(*own).agg(number("cellAddr", "rowAddr").alias("row"), number("cellAddr", "colAddr").alias("col"), number("cellSpan", "rowSpan").alias("row_span"), number("cellSpan", "colSpan").alias("col_span"), number("cellSz", "width").cast("double").alias("width"))
    rooms = nodes.filter("name = 'cellMargin' and parent_name = 'tc'").select(*own, *[_attr(s).try_cast("double").alias(f"p_{s}") for s in SIDES])
    lists = nodes.filter("name = 'subList' and parent_name = 'tc'").select("doc_id", "part", F.col("parent_id").alias("cell_id"), F.lower(_attr("vertAlign")).alias("v"))
    tcs = nodes.filter("name = 'tc'").select("doc_id", "part", F.col("node_id").alias("cell_id"), F.col("parent_id").alias("tr"), _attr("borderFillIDRef").alias("fill"))
    trs = nodes.filter("name = 'tr'").select("doc_id", "part", F.col("node_id").alias("tr"), F.col("parent_id").alias("table"))
    placed = tcs.join(trs, ["doc_id", "part", "tr"]).join(cells, own).join(rooms, own, "left").join(lists, own, "left").join(fills, ["doc_id", "fill"], "left")
    return placed.withColumn("valign", F.when(F.col("v") == "center", "middle").otherwise(F.col("v"))).select(*own, "table", "row", "col", "row_span", "col_span", "width", *CELL_FORMAT)


def hwpx_lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_ref, level, ordered): a caret in a level's format makes it a number."""
    nodes = nodes.filter("part = 'Contents/header.xml'")
    w = W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    marked = nodes.withColumn("list_ref", F.last(F.when(_name() == "numbering", _attr("id")), ignorenulls=True).over(w)).withColumn("level", F.last(F.when(_name() == "paraHead", _attr("level").try_cast("int") - 1), ignorenulls=True).over(w))
    return marked.filter("name = '#text' and parent_name = 'paraHead'").select("doc_id", "list_ref", "level", F.col("text").contains("^").alias("ordered"))


def read_hwpx(files: DataFrame) -> Document:
    shredded = shred(files, "hwpx")
    nodes = shredded.filter(F.col("part").rlike(r"^Contents/section\d+\.xml$"))
    shapes = styles.hwpx_shapes(shredded)
    note_kinds = _name().isin("footNote", "endNote")
    outers = _of_outer(nodes.filter("name in ('footNote', 'endNote', 'header', 'footer')"), F.when(note_kinds, _attr("number").try_cast("int")))
    where = F.when(F.col("outer").isin("footNote", "endNote"), "note").otherwise(F.coalesce("outer", F.lit("body")))
    paras = nodes.filter("name = 'p'").join(outers, ["doc_id", "part", "outer_id"], "left").select(*KEY, where.alias("where"), "cell_id", F.col("in_note").alias("note"), _attr("paraPrIDRef").alias("ref"), F.coalesce(_attr("pageBreak") == "1", F.lit(False)).alias("page_break"))
    paras = paras.join(shapes["para"], ["doc_id", "ref"], "left").join(hwpx_lists(shredded), ["doc_id", "list_ref", "level"], "left")
    tag = F.when(F.col("kind") == "OUTLINE", F.concat(F.lit("h"), F.least(F.col("level") + 1, F.lit(6)))).when(F.col("kind").isin("NUMBER", "BULLET"), "li").otherwise("p")
    align = F.when(F.col("align") != "justify", F.col("align"))
    shaped = paras.select(*KEY, "note", "where", "cell_id", tag.alias("tag"), F.when(tag == "li", F.col("level")).alias("level"), F.when(tag == "li", F.coalesce("ordered", F.col("kind") == "NUMBER")).alias("ordered"), F.coalesce(F.col("kind") == "OUTLINE", F.lit(False)).alias("numbered"), align.alias("align"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("first_line", F.lit(0)).alias("first_line"), "page_break")
    command = F.when((_name() == "#text") & (F.col("parent_name") == "stringParam"), F.col("text")).when(_name() == "fieldEnd", F.lit(""))
    each = nodes.filter("bid is not null").withColumn("run", _last(F.when(_name() == "run", F.col("node_id")))).withColumn("command", _last(command)).filter("run is not null")
    in_text = F.col("parent_name") == "t"
    shown = F.when((_name() == "#text") & in_text, F.col("text")).when((_name() == "lineBreak") & in_text, "\n").when((_name() == "tab") & in_text, "\t").when((_name() == "fwSpace") & in_text, "　").when((_name() == "nbSpace") & in_text, " ")
    fields = F.when((_name() == "autoNum") & (_attr("numType") == "PAGE"), "page").when((_name() == "autoNum") & (_attr("numType") == "TOTAL_PAGE"), "pages")
    runs = each.withColumn("t", shown).groupBy(*KEY, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("node_id", "t")))), lambda x: x["t"]), "").alias("text"), _pick("run", _attr("charPrIDRef")).alias("ref"), F.max(F.when(F.col("t").isNotNull(), F.col("command"))).alias("command"), F.max(F.when(_name().isin("footNote", "endNote"), _attr("number").try_cast("int"))).alias("note"), F.max(fields).alias("field"), _pick("img", _attr("binaryItemIDRef")).alias("item"), *[_pick("sz", _attr(k).try_cast("double"), "pic").alias(f"pic_{k}") for k in ("width", "height")])
    # the manifest of the package says which file an item is
    items = shredded.filter("part = 'Contents/content.hpf' and name = 'item'").select("doc_id", _attr("id").alias("item"), F.regexp_replace(_attr("href"), r"^\./", "").alias("picture"))
    runs = runs.join(items.dropDuplicates(["doc_id", "item"]), ["doc_id", "item"], "left")
    href = F.replace(F.regexp_extract(F.coalesce("command", F.lit("")), r"^((?:[^;\\]|\\.)*)", 1), F.lit("\\;"), F.lit(";"))
    done = runs.join(shapes["char"], ["doc_id", "ref"], "left").select(*KEY, "run", "text", *FORMAT, F.when(href != "", href).alias("link"), "note", "field", "picture", "pic_width", "pic_height").filter("text <> '' or note is not null or field is not null or picture is not null")
    tbl = nodes.filter("name = 'tbl'").join(outers, ["doc_id", "part", "outer_id"], "left")
    tables = tbl.select("doc_id", "part", F.col("node_id").alias("bid"), "cell_id", where.alias("where"))
    return _finish(shaped, done, tables, hwpx_grid(nodes, hwpx_fills(shredded)), images_of(files), tbl.select(*KEY).distinct())


READERS = {"docx": read_docx, "odt": read_odt, "hwpx": read_hwpx}


def read(files: DataFrame, kind: str) -> Document:
    """The tables of packages (doc_id, content) of one format."""
    return READERS[kind](files)
