"""Readers of zip packages: nodes joined, windowed and aggregated into blocks, runs, styles, sections and cells.

docx, odt and hwpx differ in names only where they say the same thing; each
reader maps its names and ends in the same tables:
    blocks(doc_id, ord, kind, level, style, text)
    runs(doc_id, ord, run, text, style, bold, italic, underline, color, size, link)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import color, units
from foliant.operators.ordered import inherit
from foliant.sources.markup import package_nodes

#: Parts with the text (a pattern), name of a paragraph, and what stands for a line break, a tab and repeated spaces.
BODY = {"docx": r"word/document\.xml", "odt": r"content\.xml", "hwpx": r"Contents/section\d+\.xml"}
PARAGRAPHS = {"docx": ["p"], "odt": ["p", "h"], "hwpx": ["p"]}
BREAKS = {"docx": ("br", "tab", None), "odt": ("line-break", "tab", "s"), "hwpx": ("lineBreak", "tab", None)}
TEXT_PARENT = {"docx": "t", "hwpx": "t", "odt": None}
A4 = (59528, 84188)
MARGIN = 7200


def nodes_of(files: DataFrame, kind: str) -> DataFrame:
    """The nodes of a package's text parts: of all sections."""
    return package_nodes(files, BODY[kind], PARAGRAPHS[kind])


def part_number(part: str = "part") -> Column:
    """The number in a part's name: section 10 comes after section 2."""
    return F.coalesce(F.regexp_extract(part, r"(\d+)\.xml$", 1).try_cast("int"), F.lit(0))


def attr(name: str) -> Column:
    return F.element_at("attrs", name)


def paragraphs(nodes: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ord, text) of the paragraphs in document order; breaks are newlines, tabs tabs. One pass over the nodes:
    a paragraph's own node makes its group, so that empty ones are there too."""
    br, tab, space = BREAKS[kind]
    own = F.col("name").isin(*PARAGRAPHS[kind])
    shown = F.when(F.col("name") == br, F.lit("\n")).when(F.col("name") == tab, F.lit("\t"))
    if space:
        shown = shown.when(F.col("name") == space, F.expr("repeat(' ', least(coalesce(try_cast(element_at(attrs, 'c') as int), 1), 256))"))
    words = F.col("name") == "#text"
    if TEXT_PARENT[kind]:
        words = words & (F.col("parent_name") == TEXT_PARENT[kind])
    shown = shown.when(words, F.col("text")).when(own, F.lit(""))
    parts = nodes.select("doc_id", "part", F.when(own, F.col("node_id")).otherwise(F.col("block_id")).alias("block_id"), "node_id", shown.alias("t")).filter("block_id is not null and t is not null")
    # dealt by document once, for the paragraphs and for their numbers; strings are joined in the group: runs of a paragraph are few
    out = parts.repartition("doc_id").groupBy("doc_id", "part", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda x: x["t"]), "").alias("text"))
    w = W.partitionBy("doc_id").orderBy(part_number(), "part", "block_id")
    return out.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), "block_id", "text")


def read_text(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ord, text) of packages of one format."""
    shown = ["#text", *PARAGRAPHS[kind], *filter(None, BREAKS[kind])]
    return paragraphs(package_nodes(files, BODY[kind], PARAGRAPHS[kind], only=shown), kind).select("doc_id", "ord", "text")


def read_any(files: DataFrame) -> DataFrame:
    """(doc_id, format, ord, text) of packages of any format: split by format, read, union."""
    out = None
    for kind in BODY:
        part = read_text(files.filter(F.col("format") == kind), kind).withColumn("format", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _children(nodes: DataFrame, parent: str, names: list[str]) -> DataFrame:
    return nodes.filter(F.col("name").isin(*names)).select("doc_id", "part", F.col("parent_id").alias(parent), "name", "attrs")


def _on(value: Column) -> Column:
    """Toggles: there without a value means on; 0, false and off mean off."""
    return ~F.lower(F.coalesce(value, F.lit("true"))).isin("0", "false", "off", "none")


def docx_properties(nodes: DataFrame, owner: str) -> DataFrame:
    """(doc_id, part, node, bold, italic, underline, color, size) of the rPr under each node named `owner`."""
    rpr = nodes.filter("name = 'rPr'").select("doc_id", "part", F.col("node_id").alias("rpr"), F.col("parent_id").alias("node"))
    own = nodes.filter(F.col("name") == owner).select("doc_id", "part", F.col("node_id").alias("node"))
    props = _children(nodes, "rpr", ["b", "i", "u", "strike", "color", "sz", "rFonts", "vertAlign", "rStyle"])
    val = attr("val")
    pick = lambda name, value: F.max(F.when(F.col("name") == name, value))
    out = rpr.join(own, ["doc_id", "part", "node"]).join(props, ["doc_id", "part", "rpr"])
    return out.groupBy("doc_id", "part", "node").agg(
        pick("b", _on(val)).alias("bold"),
        pick("i", _on(val)).alias("italic"),
        pick("u", _on(val)).alias("underline"),
        pick("color", color.six_digits(val)).alias("color"),
        pick("sz", units.half_points_to_units(val.try_cast("int"))).alias("size"),
        pick("strike", _on(val)).alias("strike"),
        pick("rFonts", F.coalesce(attr("eastAsia"), attr("ascii"), attr("hAnsi"))).alias("font"),
        pick("vertAlign", F.when(val == "superscript", "super").when(val == "subscript", "sub")).alias("position"),
        pick("rStyle", val).alias("rstyle"),
    )


FORMAT = ["bold", "italic", "underline", "strike", "color", "size", "font", "position"]
#: What a run is that says nothing.
DEFAULT = {"bold": False, "italic": False, "underline": False, "strike": False, "color": "#000000", "size": 1000}


def docx_styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, style, bold, ...): styles with what they inherit; missing ones of docDefaults come last."""
    nodes = nodes.filter("part = 'word/styles.xml'")
    styles = nodes.filter("name = 'style'").select("doc_id", "part", F.col("node_id").alias("node"), attr("styleId").alias("style"))
    based = _children(nodes, "node", ["basedOn"]).select("doc_id", "part", "node", attr("val").alias("parent"))
    out = styles.join(based, ["doc_id", "part", "node"], "left").join(docx_properties(nodes, "style").drop("rstyle"), ["doc_id", "part", "node"], "left")
    return inherit(out, FORMAT, ["doc_id"])


def docx_sections(files: DataFrame) -> DataFrame:
    """(doc_id, sec, width, height, left, right, top, bottom) in hwpunits, A4 and 1 inch where unsaid."""
    nodes = nodes_of(files, "docx")
    sect = nodes.filter("name = 'sectPr'").select("doc_id", "part", F.col("node_id").alias("node"))
    props = _children(nodes, "node", ["pgSz", "pgMar"])
    length = lambda name, key, default: F.coalesce(F.max(F.when(F.col("name") == name, units.twips_to_units(attr(key).try_cast("int")))), F.lit(default))
    out = sect.join(props, ["doc_id", "part", "node"], "left").groupBy("doc_id", "part", "node").agg(
        length("pgSz", "w", A4[0]).alias("width"), length("pgSz", "h", A4[1]).alias("height"), *[length("pgMar", k, MARGIN).alias(k) for k in ("left", "right", "top", "bottom")]
    )
    return out.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("node")) - 1).alias("sec"), "width", "height", "left", "right", "top", "bottom")


def orphan_entries(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Images of a package that its manifest does not name."""
    images = entries.filter(F.col("path").rlike(r"(?i)\.(png|jpe?g|gif|bmp|tif?f)$"))
    return images.join(manifest.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")


def dedup_binaries(entries: DataFrame) -> DataFrame:
    """(doc_id, bin, ext, sha, uses): binaries of equal extension and bytes as one; bytes stay where they are."""
    keyed = entries.select("doc_id", "path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"), F.sha2("data", 256).alias("sha"))
    groups = keyed.groupBy("doc_id", "ext", "sha").agg(F.min("path").alias("path"), F.count("*").alias("uses"))
    return groups.withColumn("bin", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1)
