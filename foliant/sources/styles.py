"""Style tables of odt and hwpx packages, resolved once and joined to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import color, text, units
from foliant.operators.ordered import inherit
from foliant.operators.tables import SIDES
from foliant.sources import rules


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


ODT_VALUES = ["bold", "italic", "underline", "strike", "color", "size", "font", "position", "align", "left", "first_line", "page_break"]


def odt_styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, style, bold, ...): styles of both parts (content.xml's win over styles.xml's), with what they inherit."""
    styles = nodes.filter("name = 'style'").select("doc_id", "part", F.col("node_id").alias("node"), _attr("name").alias("style"), _attr("parent-style-name").alias("parent"))
    styles = styles.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "style").orderBy("part"))).filter("_n = 1").drop("_n")
    props = nodes.filter("name in ('text-properties', 'paragraph-properties')").select("doc_id", "part", F.col("parent_id").alias("node"), "name", "attrs")
    weight, line = _attr("font-weight"), _attr("text-underline-style")
    pick = lambda c: F.max(c)  # noqa: E731 - one of each per style
    read = props.groupBy("doc_id", "part", "node").agg(
        pick(F.when(weight.isNotNull(), (weight == "bold") | F.coalesce(weight.try_cast("int") >= 600, F.lit(False)))).alias("bold"),
        pick(_attr("font-style") == "italic").alias("italic"),
        pick(F.when(line.isNotNull(), line != "none")).alias("underline"),
        pick(F.when(_attr("text-line-through-style").isNotNull(), _attr("text-line-through-style") != "none")).alias("strike"),
        pick(F.coalesce(_attr("font-family"), _attr("font-name"))).alias("font"),
        pick(F.when(_attr("break-before").isNotNull(), _attr("break-before") == "page")).alias("page_break"),
        pick(color.to_hex(_attr("color"))).alias("color"),
        pick(units.odf_length(_attr("font-size"))).alias("size"),
        pick(text.text_position(_attr("text-position"))).alias("position"),
        pick(F.when(_attr("text-align").isin("start", "left"), "left").when(_attr("text-align").isin("end", "right"), "right").otherwise(_attr("text-align"))).alias("align"),
        pick(units.odf_length(_attr("margin-left"))).alias("left"),
        pick(units.odf_length(_attr("text-indent"))).alias("first_line"),
    )
    return inherit(styles.join(read, ["doc_id", "part", "node"], "left"), ODT_VALUES, ["doc_id"])


def odt_cell_styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, style, b_left, ..., p_left, ..., background, valign) of the styles of table cells: a side's own value, else the
    one that is said for all sides."""
    named = nodes.filter("name = 'style'").filter(_attr("family") == "table-cell").select("doc_id", "part", F.col("node_id").alias("parent_id"), _attr("name").alias("style"))
    named = named.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "style").orderBy("part"))).filter("_n = 1").drop("_n")

    def line(side: str) -> Column:
        said = F.coalesce(_attr(f"border-{side}"), _attr("border"))
        none = F.lower(F.trim(said)) == "none"
        kind = F.regexp_extract(said, r"\b(solid|dashed|dotted|double)\b", 1)
        width = units.odf_length(F.regexp_extract(said, r"([0-9.]+(?:pt|in|mm|cm|px|pc))", 1)).cast("double") / 100
        drawn = F.struct(F.when(none, "none").otherwise(rules.border_style(F.when(kind != "", kind).otherwise("solid"), "odt")).alias("style"), F.when(none, 0.0).otherwise(width).alias("width"), F.when(~none, color.to_hex(F.regexp_extract(said, r"(#[0-9A-Fa-f]{6})", 1))).alias("color"))
        return F.when(said.isNotNull(), drawn)

    room = lambda side: units.odf_length(F.coalesce(_attr(f"padding-{side}"), _attr("padding"))).cast("double")
    props = nodes.filter("name = 'table-cell-properties'").select("doc_id", "part", "parent_id", *[line(s).alias(f"b_{s}") for s in SIDES], *[room(s).alias(f"p_{s}") for s in SIDES], color.six_digits(_attr("background-color")).alias("background"), F.nullif(_attr("vertical-align"), F.lit("automatic")).alias("valign"))
    return named.join(props, ["doc_id", "part", "parent_id"]).drop("part", "parent_id")


def hwpx_shapes(nodes: DataFrame) -> dict[str, DataFrame]:
    """char(doc_id, ref, size, color, bold, italic), para(doc_id, ref, align, left, first_line): margins of a `case` branch
    are passed over for the default's."""
    nodes = nodes.filter("part = 'Contents/header.xml'")
    fonts = nodes.filter("name = 'font' and parent_name = 'fontface'").select("doc_id", _attr("id").alias("f"), F.col("parent_id"), _attr("face").alias("font"))
    faces = nodes.filter("name = 'fontface'").filter(_attr("lang") == "HANGUL").select("doc_id", F.col("node_id").alias("parent_id"))
    fonts = fonts.join(faces, ["doc_id", "parent_id"]).select("doc_id", "f", "font")
    has = lambda n: F.bool_or(F.col("name") == n)
    drawn = lambda n, key: F.bool_or((F.col("name") == n) & ~F.coalesce(_attr(key), F.lit("NONE")).isin("NONE", "3D"))
    flags = nodes.filter("parent_name = 'charPr'").groupBy("doc_id", F.col("parent_id").alias("node")).agg(
        has("bold").alias("bold"), has("italic").alias("italic"), drawn("underline", "type").alias("underline"), drawn("strikeout", "shape").alias("strike"), F.when(has("supscript"), "super").when(has("subscript"), "sub").alias("position"),
        F.max(F.when(F.col("name") == "fontRef", _attr("hangul"))).alias("f"),
    )
    flags = flags.join(fonts, ["doc_id", "f"], "left").drop("f")
    char = nodes.filter("name = 'charPr'").select("doc_id", F.col("node_id").alias("node"), _attr("id").alias("ref"), _attr("height").try_cast("int").alias("size"), color.six_digits(_attr("textColor")).alias("color"))
    char = char.join(flags, ["doc_id", "node"], "left").select("doc_id", "ref", F.coalesce("size", F.lit(1000)).alias("size"), F.coalesce("color", F.lit("#000000")).alias("color"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("bold", "italic", "underline", "strike")], "font", "position")
    para = nodes.filter("name = 'paraPr'").select("doc_id", F.col("node_id").alias("node"), _attr("id").alias("ref"))
    w = W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    inner = nodes.withColumn("node", F.last(F.when(F.col("name") == "paraPr", F.col("node_id")), ignorenulls=True).over(w)).filter(F.col("path").contains("paraPr") & ~F.col("path").rlike("(^|> )case"))
    value = _attr("value").try_cast("int")
    margins = inner.groupBy("doc_id", "node").agg(F.max(F.when(F.col("name") == "align", F.lower(_attr("horizontal")))).alias("align"), F.max(F.when(F.col("name") == "left", value)).alias("left"), F.max(F.when(F.col("name") == "intent", value)).alias("first_line"), *[F.max(F.when(F.col("name") == "heading", _attr(k))).alias(n) for k, n in (("type", "kind"), ("idRef", "list_ref"), ("level", "level"))])
    return {"char": char, "para": para.join(margins, ["doc_id", "node"], "left").select("doc_id", "ref", "align", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("first_line", F.lit(0)).alias("first_line"), "kind", "list_ref", F.col("level").try_cast("int").alias("level"))}
