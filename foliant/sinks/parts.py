"""Parts of packages beside plain paragraphs: tables, links, lists, footnotes, as XML strings that Catalyst joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import units
from foliant.functions.text import BULLETS, OUTLINE, escape, xml_safe
from foliant.operators.tables import SIDES, covered


def _joined(value: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "")


def _para(text: Column) -> Column:
    return F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), escape(xml_safe(text)), F.lit("</w:t></w:r></w:p>"))


def _content(cells: DataFrame, of_text: Column) -> Column:
    """What a cell holds: the XML of its blocks (column body) if it has some, else its text."""
    return F.coalesce("body", of_text) if "body" in cells.columns else of_text


#: Values of a cell's format that are not its borders: padding by side in points, fill, and where its text stands.
FORMAT = {**{f"p_{s}": "double" for s in SIDES}, "background": "string", "valign": "string"}
# fixed values: the vocabulary's border styles in the formats
STYLES = {"docx": {"solid": "single", "dashed": "dashed", "dotted": "dotted", "double": "double", "none": "nil"}, "hwpx": {"solid": "SOLID", "dashed": "DASH", "dotted": "DOT", "double": "DOUBLE_SLIM", "none": "NONE"}}


def style_of(kind: str, side: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STYLES[kind].items() for x in kv]), F.col(f"b_{side}.style"))


def _docx_cell_format() -> Column:
    """tcBorders, shd, tcMar, vAlign: what is said, in the schema's order; an absent border is said to be nil."""
    line = lambda s: F.coalesce(F.concat(F.lit(f'<w:{s} w:val="'), style_of("docx", s), F.when(F.col(f"b_{s}.style") == "none", F.lit("")).otherwise(F.concat(F.lit('" w:sz="'), F.greatest(F.lit(2), F.round(F.col(f"b_{s}.width") * 8).cast("int")), F.lit('" w:color="'), F.coalesce(F.substring(F.col(f"b_{s}.color"), 2, 6), F.lit("auto")))), F.lit('"/>')), F.lit(""))
    room = lambda s: F.coalesce(F.concat(F.lit(f'<w:{s} w:w="'), units.pt_to_twips(F.col(f"p_{s}")), F.lit('" w:type="dxa"/>')), F.lit(""))
    order = ("top", "left", "bottom", "right")
    wrap = lambda tag, inner: F.when(inner != "", F.concat(F.lit(f"<w:{tag}>"), inner, F.lit(f"</w:{tag}>"))).otherwise("")
    fill = F.coalesce(F.concat(F.lit('<w:shd w:val="clear" w:color="auto" w:fill="'), F.substring("background", 2, 6), F.lit('"/>')), F.lit(""))
    place = F.coalesce(F.concat(F.lit('<w:vAlign w:val="'), F.when(F.col("valign") == "middle", "center").otherwise(F.col("valign")), F.lit('"/>')), F.lit(""))
    return F.concat(wrap("tcBorders", F.concat(*map(line, order))), fill, wrap("tcMar", F.concat(*map(room, order))), place)


def odt_cell_style() -> Column:
    """The style of a table cell, without its name."""
    line = lambda s: F.coalesce(F.concat(F.lit(f' fo:border-{s}="'), F.when(F.col(f"b_{s}.style") == "none", F.lit("none")).otherwise(F.concat(F.format_string("%.3fpt ", F.col(f"b_{s}.width")), F.col(f"b_{s}.style"), F.lit(" "), F.coalesce(F.col(f"b_{s}.color"), F.lit("#000000")))), F.lit('"')), F.lit(""))
    room = lambda s: F.coalesce(F.concat(F.lit(f' fo:padding-{s}="'), F.format_string("%.2fpt", F.col(f"p_{s}")), F.lit('"')), F.lit(""))
    fill = F.coalesce(F.concat(F.lit(' fo:background-color="'), F.col("background"), F.lit('"')), F.lit(""))
    place = F.coalesce(F.concat(F.lit(' style:vertical-align="'), F.col("valign"), F.lit('"')), F.lit(""))
    return F.concat(F.lit("<style:table-cell-properties"), *map(line, SIDES), *map(room, SIDES), fill, place, F.lit("/>"))


# fixed values: what stands around a table's rows
DOCX_TABLE, ODT_TABLE = ("<w:tbl><w:tblPr/>", "</w:tbl>"), ("<table:table>", "</table:table>")


def docx_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table, r, xml) of rows from cells (doc_id, table, row, col, row_span, col_span, width, text [, body]): places
    that a cell covers downwards get filler cells that continue its merge; a cell ends with a paragraph."""
    each = covered(cells).filter(F.col("c") == F.col("col"))
    first = F.col("r") == F.col("row")
    merge = F.when(F.col("row_span") > 1, F.when(first, '<w:vMerge w:val="restart"/>').otherwise("<w:vMerge/>")).otherwise("")
    held = _content(cells, _para(F.col("text")))
    width = F.concat(F.lit('<w:tcW w:w="'), units.pt_to_twips(F.coalesce("width", F.lit(60.0))), F.lit('" w:type="dxa"/>'))
    span = F.when(F.col("col_span") > 1, F.concat(F.lit('<w:gridSpan w:val="'), F.col("col_span"), F.lit('"/>'))).otherwise("")
    xml = F.concat(F.lit("<w:tc><w:tcPr>"), width, span, merge, _docx_cell_format() if "b_left" in cells.columns else F.lit(""), F.lit("</w:tcPr>"), F.when(first, F.when(held.endswith("</w:tbl>"), F.concat(held, F.lit("<w:p/>"))).otherwise(held)).otherwise("<w:p/>"), F.lit("</w:tc>"))
    return each.withColumn("xml", xml).groupBy("doc_id", "table", "r").agg(_joined("xml", "c").alias("xml")).withColumn("xml", F.concat(F.lit("<w:tr>"), F.col("xml"), F.lit("</w:tr>")))


def docx_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table, xml): whole tables."""
    return docx_rows(cells).groupBy("doc_id", "table").agg(F.concat(F.lit(DOCX_TABLE[0]), _joined("xml", "r"), F.lit(DOCX_TABLE[1])).alias("xml"))


def odt_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table, r, xml): covered places are elements of their own in ODF."""
    each = covered(cells)
    own = (F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))
    span = lambda c, n: F.when(F.col(c) > 1, F.concat(F.lit(f' table:number-{n}-spanned="'), F.col(c), F.lit('"'))).otherwise("")
    named = F.coalesce(F.concat(F.lit(' table:style-name="C'), F.col("cell_style"), F.lit('"')), F.lit("")) if "cell_style" in cells.columns else F.lit("")
    cell = F.concat(F.lit("<table:table-cell"), named, span("col_span", "columns"), span("row_span", "rows"), F.lit(">"), _content(cells, F.concat(F.lit("<text:p>"), escape(xml_safe(F.col("text"))), F.lit("</text:p>"))), F.lit("</table:table-cell>"))
    rows = each.withColumn("xml", F.when(own, cell).otherwise("<table:covered-table-cell/>")).groupBy("doc_id", "table", "r").agg(_joined("xml", "c").alias("xml"))
    return rows.withColumn("xml", F.concat(F.lit("<table:table-row>"), F.col("xml"), F.lit("</table:table-row>")))


def odt_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table, xml): whole tables."""
    return odt_rows(cells).groupBy("doc_id", "table").agg(F.concat(F.lit(ODT_TABLE[0]), _joined("xml", "r"), F.lit(ODT_TABLE[1])).alias("xml"))


def docx_links(links: DataFrame) -> DataFrame:
    """(doc_id, href, rid, xml): one relationship per external target, ids from rId100."""
    each = links.filter(~F.col("href").startswith("#")).select("doc_id", "href").distinct()
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("href")) + 99
    out = each.withColumn("rid", F.concat(F.lit("rId"), n))
    return out.withColumn("xml", F.concat(F.lit('<Relationship Id="'), F.col("rid"), F.lit('" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="'), escape(F.col("href")), F.lit('" TargetMode="External"/>')))


def docx_lists(lists: DataFrame) -> DataFrame:
    """(doc_id, list_id, abstract, num) from (doc_id, list_id, level, ordered)."""
    level = F.col("level")
    mark = F.when(F.col("ordered"), F.concat(F.lit("%"), level + 1, F.lit("."))).otherwise(F.element_at(F.array(*map(F.lit, BULLETS)), F.least(level + 1, F.lit(3))))
    kind = F.when(F.col("ordered"), "decimal").otherwise("bullet")
    lvl = F.concat(F.lit('<w:lvl w:ilvl="'), level, F.lit('"><w:start w:val="1"/><w:numFmt w:val="'), kind, F.lit('"/><w:lvlText w:val="'), mark, F.lit('"/></w:lvl>'))
    each = lists.select("doc_id", "list_id", "level", "ordered").distinct().withColumn("lvl", lvl).groupBy("doc_id", "list_id").agg(_joined("lvl", "level").alias("levels"))
    return each.withColumn("abstract", F.concat(F.lit('<w:abstractNum w:abstractNumId="'), F.col("list_id"), F.lit('">'), F.col("levels"), F.lit("</w:abstractNum>"))).withColumn("num", F.concat(F.lit('<w:num w:numId="'), F.col("list_id"), F.lit('"><w:abstractNumId w:val="'), F.col("list_id"), F.lit('"/></w:num>')))


def docx_numbering(lists: DataFrame) -> DataFrame:
    """(doc_id, xml) from (doc_id, list_id, level, ordered): abstract definitions first, ids ascending."""
    return docx_lists(lists).groupBy("doc_id").agg(F.concat(_joined("abstract", "list_id"), _joined("num", "list_id")).alias("xml"))


def outline_levels() -> list[tuple[int, str, str]]:
    """(level, number format, text) of the outline's definition."""
    return [(k, "ganada" if kind == "hangul" else "decimal", f"{before}%{k + 1}{after}") for k, (before, kind, after) in enumerate(OUTLINE)]


SEPARATORS = '<w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote><w:footnote w:type="continuationSeparator" w:id="0"><w:p/></w:footnote>'


def docx_notes(notes: DataFrame) -> DataFrame:
    """Adds xml to (doc_id, n, text)."""
    return notes.withColumn("xml", F.concat(F.lit('<w:footnote w:id="'), F.col("n"), F.lit('">'), _para(F.col("text")), F.lit("</w:footnote>")))


def docx_footnotes(notes: DataFrame) -> DataFrame:
    """(doc_id, xml) from (doc_id, n, text): the two separators, then the notes by number."""
    return docx_notes(notes).groupBy("doc_id").agg(F.concat(F.lit(SEPARATORS), _joined("xml", "n")).alias("xml"))


def docx_paragraph_properties(num_id: Column, level: Column, size: Column, heading: Column, align: Column, indent: Column, first_line: Column) -> Column:
    """Properties in the schema's order: numPr, spacing, jc, ind, outlineLvl; a negative first line hangs."""
    factor = F.when(heading.isNotNull(), F.lit(1.4)).otherwise(F.lit(1.6))
    line = F.round(F.coalesce(size, F.lit(10.0)) * factor * 20).cast("int")
    jc = F.element_at(F.create_map(*map(F.lit, ("left", "left", "right", "right", "center", "center", "justify", "both"))), align)
    first = F.when(first_line < 0, F.concat(F.lit(' w:hanging="'), units.pt_to_twips(-first_line), F.lit('"'))).when(first_line > 0, F.concat(F.lit(' w:firstLine="'), units.pt_to_twips(first_line), F.lit('"'))).otherwise("")
    return F.concat(
        F.coalesce(F.concat(F.lit('<w:numPr><w:ilvl w:val="'), level, F.lit('"/><w:numId w:val="'), num_id, F.lit('"/></w:numPr>')), F.lit("")),
        F.lit('<w:spacing w:line="'), line, F.lit('" w:lineRule="atLeast"/>'),
        F.coalesce(F.concat(F.lit('<w:jc w:val="'), jc, F.lit('"/>')), F.lit("")),
        F.when((indent != 0) | (first_line != 0), F.concat(F.lit('<w:ind w:left="'), units.pt_to_twips(indent), F.lit('"'), first, F.lit("/>"))).otherwise(""),
        F.coalesce(F.concat(F.lit('<w:outlineLvl w:val="'), heading - 1, F.lit('"/>')), F.lit("")),
    )


def row_heights_pt(cells: DataFrame, least: float = 15.0) -> DataFrame:
    """(doc_id, table, r, height): declared or estimated heights, shared over the rows that a cell spans."""
    from foliant.functions.text import height_pt

    need = F.greatest(F.coalesce("height", F.lit(0.0)), height_pt(F.col("text"), F.lit(10.0), F.greatest(F.coalesce("width", F.lit(60.0)), F.lit(10.0))))
    each = cells.withColumn("_share", need / F.col("row_span")).withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
    return each.groupBy("doc_id", "table", "r").agg(F.greatest(F.max("_share"), F.lit(least)).alias("height"))
