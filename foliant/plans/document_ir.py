"""Between the IR and the tables of a document: pages read into blocks, runs, cells and notes, and written from them.

read_ir and emit_document are each other's inverse; with the readers and writers of
packages they turn any format into any other by way of the same tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import escape, visible
from foliant.operators.intervals import open_count
from foliant.operators.ordered import islands
from foliant.plans import ir, tree
from foliant.session import written_by_rows as written
from foliant.sinks import document as sink
from foliant.sinks.document import Document
from foliant.sources import document as source
from foliant.sources.markup import html_nodes, piece_nodes

HEADS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = ["p", *HEADS, "li", "table", "doc-footnote", "doc-pagebreak"]


def _joined(value: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "")


def _declared(*said: tuple[str, Column]) -> Column:
    """A style attribute of the declarations that have a value; empty if none has."""
    style = F.concat_ws(";", *[F.concat(F.lit(f"{name}:"), value) for name, value in said])
    return F.when(style != "", F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise("")


def _pt(value: Column) -> Column:
    return F.format_string("%.1fpt", value)


def _run_html(runs: DataFrame) -> DataFrame:
    lines = F.concat_ws(" ", F.when(F.col("underline"), "underline"), F.when(F.col("strike"), "line-through"))
    style = _declared(("font-size", F.when(F.col("size").isNotNull(), _pt(F.col("size")))), ("color", F.when(F.col("color") != "#000000", F.col("color"))), ("font-family", escape(F.col("font"))), ("font-style", F.when(F.col("italic"), "italic")), ("font-weight", F.when(F.col("bold"), "bold")), ("text-decoration", F.nullif(lines, F.lit(""))))
    inner = F.replace(F.replace(escape(F.col("text")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>"))
    span = F.when(style != "", F.concat(F.lit("<span"), style, F.lit(">"), inner, F.lit("</span>"))).otherwise(inner)
    placed = F.when(F.col("position") == "super", F.concat(F.lit("<sup>"), span, F.lit("</sup>"))).when(F.col("position") == "sub", F.concat(F.lit("<sub>"), span, F.lit("</sub>"))).otherwise(span)
    note = F.concat(F.lit('<sup><a data-fn-ref="fn'), F.col("note"), F.lit('">'), F.col("note"), F.lit(")</a></sup>"))
    field = F.concat(F.lit('<doc-field data-kind="'), F.col("field"), F.lit('"></doc-field>'))
    return runs.withColumn("xml", F.when(F.col("note").isNotNull(), note).when(F.col("field").isNotNull(), field).otherwise(placed)).withColumn("rid", F.lit(None).cast("string"))


def emission_ids(doc: Document) -> DataFrame:
    """(doc_id, kind, ord, a, b, id): numbers of blocks, of the paragraphs of cells without blocks (kind cell, at row a and
    column b of table ord) and of notes (kind note, note a), in the order in which they end: what is nested before what holds
    it, a note before the block that refers to it, headers before footers before the body. The paragraph that carries a
    table is not emitted, but has a number: the one after the table's.
    """
    rank = F.when(F.col("band") == "header", 0).when(F.col("band") == "footer", 1).otherwise(2)
    held = doc.cells.filter("cell is not null").select("doc_id", F.col("cell").alias("inside"), F.col("ord").alias("up"))
    step = written(doc.blocks.filter("inside is not null").join(held, ["doc_id", "inside"]).select("doc_id", "ord", "up"), "above")
    above = [step]
    while not above[-1].isEmpty():  # a round a level
        above.append(written(above[-1].join(step.select("doc_id", F.col("ord").alias("up"), F.col("up").alias("next")), ["doc_id", "up"]).select("doc_id", "ord", F.col("next").alias("up")), "above"))
    pairs = reduce(DataFrame.unionByName, above)
    ends = pairs.groupBy("doc_id", F.col("up").alias("ord")).agg(F.max("ord").alias("end"))
    blocks = doc.blocks.select("doc_id", "ord", "tag", rank.alias("rank")).join(ends, ["doc_id", "ord"], "left").withColumn("end", F.coalesce("end", "ord"))
    none = F.lit(None).cast("int")
    row = lambda df, kind, end, sub, a, b, weight=F.lit(1): df.select("doc_id", F.lit(kind).alias("kind"), "ord", "rank", end.alias("end"), F.lit(sub).alias("sub"), a.cast("int").alias("a"), b.cast("int").alias("b"), weight.alias("weight"))
    own = row(blocks, "block", F.col("end"), 2, -F.col("ord"), none, F.when(F.col("tag") == "table", 2).otherwise(1))
    filled = doc.blocks.filter("inside is not null").select("doc_id", F.col("inside").alias("cell")).distinct()
    empty = doc.cells.join(filled, ["doc_id", "cell"], "left_anti").select("doc_id", "ord", "row", "col").join(blocks.select("doc_id", "ord", "rank"), ["doc_id", "ord"])
    first = doc.runs.filter("note is not null").groupBy("doc_id", "note").agg(F.min("ord").alias("ord"))
    notes = doc.notes.select("doc_id", "note").join(first, ["doc_id", "note"], "left").join(blocks.select("doc_id", "ord", "rank"), ["doc_id", "ord"], "left")
    last = F.lit(2_147_483_647)  # of notes that nothing refers to
    rows = own.unionByName(row(empty, "cell", F.col("ord"), 0, F.col("row"), F.col("col"))).unionByName(row(notes.withColumn("rank", F.coalesce("rank", F.lit(3))), "note", F.coalesce("ord", last), 1, F.col("note"), none))
    w = W.partitionBy("doc_id").orderBy("rank", "end", "sub", "a", "b").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("id", F.sum("weight").over(w) - F.col("weight") + 1).select("doc_id", "kind", "ord", "a", "b", "id")


def emit_pieces(doc: Document, page_width: int = 59528, page_height: int = 84188) -> DataFrame:
    """(doc_id, seg, at, sub, xml): the pieces of a page for every document, in the order of seg, at and sub; no page is a
    string of its own. One section per document; lengths and sizes of the tables are points.

    Ids go in the order in which elements end (emission_ids). Links that are not safe are left out, and so are headers
    and footers without content.
    """
    doc = doc.stored()
    runs = doc.runs.filter("text <> '' or note is not null or field is not null")  # empty runs say nothing
    runs = runs.withColumn("link", F.when(ir.safe_href(F.col("link")), F.col("link")))
    inner = sink._linked(_run_html(runs), F.concat(F.lit('<a href="'), escape(F.col("link")), F.lit('">')), "</a>")
    ids = written(emission_ids(doc), "ids")
    numbered = doc.blocks.join(ids.filter("kind = 'block'").select("doc_id", "ord", "id"), ["doc_id", "ord"])
    cells = doc.cells.join(ids.filter("kind = 'cell'").select("doc_id", "ord", F.col("a").alias("row"), F.col("b").alias("col"), "id"), ["doc_id", "ord", "row", "col"], "left")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))).otherwise("")
    body = F.replace(escape(F.col("text")), F.lit("\n"), F.lit("<br>"))

    def rows_of(held: DataFrame) -> DataFrame:
        """(doc_id, ord, r, xml, cols): the rows of the tables that cells belong to; a cell holds its blocks, or a paragraph of its text."""
        own = F.coalesce("body", F.concat(F.lit('<p data-id="b'), F.col("id"), F.lit('">'), body, F.lit("</p>")))
        td = F.concat(F.lit("<td"), span("colspan", "col_span"), span("rowspan", "row_span"), _declared(("width", F.when(F.col("width").isNotNull(), _pt(F.col("width"))))), F.lit(">"), own, F.lit("</td>"))
        rows = held.withColumn("xml", td).groupBy("doc_id", "ord", "row").agg(_joined("xml", "col").alias("xml")).withColumn("xml", F.concat(F.lit("<tr>"), F.col("xml"), F.lit("</tr>")))
        return rows.select("doc_id", "ord", F.col("row").alias("r"), "xml", F.lit(None).cast("int").alias("cols"))

    each = numbered.join(inner, ["doc_id", "ord"], "left")
    style = _declared(("text-align", F.col("align")), ("margin-left", F.when(F.col("left") != 0, _pt(F.col("left")))), ("text-indent", F.when(F.col("first_line") != 0, _pt(F.greatest(F.col("first_line"), -F.coalesce("left", F.lit(0.0)))))))
    id_ = F.concat(F.lit(' data-id="b'), F.col("id"), F.lit('"'))
    item = F.concat(F.lit("<li"), id_, F.lit(">"))
    block = F.concat(F.lit("<"), F.col("tag"), id_, F.when(F.col("numbered") & F.col("tag").isin(*HEADS), ' data-num="outline"').otherwise(""), style, F.lit(">"), F.coalesce("xml", F.lit("")), F.lit("</"), F.col("tag"), F.lit(">"))
    block = F.concat(F.when(F.coalesce("page_break", F.lit(False)), "<doc-pagebreak></doc-pagebreak>").otherwise(""), block)
    each = each.withColumn("xml", F.when(F.col("tag") == "li", F.coalesce("xml", F.lit(""))).otherwise(block))
    ordered = F.coalesce("ordered", F.lit(False))
    whole = F.when(F.col("tag") == "table", F.concat(F.lit("<table"), id_, F.lit("><tbody>"), F.col("xml"), F.lit("</tbody></table>"))).otherwise(F.col("xml"))
    listed = lambda rows: sink.nested_lists(rows.withColumn("xml", whole), F.when(ordered, "<ol>").otherwise("<ul>"), (ordered, "</ol>", "</ul>"), item, "</li>")
    each, table_rows = sink.assemble(each, cells, rows_of, (F.lit(""), F.lit("")), listed)
    notes = doc.notes.join(ids.filter("kind = 'note'").select("doc_id", F.col("a").alias("note"), "id"), ["doc_id", "note"])
    note = F.concat(F.lit('<doc-footnote id="fn'), F.col("note"), F.lit('" data-id="b'), F.col("id"), F.lit('">'), body, F.lit("</doc-footnote>"))
    # a band that holds neither text nor a field would put an empty paragraph on every page
    said = runs.filter("trim(text) <> '' or field is not null or note is not null").join(doc.blocks.filter("band is not null").select("doc_id", "ord", "band"), ["doc_id", "ord"]).select("doc_id", "band", F.lit(True).alias("said")).distinct()
    each = written(each.join(said, ["doc_id", "band"], "left").filter("band is null or said"), "said")
    docs = each.select("doc_id").distinct()
    head = f'<doc-section data-ir="{ir.IR_VERSION}" class="hwp-page" style="width:{page_width / 7200:.3f}in;min-height:{page_height / 7200:.3f}in">'
    pieces = sink._body("html", each.filter("band is null"), docs, head, "", table_rows, first=3)
    pieces[0] = pieces[0].withColumn("seg", F.lit(0))  # the section begins before the header
    for b, first in (("header", 1), ("footer", 7)):
        band = each.filter(F.col("band") == b)
        pieces += sink._body("html", band, band.select("doc_id").distinct(), f"<doc-{b}>", f"</doc-{b}>", first=first)
    pieces.append(sink._pieces("html", notes.withColumn("xml", note).join(docs, "doc_id", "left_semi"), 10, "note"))
    pieces.append(sink._pieces("html", docs, 11, F.lit(0), xml=F.lit("</doc-section>")))
    return reduce(DataFrame.unionByName, pieces).filter("xml <> ''").select("doc_id", "seg", "at", "sub", "xml")


def emit_document(doc: Document, page_width: int = 59528, page_height: int = 84188) -> DataFrame:
    """(doc_id, html): the pages of emit_pieces, each as one string."""
    return emit_pieces(doc, page_width, page_height).groupBy("doc_id").agg(_joined("xml", "seg", "at", "sub").alias("html"))


def read_ir(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> Document:
    """The tables of IR pages, in points: styles inherited down the tree, neighbouring runs of one style merged."""
    return _read(html_nodes(pages, id_col, html_col, blocks=BLOCKS))


def read_pieces(pieces: DataFrame) -> Document:
    """The tables of IR pages that come in pieces, as emit_pieces makes them."""
    return _read(piece_nodes(pieces, blocks=BLOCKS))


def _read(nodes: DataFrame) -> Document:
    clone = F.coalesce(F.try_element_at("attrs", F.lit("data-pg")), F.lit(""))
    nodes = nodes.withColumn("bid", F.when(F.col("name").isin(*BLOCKS), F.col("node_id")).otherwise(F.col("block_id"))).filter(clone == "")
    # text that stands in no paragraph makes one of its own between the blocks around it
    nodes = tree.implicit_paragraphs(nodes).withColumn("bid", F.coalesce("implicit", "bid"))
    nodes = written(open_count(nodes, F.col("name").isin("ul", "ol"), ["doc_id"], "lists"), "nodes")
    attr, style = tree._attr, lambda prop: tree.text.style_prop(tree._attr("style"), prop)
    outers = nodes.filter("name in ('doc-header', 'doc-footer', 'doc-footnote')").select("doc_id", F.col("node_id").alias("outer_id"), F.col("name").alias("outer"))
    around = nodes.filter("name in ('td', 'th')").select("doc_id", F.col("node_id").alias("cell_id"), F.col("lists").alias("base"))
    known = nodes.join(outers, ["doc_id", "outer_id"], "left").join(around, ["doc_id", "cell_id"], "left").withColumn("lists", F.col("lists") - F.coalesce("base", F.lit(0)))
    band = F.when(F.col("outer").isin("doc-header", "doc-footer"), F.substring("outer", 5, 6))
    order = W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    top = F.last(F.when(F.col("name").isin("ul", "ol") & (F.col("lists") == 0), F.col("node_id")), ignorenulls=True).over(order)
    pt = lambda prop: tree.units.to_pt(style(prop))
    begins = F.col("name").isin("p", *HEADS, "li", "table", "doc-pagebreak") | (F.col("implicit") == F.col("node_id"))
    own = known.withColumn("top", top).filter(begins & (F.coalesce("outer", F.lit("")) != "doc-footnote"))
    marked = own.withColumn("page_break", F.coalesce(F.lag("name").over(W.partitionBy("doc_id").orderBy("node_id")) == "doc-pagebreak", F.lit(False))).filter("name <> 'doc-pagebreak'")
    is_li, made = F.col("name") == "li", F.coalesce(F.col("implicit") == F.col("node_id"), F.lit(False))
    shaped = marked.select("doc_id", "bid", F.when(made, "p").otherwise(F.col("name")).alias("tag"), F.when(is_li, F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.when(is_li, F.col("top"))))).alias("list_id"), F.when(is_li, F.col("lists") - 1).alias("level"), F.when(is_li, F.col("parent_name") == "ol").alias("ordered"), (F.coalesce(attr("data-num"), F.lit("")) == "outline").alias("numbered"), F.when(~made, style("text-align")).alias("align"), F.coalesce(F.when(~made, pt("margin-left")), F.lit(0.0)).alias("left"), F.coalesce(F.when(~made, pt("text-indent")), F.lit(0.0)).alias("first_line"), band.alias("band"), "page_break", F.col("cell_id").alias("inside"))
    blocks = written(shaped.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("bid")) - 1), "blocks")
    # a line break is a character of the text around it
    as_text = nodes.withColumn("text", F.when(F.col("name") == "br", F.lit("\n")).otherwise(F.col("text"))).withColumn("name", F.when(F.col("name") == "br", F.lit("#text")).otherwise(F.col("name")))
    said = tree.inherited_styles(as_text).drop("block_id", "text")
    refs = nodes.filter("name = 'a'").filter(attr("data-fn-ref").isNotNull()).select("doc_id", "bid", "node_id", F.lit(None).cast("string").alias("t"), F.regexp_extract(attr("data-fn-ref"), r"(\d+)$", 1).try_cast("int").alias("note"), F.lit(None).cast("string").alias("field"))
    fields = nodes.filter("name = 'doc-field'").select("doc_id", "bid", "node_id", F.lit(None).cast("string").alias("t"), F.lit(None).cast("int").alias("note"), attr("data-kind").alias("field"))
    hidden = nodes.filter("name = 'a'").filter(attr("data-fn-ref").isNotNull()).select("doc_id", F.col("node_id").alias("parent_id"))
    shown = nodes.filter("name in ('#text', 'br') and bid is not null").join(hidden, ["doc_id", "parent_id"], "left_anti")
    w = W.partitionBy("doc_id", "bid").orderBy("node_id")
    edge = lambda f: F.coalesce(f("name").over(w), F.lit("")) == ""
    words = F.when(F.col("name") == "br", F.lit("\n")).otherwise(visible(F.coalesce("text", F.lit("")), edge(F.lag), edge(F.lead)))
    texts = shown.select("doc_id", "bid", "node_id", words.alias("t"), F.lit(None).cast("int").alias("note"), F.lit(None).cast("string").alias("field")).filter("t <> ''")
    pieces = texts.unionByName(refs).unionByName(fields).join(said, ["doc_id", "node_id"], "left")
    look = {"bold": F.coalesce("bold", F.lit(False)), "italic": F.coalesce("italic", F.lit(False)), "underline": F.coalesce("underline", F.lit(False)), "strike": F.coalesce("strike", F.lit(False)), "color": F.coalesce("color", F.lit("#000000")), "size": F.coalesce("size_pt", F.lit(10.0)), "font": F.col("family"), "position": F.when(F.col("sup"), "super").when(F.col("sub"), "sub"), "link": F.col("link")}
    styled = pieces.select("doc_id", "bid", "node_id", "t", "note", "field", *[v.alias(k) for k, v in look.items()])
    merged = islands(styled, ["doc_id", "bid"], ["node_id"], [*look, "note", "field"], "run")
    runs = merged.groupBy("doc_id", "bid", "run", *look, "note", "field").agg(_joined("t", "node_id").alias("text"))
    runs = written(runs.withColumn("run", (F.col("run") - 1).cast("int")), "runs")
    notes = nodes.filter("name = 'doc-footnote'").select("doc_id", F.col("node_id").alias("outer_id"), F.regexp_extract(F.coalesce(attr("id"), F.lit("")), r"(\d+)$", 1).try_cast("int").alias("note"))
    within = nodes.filter("bid is not null").select("doc_id", "bid", F.when(F.col("name") == "doc-footnote", F.col("node_id")).otherwise(F.col("outer_id")).alias("outer_id")).distinct()
    bodies = runs.drop("note").join(within.join(notes, ["doc_id", "outer_id"]), ["doc_id", "bid"]).groupBy("doc_id", "note").agg(_joined("text", "bid", "run").alias("text"))
    starts = blocks.filter("tag = 'table'").select("doc_id", F.col("bid").alias("table"), "ord")
    placed = runs.join(blocks.select("doc_id", "bid", "ord"), ["doc_id", "bid"]).drop("bid")
    return Document(blocks.drop("bid"), placed, _grid(nodes, starts), bodies)


def _grid(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The cells of the tables that start blocks, at their places in the grid."""
    from foliant.operators.tables import occupy

    found = tree.table_cells(nodes.drop("bid")).select("doc_id", "table", "row", F.col("ord").alias("nth"), "row_span", "col_span", "width", "text", "cell")
    placed = found.join(starts, ["doc_id", "table"]).select("doc_id", "ord", "row", "nth", "row_span", "col_span", "width", "text", "cell")
    return occupy(placed.withColumnsRenamed({"ord": "block", "nth": "ord"}), ["doc_id", "block"]).drop("ord").withColumnRenamed("block", "ord")


def in_points(doc: Document) -> Document:
    """A document as read from a package, whose lengths are hwpunits, in the points that writers take."""
    blocks = doc.blocks.withColumns({c: F.col(c).cast("double") / 100 for c in ("left", "first_line")})
    cells = doc.cells if "ord" in doc.cells.columns else doc.cells.withColumnRenamed("table", "ord")
    points = lambda df, *columns: df.withColumns({c: F.col(c).cast("double") / 100 for c in columns})
    return Document(blocks, points(doc.runs, "size", "pic_width", "pic_height"), points(cells, "width") if "width" in cells.columns else cells, doc.notes, doc.images)


def to_ir(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, html): packages of a format read to IR pages."""
    return emit_document(in_points(source.read(files, kind)))


def to_pieces(files: DataFrame, kind: str) -> DataFrame:
    """The same pages in pieces."""
    return emit_pieces(in_points(source.read(files, kind)))


def from_ir(pages: DataFrame, kind: str, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, content): IR pages written as packages of a format."""
    return sink.write(read_ir(pages, id_col, html_col), kind)
