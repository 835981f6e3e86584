"""The document IR: a closed HTML vocabulary. Normalising, validating and emitting it over node rows.

Vocabularies are small constant tables; rules are filters, anti-joins and
windows over the nodes, united into one table of violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import escape, safe_href

# fixed values of the contract: allowed elements with their own attributes, style properties, blocks that need an id
ELEMENTS = {
    "doc-section": ["data-ir", "class"], "p": [], "h1": ["data-num"], "h2": ["data-num"], "h3": ["data-num"], "h4": ["data-num"], "h5": ["data-num"], "h6": ["data-num"],
    "table": ["class"], "tbody": [], "ul": [], "ol": [], "li": [], "tr": [], "td": ["colspan", "rowspan"], "doc-footnote": ["id"], "doc-textbox": ["data-anchor", "data-wrap"],
    "doc-eq": ["data-latex"], "doc-pagebreak": [], "doc-header": [], "doc-footer": [], "doc-field": ["data-kind"], "span": [], "br": [], "img": ["src", "alt"], "sup": [], "sub": [], "a": ["data-fn-ref", "href"],
}
STYLES = ["font-size", "color", "font-family", "font-style", "font-weight", "text-decoration", "text-align", "line-height", "width", "height", "min-height", "padding", "background", "float", "border", "vertical-align", "margin-left", "text-indent", "margin-top", "margin-bottom"]
ID_REQUIRED = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "table", "doc-footnote", "doc-textbox", "doc-eq"]
COMMON = ["data-id", "style"]
RENAMED = {"div": "p", "b": "span", "strong": "span", "i": "span", "em": "span", "u": "span", "s": "span", "strike": "span", "del": "span", "font": "span"}
STYLED = {"b": "font-weight:bold", "strong": "font-weight:bold", "i": "font-style:italic", "em": "font-style:italic", "u": "text-decoration:underline", "s": "text-decoration:line-through", "strike": "text-decoration:line-through", "del": "text-decoration:line-through"}
IR_VERSION = "0.2.0"


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize(nodes: DataFrame) -> DataFrame:
    """Legacy elements renamed, their meaning put into style; attributes and styles outside the vocabulary and unsafe
    links dropped; ids given to blocks that lack one."""
    old = F.col("name")
    name = F.coalesce(F.try_element_at(_map(RENAMED), old), old)
    own = F.concat_ws(";", F.try_element_at(_map(STYLED), old), F.when((old == "font") & _attr("color").isNotNull(), F.concat(F.lit("color:"), _attr("color"))))
    given = F.filter(F.transform(F.split(F.coalesce(_attr("style"), F.lit("")), ";"), lambda d: F.trim(F.regexp_replace(d, r"^\s*background-color\s*:", "background:"))), lambda d: F.trim(F.substring_index(d, ":", 1)).isin(*STYLES))
    style = F.concat_ws(";", F.when(own != "", own), F.when(F.size(given) > 0, F.array_join(given, ";")))
    allowed = F.create_map(*[x for k, v in ELEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, [*v, "data-id"])))])
    kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains(F.coalesce(F.try_element_at(allowed, name), F.array(F.lit("data-id"))), k) & ((k != "href") | safe_href(v)))
    out = nodes.withColumn("_name", name).withColumn("_attrs", F.when(style != "", F.map_concat(kept, F.create_map(F.lit("style"), style))).otherwise(kept))
    out = out.withColumn("name", F.col("_name")).withColumn("attrs", F.when(F.col("name") != "#text", F.col("_attrs"))).drop("_name", "_attrs")
    needs = F.col("name").isin(*ID_REQUIRED)
    number = F.regexp_extract(F.coalesce(_attr("data-id"), F.lit("")), r"^b(\d+)$", 1).try_cast("long")
    most = F.coalesce(F.max(number).over(W.partitionBy("doc_id")), F.lit(0))
    lacks = needs & _attr("data-id").isNull()
    nth = F.sum(lacks.cast("long")).over(W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("attrs", F.when(lacks, F.map_concat("attrs", F.create_map(F.lit("data-id"), F.concat(F.lit("b"), most + nth)))).otherwise(F.col("attrs")))


def validate(nodes: DataFrame) -> DataFrame:
    """doc_id, rule, message, path: the ten rules of the contract.

    All rules that a node and its parent decide are one projection; ids are
    counted by one window; footnotes are compared in one group per document.
    """
    name, parent = F.col("name"), F.coalesce("parent_name", F.lit(""))
    elements = nodes.filter("name not like '#%'").select("doc_id", "node_id", "name", "parent_name", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), "path")
    known, text = name.isin(*ELEMENTS), lambda c: F.coalesce(c, F.lit(""))
    needs, id_ = name.isin(*ID_REQUIRED), F.when(_attr("data-id") != "", _attr("data-id"))
    nth = F.row_number().over(W.partitionBy("doc_id", "_id").orderBy("node_id"))
    # nodes without an id are parted by their own number: no group gathers them
    numbered = elements.withColumn("_id", F.when(known & needs & id_.isNotNull(), F.concat(F.lit("="), id_)).otherwise(F.col("node_id").cast("string"))).withColumn("_nth", nth)
    must = {"tr": ["table", "tbody"], "tbody": ["table"], "td": ["tr"], "li": ["ul", "ol"], "doc-header": ["doc-section"], "doc-footer": ["doc-section"]}
    misplaced = F.lit(False)
    for child, allowed in must.items():
        misplaced = misplaced | ((name == child) & ~parent.isin(*allowed))
    wrong_child = (parent.isin("ul", "ol") & (name != "li")) | (parent.isin("table", "tbody") & (name != "tr") & ~((parent == "table") & (name == "tbody")))
    above = F.regexp_extract("path", "^(.*) > [^>]*$", 1)  # a wrong child is told of its parent
    inside_p = name.isin("p", "table", "ul", "ol", "doc-textbox", "doc-eq", "doc-pagebreak") & F.col("path").rlike("(^|> )p(#[^ ]*)? > ")
    p_path = F.regexp_extract("path", "^(.*?(?:^|> )p(?:#[^ ]*)?) > ", 1)
    link, field = name == "a", name == "doc-field"
    href = _attr("href")
    own = F.create_map(*[x for k, v in ELEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, [*v, *COMMON])))])
    found = lambda rule, message, path=None, key=None: F.struct(F.lit(rule).alias("rule"), message.alias("message"), (path if path is not None else F.col("path")).alias("path"), (key if key is not None else F.col("node_id").cast("string")).alias("key"))
    checks = [
        (~known, found("element-allowed", F.concat(F.lit("element not allowed: "), name))),
        (known & needs & id_.isNull(), found("block-id", F.lit("block without data-id"))),
        (known & needs & id_.isNotNull() & (F.col("_nth") > 1), found("block-id", F.concat(F.lit("data-id repeated: "), text(id_)))),
        (known & misplaced, found("structure", F.concat(name, F.lit(" is misplaced")))),
        (parent.isin(*ELEMENTS) & wrong_child, found("structure", F.concat(name, F.lit(" may not stand in "), parent), above)),
        (inside_p, found("structure", F.lit("block inside p"), p_path, F.lit("p"))),
        ((name == "doc-section") & (F.size(F.split("path", "doc-section")) > 2), found("structure", F.lit("doc-section is nested"))),
        (link & href.isNotNull() & (text(_attr("data-fn-ref")) != ""), found("link-target", F.lit("href and data-fn-ref together"))),
        (link & href.isNotNull() & ~safe_href(href), found("link-target", F.concat(F.lit("link target not allowed: "), text(href)))),
        (field & ~text(_attr("data-kind")).isin("page", "pages"), found("field-kind", F.lit("data-kind must be page or pages"))),
        (field & ~F.col("path").rlike("doc-(header|footer)"), found("field-kind", F.lit("doc-field stands in headers and footers only"))),
        (known & _attr("data-num").isNotNull() & (_attr("data-num") != "outline"), found("outline-scheme", F.lit("data-num must be outline"))),
        ((name == "doc-eq") & (text(_attr("data-latex")) == ""), found("eq-truth", F.lit("doc-eq without data-latex"))),
    ]
    single = F.array_compact(F.array(*[F.when(test, row) for test, row in checks]))
    keys = F.when(known, F.filter(F.map_keys("attrs"), lambda k: ~F.array_contains(own[name], k)))
    props = F.when(known, F.filter(F.transform(F.split(text(_attr("style")), ";"), lambda d: F.trim(F.substring_index(d, ":", 1))), lambda q: (q != "") & ~q.isin(*STYLES)))
    many = lambda values, rule, said: F.coalesce(F.transform(values, lambda v: found(rule, F.concat(F.lit(said), v), key=F.concat(F.col("node_id").cast("string"), F.lit(" "), v))), F.expr("cast(array() as array<struct<rule:string,message:string,path:string,key:string>>)"))
    rows = numbered.select("doc_id", F.explode(F.concat(single, many(keys, "attr-allowed", "attribute not allowed: "), many(props, "style-allowed", "style property not allowed: "))).alias("v")).select("doc_id", "v.*")
    ref = F.when((name == "a") & (text(_attr("data-fn-ref")) != ""), _attr("data-fn-ref"))
    body = F.when(name == "doc-footnote", _attr("id"))
    notes = elements.filter(ref.isNotNull() | body.isNotNull()).groupBy("doc_id").agg(F.collect_list(ref).alias("refs"), F.collect_set(body).alias("bodies"))
    lost = notes.select("doc_id", F.explode(F.filter("refs", lambda r: ~F.array_contains("bodies", r))).alias("ref"))
    pairs = lost.select("doc_id", F.lit("footnote-pair").alias("rule"), F.concat(F.lit("no doc-footnote for "), F.col("ref")).alias("message"), F.lit("(document)").alias("path"))
    # of the blocks inside one p only the p is told
    inner = F.row_number().over(W.partitionBy("doc_id", "key", "path", "message").orderBy("rule"))
    once = rows.withColumn("_n", F.when(F.col("key") == "p", inner).otherwise(1)).filter("_n = 1")
    return once.select("doc_id", "rule", "message", "path").unionByName(pairs)


def emit(blocks: DataFrame, page_width: int = 59528, page_height: int = 84188) -> DataFrame:
    """(doc_id, html): one section per document from blocks (doc_id, ord, tag, text [, style]); runs of li are one list."""
    from foliant.operators.ordered import islands

    style = F.coalesce(F.col("style") if "style" in blocks.columns else F.lit(None).cast("string"), F.lit(""))
    marked = islands(blocks.withColumn("_li", F.col("tag") == "li"), ["doc_id"], ["ord"], ["_li"], "_island")
    body = F.replace(F.replace(escape(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("\r"), F.lit(""))
    id_ = F.concat(F.lit("b"), F.row_number().over(W.partitionBy("doc_id").orderBy("ord")))
    each = marked.withColumn("_html", F.concat(F.lit("<"), F.col("tag"), F.lit(' data-id="'), id_, F.lit('"'), F.when(style != "", F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise(""), F.lit(">"), body, F.lit("</"), F.col("tag"), F.lit(">")))
    joined = lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda x: x[c]), "")
    lists = each.groupBy("doc_id", "_island", "_li").agg(F.min("ord").alias("ord"), joined("_html", "ord").alias("_html"))
    lists = lists.withColumn("_html", F.when(F.col("_li"), F.concat(F.lit("<ul>"), F.col("_html"), F.lit("</ul>"))).otherwise(F.col("_html")))
    size = f'<doc-section data-ir="{IR_VERSION}" class="hwp-page" style="width:{page_width / 7200:.3f}in;min-height:{page_height / 7200:.3f}in">'
    return lists.groupBy("doc_id").agg(F.concat(F.lit(size), joined("_html", "ord"), F.lit("</doc-section>")).alias("html"))


def standalone(html: Column) -> Column:
    """A page of its own around the sections, which know their number."""
    pages = F.regexp_count(html, F.lit("<doc-section"))
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><style>:root{--pages:'), pages, F.lit("}doc-section{display:block}</style></head><body>"), html, F.lit("</body></html>"))


def stats(blocks: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, chars, words): characters without line ends."""
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != ""))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("chars"), F.sum(words).alias("words"))


def blocks_of_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ord, tag, text): a paragraph per line."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("ord", "text")).select("doc_id", "ord", F.lit("p").alias("tag"), "text")


def visible_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, block_id, tag, text): what the nearest block ancestor of each text shows."""
    from foliant.functions.text import visible

    w = W.partitionBy("doc_id", "block_id").orderBy("node_id")
    shown = nodes.filter("name in ('#text', 'br') and block_id is not null")
    edge = lambda f: F.coalesce(f("name").over(w), F.lit("")).isin("")
    shown = shown.withColumn("t", F.when(F.col("name") == "br", F.lit("\n")).otherwise(visible(F.coalesce("text", F.lit("")), edge(F.lag), edge(F.lead))))
    texts = shown.groupBy("doc_id", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda x: x["t"]), "").alias("text"))
    tags = nodes.select("doc_id", F.col("node_id").alias("block_id"), F.col("name").alias("tag"))
    return texts.join(tags, ["doc_id", "block_id"])


def as_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): the blocks of each document as one array of objects, in order, without what they do not say."""
    rows = F.array_sort(F.collect_list(F.struct("ord", *[c for c in blocks.columns if c not in ("doc_id", "ord")])))
    return blocks.groupBy("doc_id").agg(F.to_json(rows).alias("json"))


def vocabulary_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The contract as tables: elements, their attributes, style properties."""
    return {
        "allowed_elements": spark.createDataFrame([(k,) for k in ELEMENTS], "name string"),
        "allowed_attrs": spark.createDataFrame([(k, a) for k, v in ELEMENTS.items() for a in v], "name string, attr string"),
        "allowed_styles": spark.createDataFrame([(s,) for s in STYLES], "prop string"),
    }
