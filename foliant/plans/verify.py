"""Checks of written packages, as predicates over entries and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.sources.markup import package_nodes


def mimetype_rule(files: DataFrame) -> DataFrame:
    """(doc_id, ok): the first entry is mimetype and stored, told from the file's first bytes."""
    c = F.col("content")
    method = F.hex(c.substr(9, 2)) == "0000"
    return files.select("doc_id", ((c.substr(31, 8) == F.lit(b"mimetype")) & method).alias("ok"))


PARTS = r"(?s).*\.(xml|rels|hpf)"


def broken_parts(files: DataFrame) -> DataFrame:
    """(doc_id, part, error) of XML parts that are not well formed."""
    return package_nodes(files, PARTS, [], only=["#error"]).filter("name = '#error'").select("doc_id", "part", "error")


def lost_tokens(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, token): words of the blocks that no part of the package holds."""
    nodes = package_nodes(files, r"(?s).*\.xml", [], only=["#text"])
    split = lambda df: df.select("doc_id", F.explode(F.split("text", r"\s+")).alias("token")).filter("token <> ''").distinct()
    return split(blocks).join(split(nodes), ["doc_id", "token"], "left_anti")


def faults(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(broken, lost_tokens), one row: how many rows broken_parts and lost_tokens have. Packages are opened once, and texts
    are dealt by document once. A block that a text of the package equals has lost nothing, so words are compared only
    where a document has a block without its like."""
    nodes = package_nodes(files, PARTS, [], only=["#text", "#error"])
    row = lambda df, text, wanted, broken: df.select("doc_id", text.alias("text"), F.lit(wanted).alias("wanted"), F.lit(not wanted).alias("found"), broken.cast("long").alias("broken"))
    text = F.when((F.col("name") == "#text") & F.col("part").endswith(".xml"), F.col("text"))
    said = row(blocks, F.col("text"), True, F.lit(0)).unionByName(row(nodes, text, False, F.col("name") == "#error")).filter(F.col("text").rlike(r"\S") | (F.col("broken") > 0))
    both = [F.bool_or(c).alias(c) for c in ("wanted", "found")] + [F.sum("broken").alias("broken")]
    lines = said.repartition("doc_id").groupBy("doc_id", "text").agg(*both)
    lacks = F.bool_or(F.col("wanted") & ~F.col("found")).over(W.partitionBy("doc_id"))
    left = lines.withColumn("lacks", lacks).filter("lacks or broken > 0")
    words = left.select("doc_id", F.explode_outer(F.when(F.col("lacks"), F.split("text", r"\s+"))).alias("token"), "wanted", "found", "broken").groupBy("doc_id", "token").agg(*both)
    return words.agg(F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"), F.count_if((F.col("token") != "") & F.col("wanted") & ~F.col("found")).alias("lost_tokens"))


def same_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, same): two tables of (doc_id, html) are equal but for ids, styles and texts."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'\s(?:data-id|style|id)="[^"]*"', ""), ">[^<]+<", "><")
    other = b.select("doc_id", F.col("html").alias("_other"))
    return a.join(other, "doc_id").select("doc_id", (bare(F.col("html")) == bare(F.col("_other"))).alias("same"))


def kept_vocabulary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, name, before, after): element counts that a round trip changed."""
    count = lambda df, n: df.filter("name not like '#%'").groupBy("doc_id", "name").agg(F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), ["doc_id", "name"], "full")
    return both.fillna(0, ["before", "after"]).filter("before <> after")


def style_flags(runs: DataFrame) -> DataFrame:
    """(doc_id, any_bold, any_italic, any_underline, any_red, any_big): what a conversion must not lose."""
    red = F.col("color").rlike("(?i)^#(?:C0|D0|E0|F0|FF)[0-3][0-9A-F][0-3][0-9A-F]$")
    has = lambda c, n: F.bool_or(F.coalesce(c, F.lit(False))).alias(n)
    return runs.groupBy("doc_id").agg(has(F.col("bold"), "any_bold"), has(F.col("italic"), "any_italic"), has(F.col("underline"), "any_underline"), has(red, "any_red"), has(F.col("size") >= 1400, "any_big"))


def docx_invariants(files: DataFrame) -> DataFrame:
    """(doc_id, rule, n): what no docx may have, whatever its content: cells without a paragraph, paragraphs that do not end
    a cell, lists without a definition, links without a relationship, rows of other widths than their table's first."""
    from foliant.sources.document import docx_lists, docx_relations, shred

    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    shredded = shred(files, "docx")
    nodes = shredded.filter("part = 'word/document.xml'")
    of = lambda name: nodes.filter(F.col("name") == name)
    cells = of("tc").select("doc_id", F.col("node_id").alias("parent_id"))
    empty = cells.join(of("p").select("doc_id", "parent_id"), ["doc_id", "parent_id"], "left_anti")
    nums = of("numId").select("doc_id", attr("val").alias("num")).filter("num <> '0'")
    undefined = nums.join(docx_lists(shredded).select("doc_id", "num").distinct(), ["doc_id", "num"], "left_anti")
    links = of("hyperlink").select("doc_id", attr("id").alias("rid")).filter("rid is not null")
    dangling = links.join(docx_relations(shredded).select("doc_id", "rid").distinct(), ["doc_id", "rid"], "left_anti")
    spans = of("gridSpan").select("doc_id", F.col("parent_id").alias("pr"), attr("val").try_cast("int").alias("span"))
    props = of("tcPr").select("doc_id", F.col("node_id").alias("pr"), F.col("parent_id").alias("cell")).join(spans, ["doc_id", "pr"])
    rows = of("tc").select("doc_id", F.col("node_id").alias("cell"), F.col("parent_id").alias("tr")).join(props, ["doc_id", "cell"], "left").groupBy("doc_id", "tr").agg(F.sum(F.coalesce("span", F.lit(1))).alias("width"))
    widths = of("tr").select("doc_id", F.col("node_id").alias("tr"), F.col("parent_id").alias("tbl")).join(rows, ["doc_id", "tr"]).groupBy("doc_id", "tbl").agg(F.count_distinct("width").alias("widths")).filter("widths > 1")
    out = None
    for rule, found in (("cell without a paragraph", empty), ("list without a definition", undefined), ("link without a relationship", dangling), ("rows of different widths", widths)):
        one = found.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
