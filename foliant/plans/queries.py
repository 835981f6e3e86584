"""The registered queries of the document engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import color, text, units
from foliant.operators import edits, layout, numbering, ordered, tables
from foliant.plans import ir
from foliant.session import discard, table, written
from foliant.sinks import packages as sink
from foliant.sources import containers, document, markup, packages
from foliant.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SAFE = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query("""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS paragraphs, length(replace(text, chr(10), ''))::BIGINT AS chars,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words,
  length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS solid_chars
FROM documents""")
def doc_paragraph_stats(spark, sf):
    docs = table(spark, sf, "documents")
    stats = docs.select("doc_id", "text")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    return stats.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("paragraphs"), F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long").alias("chars"), words.alias("words"), F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("solid_chars"))


def _roundtrip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    blocks = ir.blocks_of_text(table(spark, sf, "documents"))
    back = packages.read_text(written(sink.write(blocks, kind), "packages"), kind)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n")
    return back.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.md5(joined.cast("binary")).alias("text_md5"))


_ROUNDTRIP_SQL = f"""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS paragraphs, length(replace({_SAFE}, chr(10), ''))::BIGINT AS chars, md5({_SAFE}) AS text_md5 FROM documents"""


@query(_ROUNDTRIP_SQL)
def docx_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "docx")


@query(_ROUNDTRIP_SQL)
def odt_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "odt")


@query(_ROUNDTRIP_SQL)
def hwpx_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "hwpx")


def _dealt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of all documents, whose texts are dealt by document before they are cut, so that a writer that groups
    by document finds them in place."""
    return ir.blocks_of_text(table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"))


@query("""
SELECT kind, count(*)::BIGINT AS documents, 0::BIGINT AS pieces_missing FROM documents, (VALUES ('docx'), ('odt'), ('hwpx')) AS v(kind) GROUP BY kind""")
def conversion_matrix(spark, sf):
    """A format after the other: its packages are stored, read and deleted, and only its counts stay."""
    blocks, out = _dealt_blocks(spark, sf), None
    for kind in ("docx", "odt", "hwpx"):
        files = written(sink.write(blocks, kind), "packages")
        lost = sink.missing_text(blocks, packages.read_text(files, kind), ["doc_id"])
        one = written(lost.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("documents"), F.sum(F.size("missing")).alias("pieces_missing")), "counts")
        discard(files)
        out = one if out is None else out.unionByName(one)
    return out


def _mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of the three formats, plain text and damaged zips, of whole texts, by doc_id modulo 5."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    blocks = ir.blocks_of_text(docs)
    out = docs.filter("doc_id % 5 = 3").select("doc_id", F.col("text").cast("binary").alias("content"))
    out = out.unionByName(docs.filter("doc_id % 5 = 4").select("doc_id", F.concat(F.lit(b"PK"), F.col("text").cast("binary")).alias("content")))
    for k, kind in enumerate(("docx", "odt", "hwpx")):
        out = out.unionByName(sink.write(blocks.filter(F.col("doc_id") % 5 == k), kind))
    return out


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' WHEN 2 THEN 'hwpx' END AS format FROM documents""")
def sniff_formats(spark, sf):
    return containers.with_format(_mixed_files(spark, sf)).select("doc_id", "format")


@query("""
SELECT CASE WHEN doc_id % 5 < 3 THEN 'ok' ELSE 'rejected' END AS status, count(*)::BIGINT AS files FROM documents GROUP BY 1""")
def corpus_summary(spark, sf):
    from foliant.streaming.ingest import status

    return status(_mixed_files(spark, sf).withColumn("path", F.lit(""))).groupBy("status").agg(F.count("*").alias("files"))


_PLAIN_HTML = r"""regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '(<(script|style)[^>]*>).*?(</(script|style)>|$)', '\1', 'gs')"""
_TAGS = rf"""(SELECT page_id AS doc_id, lower(unnest(regexp_extract_all({_PLAIN_HTML}, '<([a-zA-Z][a-zA-Z0-9-]*)[^>]*>', 1))) AS tag FROM pages)"""


@query(f"SELECT tag, count(*)::BIGINT AS n FROM {_TAGS} GROUP BY tag")
def page_tag_histogram(spark, sf):
    nodes = markup.html_nodes(table(spark, sf, "pages"))
    return nodes.filter("name not like '#%'").groupBy(F.col("name").alias("tag")).agg(F.count("*").alias("n"))


_KNOWN = ", ".join(f"'{k}'" for k in ir.ELEMENTS)
_NEED_ID = ", ".join(f"'{k}'" for k in ir.ID_REQUIRED)


@query(f"""
SELECT doc_id, 'element-allowed' AS rule, count(*)::BIGINT AS n FROM {_TAGS} WHERE tag NOT IN ({_KNOWN}) GROUP BY doc_id
UNION ALL SELECT doc_id, 'block-id', count(*)::BIGINT FROM {_TAGS} WHERE tag IN ({_NEED_ID}) GROUP BY doc_id
UNION ALL SELECT doc_id, 'link-target', count(*)::BIGINT FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all({_PLAIN_HTML}, '<a[^>]*href="([^"]*)"', 1)) AS h FROM pages) WHERE NOT regexp_matches(h, '(?i)^(https?:|mailto:)|^#b[0-9]+$') GROUP BY doc_id""")
def page_violations(spark, sf):
    return ir.validate(markup.html_nodes(table(spark, sf, "pages"))).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query(f"""
SELECT page_id, count(*)::BIGINT AS links, count(*) FILTER (regexp_matches(h, '(?i)^(https?:|mailto:)|^#b[0-9]+$'))::BIGINT AS safe
FROM (SELECT page_id, unnest(regexp_extract_all({_PLAIN_HTML}, '<a[^>]*href="([^"]*)"', 1)) AS h FROM pages) GROUP BY page_id""")
def page_links_safe(spark, sf):
    links = markup.html_nodes(table(spark, sf, "pages")).filter("name = 'a'").select("doc_id", F.try_element_at("attrs", F.lit("href")).alias("href")).filter("href is not null")
    return links.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("links"), F.count_if(text.safe_href(F.col("href"))).alias("safe"))


@query(f"""
SELECT doc_id, count(*) FILTER (tag IN ('b', 'strong', 'i', 'em', 'u', 's', 'strike', 'del', 'font', 'span'))::BIGINT AS spans,
  count(*) FILTER (tag IN ('p', 'div'))::BIGINT AS paragraphs, count(*) FILTER (tag IN ({_NEED_ID}, 'div'))::BIGINT AS ids FROM {_TAGS} GROUP BY doc_id""")
def page_normalized_spans(spark, sf):
    nodes = ir.normalize(markup.html_nodes(table(spark, sf, "pages"))).filter("name not like '#%'")
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("name") == "span").alias("spans"), F.count_if(F.col("name") == "p").alias("paragraphs"), F.count_distinct(F.try_element_at("attrs", F.lit("data-id"))).alias("ids"))


@query("""
SELECT doc_id, i - 1 AS ord, 'b' || i AS data_id FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def block_ids(spark, sf):
    blocks = ir.blocks_of_text(table(spark, sf, "documents")).withColumn("data_id", F.lit(None).cast("string"))
    return numbering.assign_ids(blocks, ["doc_id"], ["ord"]).select("doc_id", F.col("ord").cast("long").alias("ord"), "data_id")


@query("""
SELECT user_id, data_id, event_id, nth FROM (SELECT user_id, 'b' || (event_id % 7) AS data_id, event_id, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS nth FROM events) WHERE nth > 1""")
def duplicate_block_ids(spark, sf):
    blocks = table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit("b"), F.col("event_id") % 7).alias("data_id"))
    return numbering.duplicate_ids(blocks, ["user_id"], ["event_id"])


@query(r"""
SELECT ch, count(*)::BIGINT AS documents FROM (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch""")
def used_chars(spark, sf):
    each = table(spark, sf, "documents").select("doc_id", F.explode(text.used_chars(F.col("text"))).alias("ch"))
    return each.groupBy("ch").agg(F.count_distinct("doc_id").alias("documents"))


@query("""SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS found FROM documents""")
def find_matches(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.count_found(F.col("text"), "the").alias("found"))


@query("""SELECT doc_id, md5(regexp_replace(text, 'the', '[$1]', 'gi')) AS text_md5 FROM documents""")
def replace_all(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.replace_found(F.col("text"), "the", "[$1]").cast("binary")).alias("text_md5"))


@query("""
WITH h AS (SELECT r_regionkey AS r, 0 AS n, 0 AS s, 1 AS level, r_name AS title FROM region
 UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, 2, n_name FROM nation
 UNION ALL SELECT n_regionkey, n_nationkey + 1, s_suppkey, 3, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT level, title, CASE level WHEN 1 THEN dense_rank() OVER (PARTITION BY level ORDER BY r) WHEN 2 THEN row_number() OVER (PARTITION BY level, r ORDER BY n) ELSE row_number() OVER (PARTITION BY level, r, n ORDER BY s) END AS n FROM h),
k AS (SELECT ['가','나','다','라','마','바','사','아','자','차','카','타','파','하'] AS g)
SELECT level, title, n::BIGINT AS n, CASE level WHEN 1 THEN n || '.' WHEN 2 THEN (CASE WHEN n <= 14 THEN g[n] ELSE g[((n - 1) // 14 - 1) % 14 + 1] || g[(n - 1) % 14 + 1] END) || '.' ELSE n || ')' END AS label FROM c, k""")
def outline_numbers(spark, sf):
    """One document: regions are its first level, their nations the second, the nations' suppliers the third."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    key = lambda *k: F.format_string("%06d-%06d-%09d", *k)
    zero = F.lit(0)
    heads = r.select(key(F.col("r_regionkey"), zero, zero).alias("path"), F.lit(1).alias("level"), F.col("r_name").alias("title"))
    heads = heads.unionByName(n.select(key(F.col("n_regionkey"), F.col("n_nationkey") + 1, zero).alias("path"), F.lit(2).alias("level"), F.col("n_name").alias("title")))
    deep = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(key(F.col("n_regionkey"), F.col("n_nationkey") + 1, F.col("s_suppkey") + 1).alias("path"), F.lit(3).alias("level"), F.col("s_name").alias("title"))
    return numbering.outline_numbers(heads.unionByName(deep), [], "path").select("level", "title", "n", "label")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem")
def list_numbers(spark, sf):
    return numbering.list_numbers(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT a.l_orderkey, a.l_linenumber, a.level, max(b.l_linenumber) AS parent
FROM (SELECT l_orderkey, l_linenumber, (min(l_partkey) % 3)::INTEGER AS level FROM lineitem GROUP BY ALL) a
LEFT JOIN (SELECT l_orderkey, l_linenumber, (min(l_partkey) % 3)::INTEGER AS level FROM lineitem GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level
GROUP BY ALL""")
def list_nesting(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 3).cast("int").alias("level"))
    return numbering.list_nesting(items, ["l_orderkey"], "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R'""")
def footnote_numbers(spark, sf):
    refs = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.floor(F.col("l_orderkey") / 100).alias("doc"))
    return numbering.footnote_numbers(refs, ["doc"], ["l_orderkey", "l_linenumber"]).drop("doc")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def footnote_orphans(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), "l_linenumber")
    bodies = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("note"))
    return ordered.orphans(refs, bodies, ["note"]).select(F.col("note").alias("l_orderkey"), "l_linenumber")


@query("""
WITH f AS (SELECT l_returnflag AS flag, l_linestatus AS status, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL),
d AS (SELECT flag, status, row_number() OVER (ORDER BY first) - 1 AS shape FROM f)
SELECT d.flag, d.status, shape::INTEGER AS shape, count(*)::BIGINT AS runs FROM d JOIN lineitem ON l_returnflag = flag AND l_linestatus = status GROUP BY ALL""")
def char_shape_intern(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    _, used = ordered.intern(runs, [], F.col("at"), ["flag", "status"])
    return used.groupBy("flag", "status", "shape").agg(F.count("*").alias("runs"))


@query("""
WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, event_type, island::BIGINT AS island, min(event_id) AS event_id, string_agg(left(event_type, 1), '' ORDER BY event_id) AS text, count(*)::BIGINT AS parts FROM i GROUP BY user_id, event_type, island""")
def run_merge(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.substring("event_type", 1, 1).alias("text"))
    return ordered.merge_runs(runs, ["user_id"], "event_id", ["event_type"])


@query("""
WITH p AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 3 = 0), q AS (SELECT user_id, event_id FROM events WHERE event_id % 3 <> 0)
SELECT q.user_id, q.event_id, coalesce(p.event_type, (SELECT arg_min(f.event_type, f.event_id) FROM p f WHERE f.user_id = q.user_id)) AS event_type FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.event_id >= p.event_id""")
def shape_asof(spark, sf):
    e = table(spark, sf, "events")
    return ordered.asof_join(e.filter("event_id % 3 <> 0").select("user_id", "event_id"), e.filter("event_id % 3 = 0").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"], first_if_none=True)


@query("""
WITH r AS (SELECT o_custkey % 10 AS g, o_orderkey * 4 AS s, o_orderkey * 4 + 2 AS e, o_orderkey FROM orders),
p AS (SELECT DISTINCT o_custkey % 10 AS g, o_orderkey * 4 + o_orderkey % 4 AS at FROM orders)
SELECT p.g, p.at, r.o_orderkey, 100000 + (p.at - r.s) * 2 AS fc FROM p JOIN r ON p.g = r.g AND p.at >= r.s AND p.at < r.e""")
def piece_range(spark, sf):
    o = table(spark, sf, "orders")
    pieces = o.select((F.col("o_custkey") % 10).alias("g"), (F.col("o_orderkey") * 4).alias("s"), (F.col("o_orderkey") * 4 + 2).alias("e"), "o_orderkey")
    points = o.select((F.col("o_custkey") % 10).alias("g"), (F.col("o_orderkey") * 4 + F.col("o_orderkey") % 4).alias("at")).distinct()
    found = ordered.range_join(points, pieces, ["g"], "at", "s", "e")
    return found.select("g", "at", "o_orderkey", (F.lit(100000) + (F.col("at") - F.col("s")) * 2).alias("fc"))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey - 1 END AS parent, CASE WHEN p_size % 3 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS font FROM part),
c AS (SELECT style, parent, size, font, 0 AS d FROM s UNION ALL SELECT c.style, s.parent, coalesce(c.size, s.size), coalesce(c.font, s.font), d + 1 FROM c JOIN s ON c.parent = s.style WHERE d < 12)
SELECT style, arg_max(size, d) AS size, arg_max(font, d) AS font FROM (SELECT style, d, size, font FROM c) GROUP BY style""")
def style_chain(spark, sf):
    p = table(spark, sf, "part")
    styles = p.select(F.lit(0).alias("doc"), F.col("p_partkey").alias("style"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_partkey") - 1).alias("parent"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("font"))
    return ordered.inherit(styles, ["size", "font"], ["doc"]).drop("doc")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity < 6 AND l_suppkey < l_partkey),
k AS (SELECT n_nationkey + 100 AS root, (n_nationkey + 100)::BIGINT AS node FROM nation UNION SELECT k.root, e.dst FROM k JOIN e ON e.src = k.node)
SELECT root::BIGINT AS root, count(*)::BIGINT AS glyphs, max(node) AS last FROM k GROUP BY root""")
def glyph_closure(spark, sf):
    edges = table(spark, sf, "lineitem").filter("l_quantity < 6 and l_suppkey < l_partkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    roots = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("root"), (F.col("n_nationkey") + 100).cast("long").alias("node"))
    return ordered.closure(roots, edges).groupBy("root").agg(F.count("*").alias("glyphs"), F.max("node").alias("last"))


@query("""
WITH c AS (SELECT n_regionkey AS t, n_nationkey AS r, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'restart' ELSE 'continue' END AS m FROM nation),
a AS (SELECT *, sum(CASE WHEN m = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY t ORDER BY r) AS k FROM c)
SELECT t, r, name, n AS row_span FROM (SELECT *, count(*) OVER (PARTITION BY t, k) AS n FROM a) WHERE m <> 'continue'""")
def vmerge_fold(spark, sf):
    cells = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), F.col("n_nationkey").alias("r"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "restart").otherwise("continue").alias("merge"))
    return tables.fold_vertical_merges(cells, ["t"], "r").drop("merge")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(sum(q % 4 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS col
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)""")
def grid_columns(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity").cast("long") % 4 + 1).alias("col_span"))
    return tables.grid_columns(cells, ["l_orderkey"], "l_linenumber").drop("col_span")


@query("""
WITH c AS (SELECT row_number() OVER () AS cell, l_orderkey AS t, l_linenumber AS k, l_quantity::BIGINT * 10 AS q FROM lineitem),
e AS (SELECT cell, t, k, 0 AS side, q AS edge FROM c UNION ALL SELECT cell, t, k, 1, q + k * 5 FROM c),
r AS (SELECT cell, t, k, side, dense_rank() OVER (PARTITION BY t ORDER BY edge) - 1 AS rank FROM e)
SELECT t, k, min(rank) AS col, max(rank) - min(rank) AS col_span FROM r GROUP BY cell, t, k""")
def common_grid(spark, sf):
    q = F.col("l_quantity").cast("long") * 10
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("k"), q.alias("left"), (q + F.col("l_linenumber") * 5).alias("right"))
    return tables.common_grid(cells, ["t"]).select("t", "k", "col", "col_span")


@query("""
WITH c AS (SELECT n_regionkey AS t, n_nationkey // 3 AS r, (n_nationkey % 3)::INTEGER AS col, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey * 4 END AS w FROM nation),
f AS (SELECT t, col, arg_min(w, CASE WHEN w > 0 THEN r END) FILTER (w > 0) AS w FROM c GROUP BY t, col)
SELECT t, col, round(coalesce(w, CASE WHEN 400 - coalesce(sum(w) OVER p, 0) > 0 THEN (400 - coalesce(sum(w) OVER p, 0)) / count(*) FILTER (w IS NULL) OVER p END, 60) * 100)::BIGINT AS width FROM f WINDOW p AS (PARTITION BY t)""")
def col_widths(spark, sf):
    k = F.col("n_nationkey")
    cells = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), F.floor(k / 3).alias("row"), (k % 3).cast("int").alias("col"), F.lit(1).alias("col_span"), F.when(k % 4 == 0, 0).otherwise(k * 4).cast("double").alias("width"))
    return tables.column_widths(cells, ["t"]).select("t", "col", F.round(F.col("width") * 100).cast("long").alias("width"))


@query("""
SELECT p_partkey, p_size * 5 AS from_twips, (p_size * 12700 // 127)::INTEGER AS from_emu, p_size * 20 AS twips, p_size * 50 AS from_half_points, p_size * 7200 AS from_inches,
 printf('%.3fin', p_size * 0.01) AS inches, CASE WHEN p_size % 2 = 0 THEN p_size * 75 END AS px_hundredths, (p_size >> 2) & 3 AS bits FROM part""")
def unit_conversions(spark, sf):
    s = F.col("p_size")
    css = F.concat(s, F.lit("in"))
    px = F.when(s % 2 == 0, F.concat(s, F.lit("px"))).otherwise(F.concat(s, F.lit("%")))
    return table(spark, sf, "part").select(
        "p_partkey", units.twips_to_units(s).alias("from_twips"), units.emu_to_units(s.cast("long") * 12700).alias("from_emu"), units.pt_to_twips(s.cast("double")).alias("twips"), units.half_points_to_units(s).alias("from_half_points"),
        F.round(units.to_pt(css) * 100).cast("int").alias("from_inches"), units.inches(s * 72).alias("inches"), F.round(units.to_pt(px) * 100).cast("int").alias("px_hundredths"), units.bits(s, 2, 3).alias("bits"),
    )


@query("""
WITH k AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS c FROM part), h AS (SELECT p_partkey, c, printf('%02X', c & 255) AS r, printf('%02X', (c >> 8) & 255) AS g, printf('%02X', (c >> 16) & 255) AS b FROM k)
SELECT p_partkey, '#' || r || g || b AS rgb, '#' || b || g || r AS bgr, '#' || r || g || b AS back, 'rgb(' || (c & 255) || ', ' || ((c >> 8) & 255) || ', ' || ((c >> 16) & 255) || ')' AS css FROM h""")
def color_codecs(spark, sf):
    rgb = color.colorref_hex(F.col("p_partkey") * 7919 % 16777216)
    css = color.css_rgb(rgb)
    return table(spark, sf, "part").select("p_partkey", rgb.alias("rgb"), color.bgr(rgb).alias("bgr"), color.to_hex(css).alias("back"), css.alias("css"))


@query("""
WITH v AS (SELECT unnest([0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1, 1.5, 2, 3, 4, 5])::DOUBLE AS w), q AS (SELECT DISTINCT l_quantity::DOUBLE AS quantity FROM lineitem)
SELECT quantity, min_by(w, (abs(w - (quantity * 0.1 + 0.013)), w)) AS mm FROM q, v GROUP BY quantity""")
def border_snap(spark, sf):
    q = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity")).distinct()
    return q.select("quantity", units.snap_border_mm(F.col("quantity") * 0.1 + 0.013).alias("mm"))


@query("""
WITH g AS (SELECT p_partkey, 180.5 + p_size AS w, 255.5 + p_size AS h FROM part)
SELECT p_partkey, CASE WHEN abs(w - 210) < 3 AND abs(h - 297) < 3 OR abs(w - 297) < 3 AND abs(h - 210) < 3 THEN 'a4' WHEN abs(w - 182) < 3 AND abs(h - 257) < 3 OR abs(w - 257) < 3 AND abs(h - 182) < 3 THEN 'b5'
 WHEN abs(w - 215.9) < 3 AND abs(h - 279.4) < 3 OR abs(w - 279.4) < 3 AND abs(h - 215.9) < 3 THEN 'letter' END AS paper FROM g""")
def paper_detect(spark, sf):
    return table(spark, sf, "part").select("p_partkey", layout.paper(F.col("p_size") + 180.5, F.col("p_size") + 255.5).alias("paper"))


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    blocks = ir.blocks_of_text(table(spark, sf, "documents"))
    blocks = blocks.select("doc_id", "ord", F.round(text.height_pt(F.col("text"), F.lit(10.0), F.lit(400.0))).alias("height"))
    return layout.paginate(blocks, ["doc_id"], "ord", "height", F.lit(200.0))


@query(r"""
WITH RECURSIVE b AS (SELECT doc_id, i - 1 AS ord, round(greatest(1, ceil((w + (length(t) - w) * 0.55::DOUBLE) * 10 / 400)) * 10 * 1.6::DOUBLE) AS h FROM (
  SELECT doc_id, i, trim(p) AS t, length(p) - length(regexp_replace(p, '[ᄀ-ᇿ⺀-꓏가-힣豈-﫿＀-｠]', '', 'g')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))),
f AS (SELECT doc_id, ord, h AS used, 0 AS page FROM b WHERE ord = 0
 UNION ALL SELECT b.doc_id, b.ord, CASE WHEN f.used > 0 AND f.used + b.h > 200 THEN b.h ELSE f.used + b.h END, CASE WHEN f.used > 0 AND f.used + b.h > 200 THEN f.page + 1 ELSE f.page END FROM f JOIN b ON b.doc_id = f.doc_id AND b.ord = f.ord + 1)
SELECT doc_id, max(page) + 1 AS pages, max(ord) + 1 AS blocks FROM f GROUP BY doc_id""")
def paginate(spark, sf):
    return _paged(spark, sf).groupBy("doc_id").agg((F.max("page") + 1).cast("int").alias("pages"), (F.max("ord") + 1).cast("long").alias("blocks"))


@query("SELECT doc_id, 0 AS section, len(string_split(text, chr(10)))::BIGINT AS blocks FROM documents")
def unpaginate(spark, sf):
    paged = _paged(spark, sf)
    body = paged.select("doc_id", F.col("page").cast("int").alias("section"), F.col("ord"), F.lit("p").alias("kind"), (F.col("page") > 0).alias("clone"))
    bands = paged.filter("page > 0").groupBy("doc_id", F.col("page").cast("int").alias("section")).agg((F.min("ord") - 0.5).alias("ord")).select("doc_id", "section", "ord", F.lit("band_clone").alias("kind"), F.lit(True).alias("clone"))
    rows = body.withColumn("ord", F.col("ord").cast("double")).unionByName(bands)
    return layout.unpaginate(rows, ["doc_id"], ["ord"]).groupBy("doc_id", "section").agg(F.count("*").alias("blocks"))


@query("""
WITH now AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id AS token, max(ts) AS created FROM events WHERE event_id % 5 = 0 GROUP BY user_id),
r AS (SELECT event_id, user_id AS token, event_id % 4 AS k, event_id % 6 AS e, event_id % 2 = 0 AS o FROM events WHERE event_id % 5 <> 0),
j AS (SELECT r.*, s.token IS NOT NULL AND s.created > now - INTERVAL 24 HOURS AS alive, CASE r.token % 3 WHEN 0 THEN 'hwp' WHEN 1 THEN 'docx' ELSE 'odt' END AS own,
  CASE e WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' WHEN 2 THEN 'pdf' WHEN 3 THEN 'html' ELSE CASE r.token % 3 WHEN 0 THEN 'hwpx' WHEN 1 THEN 'docx' ELSE 'odt' END END AS ext FROM r LEFT JOIN s USING (token), now),
d AS (SELECT *, CASE WHEN k = 3 THEN 405 WHEN NOT alive THEN 403 WHEN e IN (4, 5) AND NOT alive THEN 403 WHEN ext = 'pdf' THEN 400 ELSE 200 END AS status FROM j)
SELECT status, CASE WHEN status = 200 THEN o AND ext = own END AS overwrote, count(*)::BIGINT AS requests FROM d GROUP BY ALL""")
def save_sessions(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]  # one value
    own = F.element_at(F.array(F.lit("hwp"), F.lit("docx"), F.lit("odt")), (F.col("token") % 3 + 1).cast("int"))
    granted = e.filter("event_id % 5 = 0").groupBy(F.col("user_id").alias("token")).agg(F.max("ts").alias("created_at")).withColumn("ext", own).withColumn("src", F.concat(F.lit("a/doc."), own))
    k = F.col("event_id") % 6
    asked = e.filter("event_id % 5 <> 0").select("event_id", F.col("user_id").alias("token"), F.when(F.col("event_id") % 4 == 3, "GET").otherwise("PUT").alias("method"), F.when(k == 0, "docx").when(k == 1, "odt").when(k == 2, "pdf").when(k == 3, "html").alias("ext"), (F.col("event_id") % 2 == 0).alias("overwrite"), F.lit(10).alias("size"))
    return sessions.decide(asked, granted, F.lit(now)).groupBy("status", "overwrote").agg(F.count("*").alias("requests"))


@query("""
SELECT r_regionkey AS doc_id, '<table>' || string_agg('<tr><td style="width:' || printf('%.1f', 100.0) || 'pt">' || n_nationkey || '</td><td style="width:' || printf('%.1f', 200.0) || 'pt">' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey""")
def table_render(spark, sf):
    n = table(spark, sf, "nation")
    cell = lambda w, t: F.concat(F.lit('<td style="'), F.format_string("width:%.1fpt", F.lit(w)), F.lit('">'), text.escape(t.cast("string")), F.lit("</td>"))
    rows = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("row"), F.concat(F.lit("<tr>"), cell(100.0, F.col("n_nationkey")), cell(200.0, F.col("n_name")), F.lit("</tr>")).alias("tr"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda r: r["tr"]), ""), F.lit("</table>")).alias("html"))


_ESC = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""
WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'h2' WHEN turn % 3 = 0 THEN 'p' ELSE 'li' END AS tag, replace(replace({_ESC}, chr(10), '<br>'), chr(13), '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY n) AS k FROM (SELECT *, CASE WHEN tag = 'li' AND lag(tag) OVER (PARTITION BY conv_id ORDER BY n) = 'li' THEN 0 ELSE 1 END AS new FROM b)),
l AS (SELECT conv_id, k, min(n) AS n, bool_and(tag = 'li') AS li, string_agg('<' || tag || ' data-id="b' || n || '">' || t || '</' || tag || '>', '' ORDER BY n) AS h FROM i GROUP BY conv_id, k)
SELECT conv_id AS doc_id, md5('<doc-section data-ir="0.2.0" class="hwp-page" style="width:8.268in;min-height:11.693in">' || string_agg(CASE WHEN li THEN '<ul>' || h || '</ul>' ELSE h END, '' ORDER BY n) || '</doc-section>') AS html_md5 FROM l GROUP BY conv_id""")
def conversation_doc(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    tag = F.when(F.col("role") == "user", "h2").when(F.col("turn") % 3 == 0, "p").otherwise("li")
    blocks = c.select(F.col("conv_id").alias("doc_id"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("ord"), tag.alias("tag"), "text")
    return ir.emit(blocks).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("""SELECT label::BIGINT AS doc_id, count(*)::BIGINT AS entries, count(DISTINCT (vec_id % 3, md5(embedding::VARCHAR)))::BIGINT AS binaries FROM (SELECT * FROM embeddings UNION ALL SELECT vec_id + 3000000, embedding, label FROM embeddings WHERE vec_id % 2 = 0) GROUP BY label""")
def bin_dedup(spark, sf):
    """A package for every label, with a binary for each of its vectors; every second one is there twice."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("doc_id"))
    e = e.unionByName(e.filter("vec_id % 2 = 0").withColumn("vec_id", F.col("vec_id") + 3000000))
    entries = e.select("doc_id", F.concat(F.lit("bin/"), F.col("vec_id"), F.lit(".l"), F.col("vec_id") % 3).alias("path"), F.to_json(F.struct("embedding")).cast("binary").alias("data"))
    return packages.dedup_binaries(entries).groupBy("doc_id").agg(F.sum("uses").alias("entries"), F.count("*").alias("binaries"))


@query(r"""
SELECT doc_id, count(*)::BIGINT AS pieces, md5(string_agg(p, '|' ORDER BY p)) AS pieces_md5 FROM (
 SELECT DISTINCT doc_id, left(regexp_replace(t, '\s+', '', 'g'), 24) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)) WHERE length(p) >= 4 GROUP BY doc_id""")
def text_search_pieces(spark, sf):
    pieces = ir.blocks_of_text(table(spark, sf, "documents")).select("doc_id", text.piece(F.col("text")).alias("p")).filter("p is not null").distinct()
    return pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.md5(F.array_join(F.array_sort(F.collect_list("p")), "|").cast("binary")).alias("pieces_md5"))


@query("""
SELECT user_id AS doc_id, event_id % 5 AS k, greatest(20.0 + 20 * (count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'view')), 0)::DOUBLE AS indent FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'purchase' AND event_id % 7 = 0) = 0""")
def block_patches(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("event_id") % 5)
    data_id = F.concat(F.lit("b"), F.col("k"))
    blocks = e.groupBy(F.col("user_id").alias("doc_id"), "k").agg(F.lit("p").alias("tag")).select("doc_id", data_id.alias("data_id"), "tag", F.lit("").alias("text"), F.lit(20.0).alias("indent"), F.lit(False).alias("numbered"))
    op = F.when(F.col("event_type") == "click", "indent").when(F.col("event_type") == "view", "outdent").when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "delete").otherwise("none")
    patches = e.select(F.col("user_id").alias("doc_id"), data_id.alias("data_id"), op.alias("op"), F.lit(None).cast("string").alias("arg"), F.col("event_id").alias("seq"))
    return edits.apply_patches(blocks, patches).select("doc_id", F.substring("data_id", 2, 9).cast("long").alias("k"), "indent")


@query("""SELECT n_regionkey AS t, n_nationkey AS place, (lead_n % total)::BIGINT AS target FROM (SELECT *, row_number() OVER w AS lead_n, count(*) OVER (PARTITION BY n_regionkey) AS total FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))""")
def next_match(spark, sf):
    found = table(spark, sf, "nation").select(F.col("n_regionkey").alias("t"), F.col("n_nationkey").alias("place"))
    return numbering.next_match(found, ["t"], ["place"]).select("t", "place", "target")


# ---- the IR read back: tables, lists, styles, packages


def _concat_ordered(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "").alias("html"))


@query("""
SELECT n_regionkey AS doc_id, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, c AS ord, CASE c WHEN 0 THEN n_nationkey::VARCHAR ELSE n_name END AS text,
  CASE WHEN c = 0 AND n_nationkey % 2 = 0 THEN 120.0 WHEN c = 0 THEN 36.0 END::DOUBLE AS width FROM nation, (VALUES (0), (1)) AS v(c)""")
def table_cells_read(spark, sf):
    from foliant.plans.tree import table_cells

    n = table(spark, sf, "nation")
    width = F.when(F.col("n_nationkey") % 2 == 0, "30%").otherwise("0.5in")
    tr = F.concat(F.lit('<tr><td style="width:'), width, F.lit('">'), F.col("n_nationkey"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>"))
    pages = _concat_ordered(n.select("n_regionkey", "n_nationkey", tr.alias("tr")), "n_regionkey", "n_nationkey", "tr")
    nodes = markup.html_nodes(pages.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("<table>"), "html", F.lit("</table>")).alias("html")), "doc_id")
    return table_cells(nodes).select("doc_id", F.col("row").cast("long").alias("row"), "ord", "text", "width")


@query("""
WITH c AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_name, count(*) OVER (PARTITION BY n_regionkey) AS total FROM nation)
SELECT doc_id::BIGINT AS doc_id, row, 1::BIGINT AS col, 1 AS row_span, 1 AS col_span, n_name AS text FROM c
UNION ALL SELECT doc_id, 0, 0, total::INTEGER, 1, r_name FROM c JOIN region ON r_regionkey = doc_id WHERE row = 0""")
def docx_table_roundtrip(spark, sf):
    from pyspark.sql import Window as W

    from foliant.sinks.parts import docx_tables

    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    row = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    cell = n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("table"), row.alias("row"), F.lit(1).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(90.0).alias("width"), F.col("n_name").alias("text"))
    tall = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").cast("int").alias("row_span")).join(r, "r_regionkey")
    tall = tall.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("table"), F.lit(0).alias("row"), F.lit(0).alias("col"), "row_span", F.lit(1).alias("col_span"), F.lit(90.0).alias("width"), F.col("r_name").alias("text"))
    files = sink.package_body(docx_tables(cell.unionByName(tall)).select("doc_id", "xml"), "docx")
    return document.read_docx(files).cells.select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "row_span", "col_span", "text")


@query("""
WITH t AS (SELECT 0 AS level, r_regionkey AS r, -1 AS n, -1::BIGINT AS s, r_name AS text FROM region UNION ALL SELECT 1, n_regionkey, n_nationkey, -1, n_name FROM nation
 UNION ALL SELECT 2, n_regionkey, n_nationkey, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT r::BIGINT AS doc_id, level, text, level <> 1 AS ordered, row_number() OVER (PARTITION BY r ORDER BY n, s) AS place FROM t""")
def list_levels_read(spark, sf):
    """A page for every region, whose nations and their suppliers are lists in its list."""
    from pyspark.sql import Window as W

    from foliant.plans.tree import list_items

    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    li = lambda name, inner: F.concat(F.lit("<li>"), F.col(name), inner, F.lit("</li>"))
    nest = lambda tag: F.when(F.coalesce("html", F.lit("")) != "", F.concat(F.lit(f"<{tag}>"), "html", F.lit(f"</{tag}>"))).otherwise("")
    deep = _concat_ordered(s.select("s_nationkey", "s_suppkey", li("s_name", F.lit("")).alias("x")), "s_nationkey", "s_suppkey", "x")
    mid = _concat_ordered(n.join(deep, n["n_nationkey"] == deep["s_nationkey"], "left").select("n_regionkey", "n_nationkey", li("n_name", nest("ol")).alias("x")), "n_regionkey", "n_nationkey", "x")
    top = _concat_ordered(r.join(mid, r["r_regionkey"] == mid["n_regionkey"], "left").select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_regionkey", li("r_name", nest("ul")).alias("x")), "doc_id", "r_regionkey", "x")
    items = list_items(markup.html_nodes(top.select("doc_id", F.concat(F.lit("<ol>"), "html", F.lit("</ol>")).alias("html")), "doc_id", blocks=["li"]))
    return items.select("doc_id", "level", "text", "ordered", F.row_number().over(W.partitionBy("doc_id").orderBy("node_id")).cast("long").alias("place"))


@query("""
SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 10 END::DOUBLE AS size_pt, CASE WHEN p_size % 3 = 0 THEN '#FF0000' ELSE '#00FF00' END AS color, p_size % 5 = 0 AS bold FROM part""")
def style_inheritance(spark, sf):
    from foliant.plans.tree import inherited_styles

    p, k = table(spark, sf, "part"), F.col("p_size")
    inner = F.concat(F.when(k % 2 == 0, F.concat(F.lit("font-size:"), k, F.lit("pt;"))).otherwise(""), F.when(k % 3 == 0, "color:rgb(255, 0, 0)").otherwise(""))
    html = F.concat(F.lit('<p style="font-size:10pt;color:#0f0'), F.when(k % 5 == 0, ";font-weight:bold").otherwise(";font-weight:normal"), F.lit('"><span><span style="'), inner, F.lit('">'), F.col("p_name"), F.lit("</span></span></p>"))
    return inherited_styles(markup.html_nodes(p.select(F.col("p_partkey").alias("doc_id"), html.alias("html")), "doc_id")).select("doc_id", "size_pt", "color", "bold")


@query("""SELECT kind, count(*)::BIGINT AS files, (CASE kind WHEN 'docx' THEN 0 ELSE count(*) END)::BIGINT AS mimetype_first, 0::BIGINT AS broken, 0::BIGINT AS lost_tokens FROM documents, (VALUES ('docx'), ('odt'), ('hwpx')) AS v(kind) GROUP BY kind""")
def package_rules(spark, sf):
    from foliant.plans import verify

    blocks, out = _dealt_blocks(spark, sf), None
    wanted = ir.blocks_of_text(table(spark, sf, "documents")).select("doc_id", text.xml_safe(F.col("text")).alias("text"))
    for kind in ("docx", "odt", "hwpx"):
        files = written(sink.write(blocks, kind), "packages")
        one = verify.mimetype_rule(files).agg(F.count("*").alias("files"), F.count_if("ok").alias("mimetype_first")).filter("files > 0")
        one = written(one.crossJoin(verify.faults(wanted, files)).withColumn("kind", F.lit(kind)), "counts")  # tables of one row
        discard(files)
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "files", "mimetype_first", "broken", "lost_tokens")
