"""Registered queries of the scalar functions and the projections made of them, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import color, text, units
from foliant.plans.queries import query
from foliant.session import table


@query("""
WITH p AS (SELECT p_partkey, p_size AS s, CASE p_partkey % 4 WHEN 0 THEN p_size || 'pt' WHEN 1 THEN p_size || 'pt 4pt' WHEN 2 THEN '1in 2pt ' || p_size || 'pt' ELSE '1pt 2pt 3pt ' || p_size || 'pt' END AS css FROM part)
SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN 72 ELSE 1 END)::DOUBLE AS top, (CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN 4 ELSE 2 END)::DOUBLE AS right_,
 (CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s ELSE 3 END)::DOUBLE AS bottom, (CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE s END)::DOUBLE AS left_,
 CASE p_partkey % 3 WHEN 0 THEN s * 100 WHEN 1 THEN s * -7200 END::INTEGER AS odf, round(s / 72 * 25.4, 1)::DOUBLE AS mm, round(s * 72 / 25.4 * 10)::BIGINT AS tenths_pt,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE s END::BIGINT AS dim, round(([0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1, 1.5, 2, 3, 4, 5]::DOUBLE[])[CASE WHEN s % 20 < 16 THEN s % 20 + 1 ELSE 2 END] * 72 / 25.4 * 1000)::BIGINT AS border_thousandths,
 s / 8 AS eighths FROM p""")
def unit_readers(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    css = F.when(k % 4 == 0, F.concat(s, F.lit("pt"))).when(k % 4 == 1, F.concat(s, F.lit("pt 4pt"))).when(k % 4 == 2, F.concat(F.lit("1in 2pt "), s, F.lit("pt"))).otherwise(F.concat(F.lit("1pt 2pt 3pt "), s, F.lit("pt")))
    odf = F.when(k % 3 == 0, F.concat(s, F.lit("pt"))).when(k % 3 == 1, F.concat(F.lit("-"), s, F.lit("in"))).otherwise(F.concat(s, F.lit("%")))
    pads = units.padding(css)
    missing = F.when(k % 10 == 0, F.lit(-1)).when(k % 5 == 0, F.lit(4294967295)).otherwise(s.cast("long"))
    return table(spark, sf, "part").select(
        "p_partkey", *[pads[i].alias(n) for i, n in enumerate(("top", "right_", "bottom", "left_"))], units.odf_length(odf).alias("odf"), F.round(units.pt_to_mm(s), 1).alias("mm"), F.round(units.mm_to_pt(s) * 10).cast("long").alias("tenths_pt"),
        units.dim(missing).alias("dim"), F.round(units.border_width_pt(s % 20) * 1000).cast("long").alias("border_thousandths"), units.eighths_to_pt(s).alias("eighths"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || printf('%06X', p_partkey * 7919 % 16777216) WHEN 1 THEN '#' || printf('%06X', p_partkey * 7919 % 16777216) END AS six,
 (['#000000','#000000','#0000FF','#00FFFF','#00FF00','#FF00FF','#FF0000','#FFFF00','#FFFFFF','#000080','#008080','#008000','#800080','#800000','#808000','#808080','#C0C0C0'])[CASE WHEN p_size < 17 THEN p_size + 1 ELSE 1 END] AS ico FROM part""")
def indexed_colors(spark, sf):
    k, digits = F.col("p_partkey"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    said = F.when(k % 4 == 0, digits).when(k % 4 == 1, F.concat(F.lit("#"), digits)).when(k % 4 == 2, "auto").otherwise("none")
    return table(spark, sf, "part").select("p_partkey", color.six_digits(said).alias("six"), color.ico_hex(F.col("p_size")).alias("ico"))


@query(r"""
WITH p AS (SELECT p_partkey, p_size AS s, p_brand AS b, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 3 THEN NULL ELSE s::DOUBLE END AS width, CASE k WHEN 0 THEN 'solid' WHEN 1 THEN 'dashed' WHEN 2 THEN 'double' END AS kind, CASE k WHEN 0 THEN '#FF0000' WHEN 1 THEN '#00FF00' WHEN 2 THEN '#000000' END AS color,
 (['•','◦','▪'])[least(s % 5, 2) + 1] AS bullet, 'p' || k AS local, CASE k WHEN 0 THEN 'super' WHEN 1 THEN 'sub' WHEN 2 THEN 'super' ELSE 'sub' END AS position, 'http://h/' || s AS command,
 lower(regexp_replace(regexp_replace(b, '[^0-9A-Za-z]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, replace(b, '#', '') AS stem, (['hwp','docx','odt','hwpx'])[k + 1] AS ext,
 CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' END AS mime, CASE k WHEN 0 THEN 'image/png' END AS uri_mime, CASE k WHEN 0 THEN b END AS uri_text, b AS latin,
 CASE k WHEN 0 THEN '[이미지: emf]' ELSE '' END AS shown FROM p""")
def text_readers(spark, sf):
    k, s, b = F.col("p_partkey") % 4, F.col("p_size"), F.col("p_brand")
    pick = lambda *v: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in v]), k.cast("int"))
    side = text.border(pick(F.concat(F.lit("#f00 solid "), s, F.lit("pt")), F.concat(s, F.lit("pt dashed rgb(0, 255, 0)")), F.concat(F.lit("double "), s, F.lit("pt")), "none"))
    uri = text.data_uri(F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(b.cast("binary")))).otherwise(F.concat(F.lit("http://"), b)))
    path = F.concat(F.lit("C/dir.x/"), F.replace(b, F.lit("#"), F.lit("")), F.lit("."), pick("HWP", "docx", "odt", "hwpx"))
    return table(spark, sf, "part").select(
        "p_partkey", side["width_pt"].alias("width"), side["style"].alias("kind"), side["color"].alias("color"), text.bullet(s % 5).alias("bullet"), text.local_name(F.concat(F.lit("w:p"), k)).alias("local"),
        text.text_position(pick("super 58%", "sub 58%", "33% 58%", "-33% 58%")).alias("position"), text.hyperlink_command(F.concat(F.lit("http://h/"), s, F.lit(";1;0;0;"))).alias("command"), text.slug(F.concat(F.lit(" "), b, F.lit("!"))).alias("slug"),
        text.stem(path).alias("stem"), text.extension(path).alias("ext"), text.image_mime(pick("PNG", "jpg", "gif", "emf")).alias("mime"), uri["mime"].alias("uri_mime"), uri["data"].cast("string").alias("uri_text"), text.cp1252(b.cast("binary")).alias("latin"),
        F.coalesce(text.image_placeholder(pick("emf", "png", "gif", "bmp")), F.lit("")).alias("shown"),
    )


@query(r"""
WITH t AS (SELECT doc_id, text FROM documents), v AS (SELECT doc_id, regexp_replace('  ' || text || '  ', '[ \t]*\r?\n[ \t]*', ' ', 'g') AS x FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(x, '^ +', ''), ' +$', '')) AS both_md5, md5(x) AS inner_md5, regexp_matches(text, '\S') AS has_content, length(text) > 200 AS cut, left(text, 200) AS head FROM v JOIN t USING (doc_id)""")
def visible_texts(spark, sf):
    t = F.concat(F.lit("  "), "text", F.lit("  "))
    md5 = lambda c: F.md5(c.cast("binary"))
    short = text.truncated(F.col("text"), 200)
    return table(spark, sf, "documents").select("doc_id", md5(text.visible(t, F.lit(True), F.lit(True))).alias("both_md5"), md5(text.visible(t, F.lit(False), F.lit(False))).alias("inner_md5"), text.has_content(F.col("text")).alias("has_content"), short["cut"].alias("cut"), short["text"].alias("head"))


@query(r"""
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 16 AS a, CASE WHEN p_partkey % 3 = 0 THEN 'rgb(0, 0, 0)' ELSE 'rgb(1, 2, 3)' END AS c, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS f FROM part)
SELECT p_partkey, concat_ws(';', 'font-size:' || printf('%.1f', s * 1.0) || 'pt', CASE WHEN c <> 'rgb(0, 0, 0)' THEN 'color:' || c END, 'font-family:' || f, CASE WHEN a & 1 = 1 THEN 'font-style:italic' END, CASE WHEN (a >> 1) & 1 = 1 THEN 'font-weight:bold' END,
  CASE (a >> 2) & 3 WHEN 1 THEN 'text-decoration:underline' WHEN 2 THEN 'text-decoration:overline' END) AS char_css,
 concat_ws(';', CASE p_partkey % 4 WHEN 1 THEN 'text-align:left' WHEN 2 THEN 'text-align:right' WHEN 3 THEN 'text-align:center' ELSE 'text-align:justify' END, CASE WHEN NOT li AND i <> 0 THEN 'margin-left:' || printf('%.1f', i * 1.0) || 'pt' END, CASE WHEN NOT li AND greatest(-30, -i) <> 0 THEN 'text-indent:' || printf('%.1f', greatest(-30, -i) * 1.0) || 'pt' END,
  'margin-top:' || printf('%.1f', s * 1.0) || 'pt') AS para_css,
 concat_ws(';', 'width:' || printf('%.1f', s * 1.0) || 'pt', 'height:12.0pt', 'padding:2.0pt ' || printf('%.1f', greatest(s * 0.1, 2)) || 'pt 3.0pt 2.0pt', CASE WHEN li THEN 'background:#FFFF00' END, CASE p_partkey % 3 WHEN 0 THEN 'border:none' WHEN 1 THEN 'border:1pt solid' END, CASE WHEN p_partkey % 2 = 1 THEN 'vertical-align:top' END) AS cell_css,
 CASE WHEN p_partkey % 4 = 0 THEN 'h' || least(s % 9 + 1, 6) WHEN li AND p_partkey % 3 <> 0 THEN 'li' ELSE 'p' END AS tag
FROM (SELECT *, s % 2 = 0 AS li, s % 5 * 10 AS i FROM p)""")
def css_projections(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    li = s % 2 == 0
    char = text.char_shape_css(s * 100, F.lit(100), F.when(k % 3 == 0, "rgb(0, 0, 0)").otherwise("rgb(1, 2, 3)"), F.when(k % 5 != 0, F.col("p_brand")), (k % 16).cast("int"))
    para = text.para_shape_css((k % 4).cast("int"), s % 5 * 1000, F.lit(-3000), s * 100, F.lit(0), li)
    cell = text.cell_css(s * 100, F.lit(1200), F.array(F.lit(0), s * 10, F.lit(50), F.lit(300)), F.when(li, "#FFFF00"), k % 3 < 2, F.when(k % 3 == 1, "1pt solid"), F.when(k % 2 == 1, "top").otherwise("middle"))
    tag = text.block_tag(F.when(k % 4 == 0, s % 9 + 1), li, k % 3 == 0)
    return table(spark, sf, "part").select("p_partkey", char.alias("char_css"), para.alias("para_css"), cell.alias("cell_css"), tag.alias("tag"))


@query("""
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 6 AS k FROM part)
SELECT p_partkey, (['left','left','right','right','center','justify'])[k + 1] AS align, CASE WHEN k < 2 THEN NULL ELSE (['solid','dashed','dotted','double'])[k - 1] END AS style,
 CASE WHEN k = 0 THEN s WHEN k = 1 THEN 7 ELSE 0 END::INTEGER AS margin, CASE k WHEN 0 THEN 'page' WHEN 1 THEN 'pages' WHEN 2 THEN 'pages' END AS field, CASE WHEN k = 5 THEN NULL ELSE k + 1 END::INTEGER AS heading,
 (CASE WHEN k % 2 = 0 THEN s * 100 ELSE 250 END)::INTEGER AS cell_width, CASE k WHEN 0 THEN 'a.png' WHEN 1 THEN 'b.wmf' ELSE 'c.JPG' END AS image, (CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 2 ELSE 0 END + CASE WHEN s % 2 = 0 THEN 4 ELSE 0 END)::INTEGER AS attr,
 least(s * 0.75, 420)::DOUBLE AS image_pt, CASE WHEN k = 0 THEN 'encrypted' WHEN k = 1 THEN 'not a hwp file' END AS rejected FROM p""")
def reader_rules(spark, sf):
    from foliant.sources import rules

    k, s = (F.col("p_partkey") % 6).cast("int"), F.col("p_size")
    pick = lambda *v: F.get(F.array(*[F.lit(x) if not hasattr(x, "cast") else x for x in v]), k)
    header = F.when(k == 1, F.lit(b"PK something else that is no header of a file.....")).otherwise(F.concat(F.rpad(F.lit(b"HWP Document File"), 36, b"\0"), F.when(k == 0, F.lit(b"\x02\0\0\0")).otherwise(F.lit(b"\x01\0\0\0"))))
    return table(spark, sf, "part").select(
        "p_partkey", rules.docx_align(pick("start", "left", "end", "right", "center", "both")).alias("align"), rules.border_style(pick("nil", "none", "single", "dashSmallGap", "dotted", "double"), "docx").alias("style"),
        rules.inherited_side(F.when(k == 0, s), F.when(k == 1, F.lit(7))).cast("int").alias("margin"), rules.field_kind(pick(" PAGE ", " NUMPAGES ", "NUMPAGES \\* MERGE", "DATE", "TOC", "REF x")).alias("field"),
        rules.docx_heading(F.when(k == 0, F.lit("0")), pick("x", "Heading2", "heading 3", "Heading4", "Heading5", "Title")).alias("heading"),
        rules.docx_cell_width(F.when(k % 2 == 0, F.concat(s * 20, F.lit(""))), F.when(k % 4 == 0, "dxa").otherwise("dxa"), F.lit(250)).alias("cell_width"),
        rules.renderable(pick(F.array(F.lit("x.emf"), F.lit("a.png")), F.array(F.lit("b.wmf")), *[F.array(F.lit("y.svm"), F.lit("c.JPG"))] * 4)).alias("image"),
        rules.char_attr(k == 1, k == 0, s % 2 == 0).alias("attr"), rules.image_points(s).alias("image_pt"), rules.hwp_rejection(header).alias("rejected"),
    )


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '#FF0000' WHEN 1 THEN '#00FF00' ELSE '#0000FF' END AS hwp, CASE n_nationkey % 3 WHEN 0 THEN '#FF0000' WHEN 1 THEN '#FFFF00' ELSE '#0000FF' END AS hwpx, CASE n_nationkey % 3 WHEN 0 THEN '#FFFF00' WHEN 1 THEN '#FFFF00' ELSE '#0000FF' END AS docx FROM nation""")
def representative_border(spark, sf):
    from foliant.sources import rules

    k = F.col("n_nationkey") % 3
    sides = {"left": F.when(k == 0, "#FF0000"), "right": F.when(k == 1, "#00FF00"), "top": F.when(k < 2, "#FFFF00"), "bottom": F.lit("#0000FF")}
    return table(spark, sf, "nation").select("n_nationkey", *[rules.representative_side(sides, f).alias(f) for f in ("hwp", "hwpx", "docx")])
