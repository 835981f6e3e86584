"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import color, text, units


def ev(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("css,pt", [("12pt", 12.0), ("1in", 72.0), ("25.4mm", 72.0), ("2.54cm", 72.0), ("4px", 3.0), ("7", 7.0), ("30%", None), ("", None), (None, None), ("-3pt", -3.0)])
def test_to_pt(spark, css, pt):
    got = ev(spark, css, units.to_pt)
    assert got is None if pt is None else abs(got - pt) < 1e-9


def test_padding_and_percent(spark):
    assert ev(spark, "1pt 2pt", units.padding) == [1, 2, 1, 2]
    assert ev(spark, "1pt 2pt 3pt", units.padding) == [1, 2, 3, 2]
    assert ev(spark, None, units.padding) == [0, 0, 0, 0]
    assert ev(spark, "30%", lambda c: units.to_pt_of(c, F.lit(200.0))) == 60


def test_units(spark):
    assert ev(spark, "2.54cm", units.odf_length) == 7200
    assert ev(spark, "50%", units.odf_length) is None
    assert ev(spark, 4294967295, units.dim, "long") is None
    assert ev(spark, 0b110100, lambda c: units.bits(c, 2, 4), "int") == 0b101
    assert ev(spark, 0.13, units.snap_border_mm, "double") == 0.12
    assert ev(spark, 59528, units.inches, "int") == "8.268in"
    assert ev(spark, None, units.half_points_to_units, "int") == 1000


def test_colors(spark):
    assert ev(spark, 0x0000C0, color.colorref_hex, "long") == "#C00000"
    assert ev(spark, "#123456", color.bgr) == "#563412"
    assert ev(spark, "none", color.bgr) == "#FFFFFFFF"
    assert ev(spark, "rgb(1, 2, 255)", color.to_hex) == "#0102FF"
    assert ev(spark, "#abc", color.to_hex) == "#AABBCC"
    assert ev(spark, "blue", color.to_hex) is None
    assert ev(spark, "auto", color.six_digits) is None
    assert ev(spark, 6, color.ico_hex, "int") == "#FF0000"


def test_text(spark):
    assert ev(spark, "a\x01b\tc", text.xml_safe) == "ab\tc"
    assert ev(spark, 'a<b & "c">', text.escape) == "a&lt;b &amp; &quot;c&quot;&gt;"
    assert ev(spark, "color:red; font-size : 12pt", lambda c: text.style_prop(c, "font-size")) == "12pt"
    assert ev(spark, "min-height:3pt", lambda c: text.style_prop(c, "height")) is None
    b = ev(spark, "dashed #C2352B 2pt", text.border)
    assert (b.width_pt, b.style, b.color) == (2.0, "dashed", "#C2352B")
    assert ev(spark, "none", text.border) is None
    for href, ok in (("https://a", True), ("mailto:a", True), ("#b7", True), ("#x", False), ("javascript:x", False), (None, False)):
        assert ev(spark, href, text.safe_href) is ok
    assert ev(spark, 15, text.hangul_ordinal, "int") == "가가"
    assert ev(spark, 3, text.hangul_ordinal, "int") == "다"
    assert ev(spark, 2, lambda c: text.outline_label(F.lit(6), c), "int") == "(나)"
    assert ev(spark, "aXa.b", lambda c: text.replace_found(c, "A.B", "$1")) == "aX$1"
    assert ev(spark, bytearray(b"\x80\x93x"), text.cp1252, "binary") == "€“x"
    assert ev(spark, "super 58%", text.text_position) == "super"
    assert ev(spark, "-33% 58%", text.text_position) == "sub"
    assert ev(spark, "/x/Doc.HWPX", text.stem) == "Doc"
    assert ev(spark, "data:image/png;base64,AAAA", text.data_uri).mime == "image/png"
    assert ev(spark, "가a", lambda c: text.width_pt(c, F.lit(10.0))) == pytest.approx(15.5)


def test_css(spark):
    row = spark.range(1).select(
        text.char_shape_css(F.lit(1200), F.lit(100), F.lit("rgb(255, 0, 0)"), F.lit("Batang"), F.lit(0b0111)).alias("c"),
        text.para_shape_css(F.lit(3), F.lit(1000), F.lit(-1500), F.lit(0), F.lit(500), F.lit(False)).alias("p"),
        text.block_tag(F.lit(8), F.lit(False), F.lit(False)).alias("h"),
        text.block_tag(F.lit(None).cast("int"), F.lit(True), F.lit(True)).alias("l"),
        text.cell_css(F.lit(1000), F.lit(500), F.array(*map(F.lit, (100, 300, 200, 400))), F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string"), F.lit("top")).alias("t"),
    ).first()
    assert row.c == "font-size:12.0pt;color:rgb(255, 0, 0);font-family:Batang;font-style:italic;font-weight:bold;text-decoration:underline"
    assert row.p == "text-align:center;margin-left:10.0pt;text-indent:-10.0pt;margin-bottom:5.0pt"
    assert (row.h, row.l) == ("h6", "p")
    assert row.t == "width:10.0pt;height:5.0pt;padding:2.0pt 3.0pt 4.0pt 2.0pt;border:none;vertical-align:top"
