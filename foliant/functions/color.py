"""Colour codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Word's indexed colours 0 to 16
ICO = ["#000000", "#000000", "#0000FF", "#00FFFF", "#00FF00", "#FF00FF", "#FF0000", "#FFFF00", "#FFFFFF", "#000080", "#008080", "#008000", "#800080", "#800000", "#808000", "#808080", "#C0C0C0"]


def _two(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def rgb_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), _two(red), _two(green), _two(blue))


def colorref_hex(ref: Column) -> Column:
    """0x00BBGGRR as #RRGGBB."""
    byte = lambda shift: F.shiftright(ref, shift).bitwiseAND(F.lit(255))
    return rgb_hex(byte(0), byte(8), byte(16))


def six_digits(text: Column) -> Column:
    """RRGGBB as #RRGGBB; auto, none and all else as null."""
    return F.when(text.rlike("^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(F.right(text, F.lit(6)))))


def bgr(hex_color: Column) -> Column:
    """#RRGGBB as #BBGGRR and back; no colour is #FFFFFFFF."""
    swapped = F.concat(F.lit("#"), F.substring(hex_color, 6, 2), F.substring(hex_color, 4, 2), F.substring(hex_color, 2, 2))
    return F.when(hex_color.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(swapped)).otherwise(F.lit("#FFFFFFFF"))


def to_hex(css: Column) -> Column:
    """rgb(r, g, b), #rgb or #rrggbb as #RRGGBB, else null."""
    pattern = r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    part = lambda i: F.regexp_extract(css, pattern, i).try_cast("int")
    text = F.trim(css)
    doubled = F.regexp_replace(text, "([0-9A-Fa-f])", "$1$1")
    return (
        F.when(css.rlike(pattern), rgb_hex(part(1), part(2), part(3)))
        .when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(text))
        .when(text.rlike("^#[0-9A-Fa-f]{3}$"), F.upper(doubled))
    )


def css_rgb(hex_color: Column) -> Column:
    """#RRGGBB as rgb(r, g, b)."""
    part = lambda i: F.conv(F.substring(hex_color, i, 2), 16, 10)
    return F.concat(F.lit("rgb("), F.concat_ws(", ", part(2), part(4), part(6)), F.lit(")"))


def ico_hex(index: Column) -> Column:
    """Word's indexed colour; unknown ones are black."""
    return F.coalesce(F.get(F.array(*map(F.lit, ICO)), index), F.lit("#000000"))
