"""Lengths. The model counts hwpunits (1/7200 inch, 1/100 pt) as whole numbers; IR styles count points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit names and their points
POINTS = {"pt": 1.0, "in": 72.0, "mm": 72 / 25.4, "cm": 72 / 2.54, "px": 0.75, "pc": 12.0}
# fixed values: border widths of the hwp table, in mm, by index
BORDER_MM = [0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1, 1.5, 2, 3, 4, 5]
_NUMBER = r"(-?[0-9.]+)\s*(pt|in|mm|cm|px|pc)?"


def _scaled(number: Column, unit: Column, units: tuple[str, ...]) -> Column:
    out = number
    for u in units:
        out = F.when(unit == u, number * F.lit(POINTS[u])).otherwise(out)
    return out


def to_pt(css: Column) -> Column:
    """A CSS length in points; a bare number counts as points, a percentage or no number as null."""
    number = F.regexp_extract(css, _NUMBER, 1).try_cast("double")
    unit = F.regexp_extract(css, _NUMBER, 2)
    return F.when(~css.contains("%"), _scaled(number, unit, ("in", "mm", "cm", "px")))


def to_pt_of(css: Column, base: Column) -> Column:
    """As to_pt, with percentages taken of a base length in points."""
    share = F.regexp_extract(css, r"(-?[0-9.]+)\s*%", 1)
    return F.when(share != "", share.try_cast("double") / 100 * base).otherwise(to_pt(css))


def padding(css: Column) -> Column:
    """[top, right, bottom, left] in points of the one- to four-value shorthand."""
    parts = F.filter(F.split(F.coalesce(css, F.lit("")), r"\s+"), lambda p: p != "")
    at = lambda i: F.coalesce(to_pt(F.get(parts, i)), F.when(F.get(parts, i).isNotNull(), F.lit(0.0)))
    top = F.coalesce(at(0), F.lit(0.0))
    right = F.coalesce(at(1), top)
    return F.array(top, right, F.coalesce(at(2), top), F.coalesce(at(3), right))


def odf_length(css: Column) -> Column:
    """An ODF length in hwpunits (in, cm, mm, pt, pc, px), null for percentages and other text."""
    number = F.regexp_extract(css, r"^\s*(-?[0-9.]+)\s*(pt|in|mm|cm|px|pc)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(css, r"^\s*(-?[0-9.]+)\s*(pt|in|mm|cm|px|pc)\s*$", 2)
    return F.round(_scaled(number, unit, ("in", "mm", "cm", "px", "pc")) * 100).cast("int")


def twips_to_units(twips: Column) -> Column:
    return twips.cast("int") * 5


def emu_to_units(emu: Column) -> Column:
    return (emu.cast("long") / 127).cast("int")


def pt_to_twips(pt: Column) -> Column:
    return F.round(pt * 20).cast("int")


def pt_to_emu(pt: Column) -> Column:
    return F.round(pt * 12700).cast("long")


def pt_to_units(pt: Column) -> Column:
    return F.round(pt * 100).cast("int")


def inches(units: Column) -> Column:
    """Section lengths print as inches with three decimals."""
    return F.format_string("%.3fin", units.cast("double") / 7200)


def pt_to_mm(pt: Column) -> Column:
    return pt / 72 * 25.4


def mm_to_pt(mm: Column) -> Column:
    return mm / 25.4 * 72


def dim(value: Column) -> Column:
    """-1 and 4294967295 mean that a dimension is missing."""
    return F.when(value.between(0, 4294967294), value)


def bits(value: Column, start: int, end: int) -> Column:
    """Bits start..end, both included."""
    return F.shiftright(value, start).bitwiseAND(F.lit((1 << (end - start + 1)) - 1))


def border_width_pt(index: Column) -> Column:
    """The width of a border by its index in the table, in points; other indices count as 0.12 mm."""
    return F.coalesce(F.get(F.array(*map(F.lit, map(float, BORDER_MM))), index), F.lit(0.12)) * F.lit(POINTS["mm"])


def snap_border_mm(mm: Column) -> Column:
    """The table's nearest width, the smaller one where two are as near."""
    widths = F.array(*map(F.lit, map(float, BORDER_MM)))
    return F.element_at(F.array_sort(F.transform(widths, lambda w: F.struct(F.abs(w - mm).alias("d"), w.alias("w")))), 1)["w"]


def half_points_to_units(half: Column) -> Column:
    """Word counts sizes in half points; none means 10 pt."""
    return F.coalesce(half.cast("int"), F.lit(20)) * 50


def eighths_to_pt(eighths: Column) -> Column:
    return eighths / 8
