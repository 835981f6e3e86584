"""What readers decide value by value: small rules of the formats, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import units

# fixed values: border names of the formats by the vocabulary's four styles
BORDERS = {
    "docx": {"single": "solid", "thick": "solid", "dashed": "dashed", "dashSmallGap": "dashed", "dotDash": "dashed", "dotDotDash": "dashed", "dotted": "dotted", "double": "double", "triple": "double"},
    "odt": {"solid": "solid", "dashed": "dashed", "dotted": "dotted", "double": "double"},
    "hwpx": {"SOLID": "solid", "DASH": "dashed", "LONG_DASH": "dashed", "DASH_DOT": "dashed", "DASH_DOT_DOT": "dashed", "DOT": "dotted", "CIRCLE": "dotted", "DOUBLE_SLIM": "double", "SLIM_THICK": "double", "THICK_SLIM": "double", "SLIM_THICK_SLIM": "double"},
}
# fixed values: the order in which a format's sides stand for the whole border
SIDES = {"hwp": ("left", "right", "top", "bottom"), "hwpx": ("left", "top", "right", "bottom"), "docx": ("top", "left", "bottom", "right")}
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp")
MOST_IMAGE_PT = 420.0


def docx_align(value: Column) -> Column:
    """start and left, end and right, center; distribute; all else is justified."""
    return F.when(value.isin("start", "left"), "left").when(value.isin("end", "right"), "right").when(value == "center", "center").when(value == "distribute", "distribute").otherwise("justify")


def border_style(name: Column, kind: str) -> Column:
    """solid, dashed, dotted or double; null for none and nil; what a format adds to them counts as solid."""
    known = F.create_map(*[F.lit(x) for pair in BORDERS[kind].items() for x in pair])
    none = name.isNull() | F.lower(name).isin("none", "nil", "hidden")
    return F.when(~none, F.coalesce(F.try_element_at(known, name), F.lit("solid")))


def representative_side(sides: dict[str, Column], kind: str) -> Column:
    """The first side that has a border, in the format's order."""
    return F.coalesce(*[sides[s] for s in SIDES[kind]])


def inherited_side(cell: Column, table: Column) -> Column:
    """A cell's margin on one side, else its table's, else none."""
    return F.coalesce(cell, table, F.lit(0))


def field_kind(instruction: Column) -> Column:
    """pages for NUMPAGES, page for PAGE, null for fields whose result stays text."""
    return F.when(F.upper(instruction).contains("NUMPAGES"), "pages").when(F.upper(instruction).contains("PAGE"), "page")


def docx_heading(outline: Column, style: Column) -> Column:
    """The heading level from 1: the outline level's, else the number of a Heading style; body text (9) is none."""
    level = outline.try_cast("int")
    named = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)^heading\s*([1-9])$", 1).try_cast("int")
    return F.when(level.between(0, 8), level + 1).otherwise(F.when(level.isNull(), named))


def docx_cell_width(width: Column, kind: Column, grid: Column) -> Column:
    """A cell's width in hwpunits: its own unless it is a share, else that of its grid columns."""
    own = F.when(F.coalesce(kind, F.lit("dxa")) == "dxa", units.twips_to_units(width.try_cast("int")))
    return F.coalesce(F.when(own > 0, own), grid)


def docx_first_line(first: Column, hanging: Column) -> Column:
    """A hanging indent is a negative first line."""
    return F.coalesce(-hanging, first, F.lit(0))


def renderable(hrefs: Column) -> Column:
    """Of the alternatives of a picture the first that can be shown, else the first."""
    shown = F.filter(hrefs, lambda h: F.lower(F.regexp_extract(h, r"\.([^.]+)$", 1)).isin(*IMAGES))
    return F.coalesce(F.get(shown, 0), F.get(hrefs, 0))


def char_attr(bold: Column, italic: Column, underline: Column) -> Column:
    """The bits of a char shape: 0 italic, 1 bold, 2 underline."""
    on = lambda c, bit: F.when(F.coalesce(c, F.lit(False)), F.lit(bit)).otherwise(F.lit(0))
    return (on(italic, 1) + on(bold, 2) + on(underline, 4)).cast("int")


def image_points(pixels: Column) -> Column:
    """The width of a placed image: three quarters of a point a pixel, no wider than the text."""
    return F.least(pixels * F.lit(0.75), F.lit(MOST_IMAGE_PT))


def hwp_rejection(header: Column) -> Column:
    """Why a file header cannot be read: another signature, or encryption (bit 1 of the flags); null where it can."""
    flags = F.conv(F.hex(header.substr(37, 1)), 16, 10).cast("int")
    return F.when(header.substr(1, 17) != F.lit(b"HWP Document File"), "not a hwp file").when(flags.bitwiseAND(F.lit(2)) > 0, "encrypted")


def word_rejection(base: Column) -> Column:
    """The same for a word file's base: the magic number, and the encryption bit of the flags."""
    flags = F.conv(F.hex(base.substr(12, 1)), 16, 10).cast("int")
    return F.when(F.hex(base.substr(1, 2)) != "ECA5", "not a word file").when(flags.bitwiseAND(F.lit(1)) > 0, "encrypted")
