"""Text functions of the document engine, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bullets by level, ordinals of the Korean outline, and its six label forms (prefix, kind, suffix)
BULLETS = ["•", "◦", "▪"]
HANGUL = ["가", "나", "다", "라", "마", "바", "사", "아", "자", "차", "카", "타", "파", "하"]
OUTLINE = [("", "decimal", "."), ("", "hangul", "."), ("", "decimal", ")"), ("", "hangul", ")"), ("(", "decimal", ")"), ("(", "hangul", ")")]
WIDE = "[ᄀ-ᇿ⺀-꓏가-힣豈-﫿＀-｠]"
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp"}


def xml_safe(text: Column) -> Column:
    """Without the control characters that XML 1.0 does not allow."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def escape(text: Column) -> Column:
    """For HTML and XML text and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def style_prop(style: Column, name: str) -> Column:
    """The value of one declaration of a style attribute, null if it is not there."""
    found = F.regexp_extract(F.coalesce(style, F.lit("")), rf"(?:^|;)\s*{name}\s*:\s*([^;]+)", 1)
    return F.when(found != "", F.trim(found))


def border(shorthand: Column) -> Column:
    """width_pt, style and colour of a border shorthand in any order; null for none."""
    from foliant.functions import color, units

    kind = F.regexp_extract(shorthand, r"\b(solid|dashed|dotted|double)\b", 1)
    return F.when(
        shorthand.isNotNull() & ~shorthand.rlike(r"\bnone\b"),
        F.struct(
            units.to_pt(F.regexp_extract(shorthand, r"(-?[0-9.]+\s*(?:pt|in|mm|cm|px))", 1)).alias("width_pt"),
            F.when(kind != "", kind).otherwise("solid").alias("style"),
            F.coalesce(color.to_hex(F.regexp_extract(shorthand, r"(#[0-9A-Fa-f]{3,6}|rgb\([^)]*\))", 1)), F.lit("#000000")).alias("color"),
        ),
    )


def safe_href(href: Column) -> Column:
    """http(s), mailto and block anchors only."""
    return F.coalesce(href.rlike(r"(?i)^(https?:|mailto:)|^#b\d+$"), F.lit(False))


def visible(text: Column, first: Column, last: Column) -> Column:
    """What a text node shows: line ends with their indentation are one space, blanks at a block's edge go."""
    text = F.regexp_replace(text, r"[ \t]*\r?\n[ \t]*", " ")
    text = F.when(first, F.regexp_replace(text, "^ +", "")).otherwise(text)
    return F.when(last, F.regexp_replace(text, " +$", "")).otherwise(text)


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(hwpx?|docx?|odt)$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]+)$", 1))


def bullet(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BULLETS)), F.least(level + 1, F.lit(len(BULLETS))))


def hangul_ordinal(n: Column) -> Column:
    """가 .. 하, then 가가, 가나 and so on (bijective base 14)."""
    letters, k = F.array(*map(F.lit, HANGUL)), F.lit(len(HANGUL))
    one = F.element_at(letters, ((n - 1) % k + 1).cast("int"))
    high = F.floor((n - 1) / k)
    two = F.element_at(letters, ((F.greatest(high, F.lit(1)) - 1) % k + 1).cast("int"))
    return F.when(high < 1, one).otherwise(F.concat(two, one))


def outline_label(level: Column, n: Column) -> Column:
    """The label of the n-th heading of a level (1 to 6)."""
    out = F.lit(None).cast("string")
    for k, (before, kind, after) in enumerate(OUTLINE, 1):
        number = n.cast("string") if kind == "decimal" else hangul_ordinal(n)
        out = F.when(level == k, F.concat(F.lit(before), number, F.lit(after))).otherwise(out)
    return out


def width_pt(text: Column, size: Column) -> Column:
    """The estimated width: a wide character is one em, any other 0.55."""
    wide = F.regexp_count(text, F.lit(WIDE))
    return (wide + (F.length(text) - wide) * F.lit(0.55)) * size


def height_pt(text: Column, size: Column, width: Column) -> Column:
    """The estimated height of a paragraph: lines x size x 1.6."""
    return F.greatest(F.lit(1), F.ceil(width_pt(F.trim(text), size) / width)) * size * F.lit(1.6)


def count_found(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap, whatever the case."""
    low, n = F.lower(text), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("long")


def replace_found(text: Column, needle: str, new: str) -> Column:
    """All occurrences replaced, whatever their case; both strings are literal."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in needle)
    return F.regexp_replace(text, f"(?i){quoted}", new.replace("\\", "\\\\").replace("$", "\\$"))


def piece(text: Column, most: int = 24) -> Column:
    """A comparison piece: no white space, its first characters, null if under four of them."""
    bare = F.substring(F.regexp_replace(text, r"\s+", ""), 1, most)
    return F.when(F.length(bare) >= 4, bare)


def cp1252(data: Column) -> Column:
    """Windows-1252 bytes as text: Latin-1 with its upper control characters replaced."""
    low, high = "".join(map(chr, range(0x80, 0xA0))), ""
    for i in range(0x80, 0xA0):
        high += bytes([i]).decode("cp1252", "replace")
    return F.translate(F.decode(data, "ISO-8859-1"), low, high)


def text_position(value: Column) -> Column:
    """super, sub or none of an ODF text-position."""
    share = F.regexp_extract(value, r"^\s*(-?\d+)%", 1).try_cast("int")
    return F.when(value.startswith("super") | (share > 0), "super").when(value.startswith("sub") | (share < 0), "sub")


def data_uri(uri: Column) -> Column:
    """mime and bytes of a base64 data URI, null for others."""
    pattern = r"^data:([\w/+.-]+);base64,([A-Za-z0-9+/=\s]+)$"
    return F.when(uri.rlike(pattern), F.struct(F.regexp_extract(uri, pattern, 1).alias("mime"), F.unbase64(F.regexp_extract(uri, pattern, 2)).alias("data")))


def image_mime(ext: Column) -> Column:
    """The MIME type of an image that a browser shows, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), F.lower(ext))


def hyperlink_command(command: Column) -> Column:
    return F.get(F.split(command, ";"), 0)


def used_chars(text: Column) -> Column:
    """The distinct characters of a text that are not white space."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(text, r"\s", ""), "")), lambda c: c != "")


def char_shape_css(size: Column, ratio: Column, color: Column, family: Column, attr: Column) -> Column:
    """The declarations of a char shape: bit 0 italic, bit 1 bold, bits 2-3 underline (1) or overline (2), black unsaid."""
    from foliant.functions import units

    under = units.bits(attr, 2, 3)
    return F.concat_ws(
        ";",
        F.format_string("font-size:%.1fpt", size.cast("double") * ratio / 10000),
        F.when(color != "rgb(0, 0, 0)", F.concat(F.lit("color:"), color)),
        F.when(family.isNotNull(), F.concat(F.lit("font-family:"), family)),
        F.when(units.bits(attr, 0, 0) == 1, F.lit("font-style:italic")),
        F.when(units.bits(attr, 1, 1) == 1, F.lit("font-weight:bold")),
        F.when(under == 1, F.lit("text-decoration:underline")).when(under == 2, F.lit("text-decoration:overline")),
    )


def para_shape_css(align: Column, indent: Column, first_line: Column, before: Column, after: Column, is_list: Column) -> Column:
    """The declarations of a paragraph shape; zero margins are unsaid, list items have no indent, and a hanging
    first line goes no further left than the margin."""
    pt = lambda name, v: F.when(v != 0, F.format_string(f"{name}:%.1fpt", v.cast("double") / 100))
    names = F.create_map(*[F.lit(x) for pair in {0: "justify", 1: "left", 2: "right", 3: "center"}.items() for x in pair])
    return F.concat_ws(
        ";",
        F.when(F.element_at(names, align.cast("int")).isNotNull(), F.concat(F.lit("text-align:"), F.element_at(names, align.cast("int")))),
        F.when(~is_list, pt("margin-left", indent)),
        F.when(~is_list, pt("text-indent", F.greatest(first_line, -indent))),
        pt("margin-top", before),
        pt("margin-bottom", after),
    )


def block_tag(outline: Column, is_list: Column, has_table: Column) -> Column:
    """hN for outline levels (six at most), li for list paragraphs without tables, else p."""
    return F.when(outline.isNotNull(), F.concat(F.lit("h"), F.least(outline, F.lit(6)))).when(is_list & ~has_table, F.lit("li")).otherwise(F.lit("p"))


def cell_css(width: Column, height: Column, pad: Column, background: Column, border_known: Column, border_css: Column, valign: Column) -> Column:
    """The declarations of a cell: at least 2 pt of padding (pad: left, right, top, bottom in hwpunits), and a border
    that is unknown, none or given."""
    side = lambda i: F.format_string("%.1fpt", F.greatest(F.get(pad, i).cast("double") / 100, F.lit(2.0)))
    return F.concat_ws(
        ";",
        F.format_string("width:%.1fpt", width.cast("double") / 100),
        F.format_string("height:%.1fpt", height.cast("double") / 100),
        F.concat(F.lit("padding:"), F.concat_ws(" ", side(2), side(1), side(3), side(0))),
        F.when(background.isNotNull(), F.concat(F.lit("background:"), background)),
        F.when(border_known, F.concat(F.lit("border:"), F.coalesce(border_css, F.lit("none")))),
        F.when(valign != "middle", F.concat(F.lit("vertical-align:"), valign)),
    )


def image_placeholder(ext: Column) -> Column:
    """What stands for an image that cannot be shown; null for one that can."""
    return F.when(image_mime(ext).isNull(), F.concat(F.lit("[이미지: "), F.lower(ext), F.lit("]")))


def has_content(text: Column, images: Column | None = None, breaks: Column | None = None) -> Column:
    """Anything but blanks, or an image, or a line break."""
    out = F.coalesce(text.rlike(r"\S"), F.lit(False))
    for other in (images, breaks):
        out = out if other is None else out | (F.coalesce(other, F.lit(0)) > 0)
    return out


def truncated(text: Column, most: int = 200_000) -> Column:
    """(text, cut): a report shows so many characters at most, and says whether it left some out."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("cut"))
