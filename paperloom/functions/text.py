"""String functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes of web images, and their media types (any other: image/png).
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "svg", "gif")
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff"}
METAFILES = (".wmf", ".emf")
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９", "0123456789"


def strip(c: Column) -> Column:
    """Without Unicode blanks (U+3000 too) at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def escape_html(c: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def digits(c: Column) -> Column:
    """Digits, full-width ones too, as a number; null if it isn't one."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH).try_cast("int")


def basename(c: Column) -> Column:
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(c: Column) -> Column:
    """Lower-case suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(c), r"[^.](\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]*$", "")


def media_type(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, suffix(c)), F.lit("image/png"))


def is_metafile(c: Column) -> Column:
    return suffix(c).isin(*METAFILES)


def is_web_image(c: Column) -> Column:
    return suffix(c).isin(*[f".{x}" for x in IMAGE_SUFFIXES])


def data_uri(name: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(name), F.lit(";base64,"), F.base64(content))


def without_image_sizes(html: Column) -> Column:
    """Without the styles of images that set width or height, and without width and height attributes."""
    plain = F.regexp_replace(html, r'(?i)<img([^>]*?)\s+style="[^"]*(?:width|height)\s*:[^"]*"([^>]*)>', "<img$1$2>")
    return F.regexp_replace(plain, r'(?i)\s(?:width|height)="[^"]*"', "")


def prefixed(name: Column, file_id: Column) -> Column:
    start = F.concat(file_id, F.lit("_"))
    return F.when(F.startswith(name, start), name).otherwise(F.concat(start, name))


def unprefixed(name: Column, file_id: Column) -> Column:
    start = F.concat(file_id, F.lit("_"))
    return F.when(F.startswith(name, start), F.substr(name, F.char_length(start) + 1)).otherwise(name)


def image_url(name: Column, file_id: Column | None = None) -> Column:
    plain = F.regexp_replace(name, r"^media/", "")
    return F.concat(F.lit("/api/v1/images/"), *([file_id, F.lit("/")] if file_id is not None else []), plain)


def cache_name(name: Column, version: str = "v2") -> Column:
    """Safe file name of a converted image."""
    return F.concat(F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_"), F.lit(f".png.{version}"))


def disposition_name(header: Column) -> Column:
    """The file name in a Content-Disposition header: the encoded form first, else the plain one; else null."""
    encoded = F.nullif(F.regexp_extract(header, r"(?i)filename\*=(?:UTF-8'')?([^;]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(F.try_url_decode(encoded), plain)


def should_typeset(html: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(html, F.lit(x)) for x in ("math-inline", "math-block", "data-latex", "$")])
