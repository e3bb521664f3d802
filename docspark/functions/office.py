"""Small office and media functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME types of embedded media by extension.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def is_heading_style(style: Column) -> Column:
    return F.contains(F.lower(style), F.lit("heading")) | F.contains(F.lower(style), F.lit("заголовок"))


def heading_level(style: Column) -> Column:
    """The number in a style's name, held to 1 to 3; 1 without one."""
    digits = F.regexp_replace(style, "[^0-9]", "")
    number = F.coalesce(F.try_to_number(F.when(digits != "", digits), F.lit("999999999")).cast("int"), F.lit(1))
    return F.greatest(F.lit(1), F.least(F.lit(3), number))


def media_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def resolve_target(folder: Column, target: Column) -> Column:
    """A relationship's target against its part's folder: a leading slash starts at the root, '..' goes up."""
    parts = F.split(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat_ws("/", folder, target)), "/")
    step = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(p.isin("", "."), done).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def emu_to_px(emu: Column) -> Column:
    return emu / 9525


def formula_text(xml: Column) -> Column:
    """The text of an OMML formula: its tags removed."""
    return F.trim(F.regexp_replace(xml, "(?s)<[^>]+>", ""))


def letterbox(width: Column, height: Column, target: int) -> Column:
    """struct(scale, width, height, pad_x, pad_y) that fits an image into a square of ``target`` pixels."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    w, h = F.greatest(F.round(width * scale).cast("int"), F.lit(1)), F.greatest(F.round(height * scale).cast("int"), F.lit(1))
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), F.floor((target - w) / 2).cast("int").alias("pad_x"), F.floor((target - h) / 2).cast("int").alias("pad_y"))
