"""Boxes as four columns each, prefixed: ``{p}x0``, ``{p}y0``, ``{p}x1``, ``{p}y1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def area(p: str) -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    x = overlap(F.col(f"{a}x0"), F.col(f"{a}x1"), F.col(f"{b}x0"), F.col(f"{b}x1"))
    return x * overlap(F.col(f"{a}y0"), F.col(f"{a}y1"), F.col(f"{b}y0"), F.col(f"{b}y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union in 0 to 1; 0 for empty unions and missing boxes."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.coalesce(F.when(union > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), both / union))), F.lit(0.0))


def clamp_box(p: str, width: Column, height: Column) -> list[Column]:
    """The box held to an image, in whole pixels."""
    return [
        F.floor(F.least(F.greatest(F.col(f"{p}x0"), F.lit(0.0)), width)).alias("x0"),
        F.floor(F.least(F.greatest(F.col(f"{p}y0"), F.lit(0.0)), height)).alias("y0"),
        F.ceil(F.least(F.greatest(F.col(f"{p}x1"), F.lit(0.0)), width)).alias("x1"),
        F.ceil(F.least(F.greatest(F.col(f"{p}y1"), F.lit(0.0)), height)).alias("y1"),
    ]
