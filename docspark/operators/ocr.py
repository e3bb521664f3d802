"""Recognised lines: order, confidence, paragraphs, greedy decoding, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_number")


def split_low_confidence(lines: DataFrame, limit: float = 0.5, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, low)."""
    low = lines.where(F.col("confidence") < limit)
    return (lines.where(~(F.col("confidence") < limit)) if drop else lines), low


def reading_order(lines: DataFrame, page_height: float = 1400.0) -> DataFrame:
    """``lines`` with order: lines whose centres are level go by x, others by y.

    'Level' isn't transitive, so the order comes from the pairwise rule, page by page.
    """
    from functools import cmp_to_key

    level = max(1.0, max(page_height, 1.0) * 0.015)
    schema = lines.withColumn("order", F.lit(0)).schema

    def sort(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.sort_values("pos").to_dict("records")

        def compare(a, b):
            ya, yb = (a["y0"] + a["y1"]) / 2, (b["y0"] + b["y1"]) / 2
            x, y = (a["x0"], b["x0"]) if abs(ya - yb) <= level else (ya, yb)
            return (x > y) - (x < y)

        rows.sort(key=cmp_to_key(compare))
        return pd.DataFrame(rows, columns=page.columns).assign(order=range(1, len(rows) + 1))

    return lines.groupBy(*PAGE).applyInPandas(sort, schema)


def paragraphs(lines: DataFrame, gap_ratio: float = 1.8, tolerance: float = 0.015, order: str = "pos") -> DataFrame:
    """Lines joined while the gap to the one before is small: box, mean confidence and text of each run."""
    page = W.partitionBy(*PAGE).orderBy(order)
    height = F.greatest(F.lag("y1").over(page) - F.lag("y0").over(page), F.lit(1.0))
    starts = ~F.coalesce(F.col("y0") - F.lag("y1").over(page) <= height * gap_ratio + tolerance, F.lit(False))
    runs = lines.withColumn("_s", starts.cast("int")).withColumn("paragraph", F.sum("_s").over(page))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")
    return runs.groupBy(*PAGE, "paragraph").agg(
        F.count("*").alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"), text.alias("text")
    )


def greedy_decode(indices: Column, charset: str, blank: int = 0) -> Column:
    """Text of label indices: repeats collapse, then blanks go; a blank between keeps both."""
    chars = F.array(*map(F.lit, charset))
    kept = F.filter(indices, lambda x, i: (i == 0) | (x != F.get(indices, i - 1)))
    return F.array_join(F.transform(F.filter(kept, lambda x: x != blank), lambda x: F.coalesce(F.get(chars, x.cast("int")), F.lit(""))), "")


def argmax(step: Column) -> Column:
    """Index of the largest score, the last of equals."""
    return F.size(step) - F.array_position(F.reverse(step), F.array_max(step)).cast("int")


def decode_scores(steps: Column, charset: str, blank: int = 0) -> Column:
    """struct(text, confidence) of per-step scores; the confidence is the least of the steps' maxima, 0 at least."""
    text = greedy_decode(F.transform(steps, argmax), charset, blank)
    return F.struct(text.alias("text"), F.greatest(F.array_min(F.transform(steps, F.array_max)), F.lit(0.0)).alias("confidence"))


def overall_confidence(detection: Column, recognition: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * detection + 0.6 * recognition))


def batches(rows: DataFrame, size: int, *keys: str, order: str = "pos") -> DataFrame:
    """``rows`` with batch: consecutive groups of ``size`` within the keys."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size).cast("int"))


def boxes(detections: Column, width: float, height: float) -> Column:
    """Detector output (x0, y0, x1, y1, confidence) without degenerate boxes; the whole image at 0.8 if none is left."""
    real = F.filter(detections, lambda d: (d[2] > d[0]) & (d[3] > d[1]))
    return F.when(F.size(real) > 0, real).otherwise(F.array(F.array(*(F.lit(float(v)) for v in (0, 0, width, height, 0.8)))))
