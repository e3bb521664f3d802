"""Page layout: reading order, repeated headers and footers, captions, heading hints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

TEXT_LIKE = ("text", "text_ocr", "heading", "paragraph", "blockquote", "list", "list_item", "code", "caption")
ANCHORS = ("image", "table", "chart")
PAGE = ("doc_id", "page_number")


def natural_order(elements: DataFrame) -> DataFrame:
    """``elements`` with reading_order within the page and global_order within the document, by pos."""
    return elements.withColumn("reading_order", F.row_number().over(W.partitionBy(*PAGE).orderBy("pos"))).withColumn(
        "global_order", F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "pos"))
    )


def column_keys(elements: DataFrame, width: float = 1000.0, gap: float = 0.08) -> DataFrame:
    """``elements`` with two_columns of their page and their column (0 or 1); one shuffle by page."""
    page = W.partitionBy(*PAGE)
    like = F.col("type").isin(*TEXT_LIKE)
    left = like & ((F.col("x0") + F.col("x1")) / 2 < width * 0.5)
    right = like & ~((F.col("x0") + F.col("x1")) / 2 < width * 0.5)
    free = F.min(F.when(right, F.col("x0"))).over(page) - F.greatest(F.max(F.when(left, F.col("x1"))).over(page), F.lit(0.0))
    two = (F.count_if(left).over(page) >= 2) & (F.count_if(right).over(page) >= 2) & (free >= width * gap)
    return elements.withColumn("two_columns", F.coalesce(two, F.lit(False))).withColumn("column", F.when(F.col("two_columns") & right, 1).otherwise(0))


def layout_order(elements: DataFrame, **page) -> DataFrame:
    """``elements`` with reading_order by column, top and left; equal places keep their order."""
    keyed = column_keys(elements, **page)
    return keyed.withColumn("reading_order", F.row_number().over(W.partitionBy(*PAGE).orderBy("column", "y0", "x0", "pos")))


def nearest_anchors(ordered: DataFrame, height: float = 1400.0) -> DataFrame:
    """(page, pos, anchor_pos, distance) of captions: the closest anchor before them that overlaps in x, within a tenth of the page."""
    caption = F.col("type") == "caption"
    c = ordered.where(caption).select(*PAGE, *(F.col(x).alias("c_" + x) for x in ("pos", "reading_order", "x0", "x1", "y0")))
    a = ordered.where(F.col("type").isin(*ANCHORS)).select(*PAGE, *(F.col(x).alias("a_" + x) for x in ("pos", "reading_order", "x0", "x1", "y1")))
    over = G.overlap(F.col("c_x0"), F.col("c_x1"), F.col("a_x0"), F.col("a_x1")) > 0
    pairs = c.join(a, list(PAGE)).where((F.col("a_reading_order") < F.col("c_reading_order")) & over).withColumn("distance", F.abs(F.col("c_y0") - F.col("a_y1")))
    best = pairs.groupBy(*PAGE, F.col("c_pos").alias("pos")).agg(F.min(F.struct("distance", "a_reading_order", "a_pos")).alias("b"))
    return best.select(*PAGE, "pos", F.col("b.a_pos").alias("anchor_pos"), F.col("b.distance").alias("distance")).where(F.col("distance") <= height * 0.1)


def captions_after_anchors(ordered: DataFrame, height: float = 1400.0) -> DataFrame:
    """``ordered`` with captions moved behind their anchors, one after the other, page by page.

    A move changes what the next caption sees, so each page is one group; pages are small.
    """
    schema = ordered.schema

    def move(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.sort_values("reading_order").to_dict("records")
        for at in range(len(rows)):
            row = rows[at]
            if row["type"] != "caption":
                continue
            best = min(
                ((abs(row["y0"] - a["y1"]), k) for k, a in enumerate(rows[:at]) if a["type"] in ANCHORS and min(a["x1"], row["x1"]) > max(a["x0"], row["x0"])),
                default=None,
            )
            if best and best[1] + 1 != at and best[0] <= height * 0.1:
                rows.insert(best[1] + 1, rows.pop(at))
        out = pd.DataFrame(rows, columns=page.columns)
        out["reading_order"] = range(1, len(out) + 1)
        return out

    return ordered.groupBy(*PAGE).applyInPandas(move, schema)


def repeat_key(text: Column) -> Column:
    return T.squeeze(T.ascii_lower(text))


def headers_footers(elements: DataFrame, height: float = 1400.0) -> DataFrame:
    """(doc_id, page_number, pos, band): elements at the top or bottom whose text recurs on enough pages.

    One pass and one shuffle by document: keys are made only for elements within the bands, and pages
    are counted over the document and over (band, key) within it. A document's pages are limited in number.
    """
    bands = F.array_compact(F.array(F.when(F.col("y0") <= height * 0.12, "header"), F.when(F.col("y1") >= height * 0.88, "footer")))
    rows = elements.select(*PAGE, "pos", bands.alias("bands"), F.when(F.size(bands) > 0, repeat_key(F.col("text"))).alias("key"))
    pages = F.size(F.collect_set("page_number").over(W.partitionBy("doc_id")))
    rows = rows.withColumn("pages", pages).where("key != '' AND pages >= 2").select(*PAGE, "pos", "key", "pages", F.explode("bands").alias("band"))
    on_pages = F.size(F.collect_set("page_number").over(W.partitionBy("doc_id", "band", "key")))
    enough = F.col("on_pages") >= F.greatest(F.ceil(F.col("pages") * 0.5), F.lit(2))
    always = (F.col("band") == "footer") & T.is_page_number(F.col("key"))
    return rows.withColumn("on_pages", on_pages).where(enough | always).select(*PAGE, "pos", "band")


def heading_hint(rows: DataFrame) -> DataFrame:
    """``rows`` (font_size, text, bold, y0) with is_heading, against the document's median font size."""
    median = F.median("font_size").over(W.partitionBy("doc_id"))
    return rows.withColumn("is_heading", (F.col("font_size") >= 1.2 * median) & (F.length("text") <= 120) & (F.col("bold") | (F.col("y0") <= 180)))


# The region that an element of a type makes.
REGIONS = {"heading": "title", "list": "list", "list_item": "list", "table": "table", "image": "figure", "page_image": "figure", "chart": "figure", "formula": "formula", "code": "code"}


def heuristic_region(kind: Column, role: Column, y0: Column, y1: Column, height: float = 1400.0) -> Column:
    """Type of the layout region that an element makes; text at the top or bottom is a header or footer."""
    base = F.coalesce(F.create_map(*(F.lit(x) for pair in REGIONS.items() for x in pair))[kind], F.lit("text"))
    edge = F.when((base == "text") & (y0 <= height * 0.08), "header").when((base == "text") & (y1 >= height * 0.92), "footer").otherwise(base)
    return F.when(F.contains(F.coalesce(role, F.lit("")), F.lit("watermark")), "watermark").otherwise(edge)


# The element, role and text that stand in for a detected region.
PLACEHOLDERS = {
    "table": ("table", "layout_table_placeholder", "[Обнаружена область таблицы макета]"),
    "formula": ("formula", "layout_formula_placeholder", "[Обнаружена область формулы макета]"),
    "figure": ("image", "layout_figure_placeholder", "[Обнаружена область изображения/фигуры]"),
    "watermark": ("watermark", "layout_watermark", "[Обнаружен возможный watermark]"),
}


def placeholders(regions: DataFrame) -> DataFrame:
    """Elements for regions (doc_id, page_number, region_id, region_type, box) of the types that get one."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("type", "role", "text")))) for pair in PLACEHOLDERS.items() for x in pair))
    made = regions.withColumn("_p", table[F.col("region_type")]).where("_p IS NOT NULL")
    ident = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_layout_"), "region_id")
    return made.select(*PAGE, ident.alias("element_id"), "_p.type", "_p.role", "_p.text", F.col("_p.text").alias("markdown"), "x0", "y0", "x1", "y1")
