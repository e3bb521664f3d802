"""Merging native and recognised elements, and detected regions, by geometry and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

BOX = ("x0", "y0", "x1", "y1")
#: Region types and the element types that they repeat.
REPEATS = {"table": "table", "formula": "formula", "figure": "image", "watermark": "watermark"}


def prefixed(df: DataFrame, p: str, *columns: str) -> DataFrame:
    return df.select("doc_id", "page_number", *(F.col(c).alias(p + c) for c in (*columns, *BOX)))


def duplicates(ocr: DataFrame, native: DataFrame, min_iou: float = 0.5, min_similarity: float = 0.8, how: str = "left_anti") -> DataFrame:
    """Recognised rows that no native row (``left_anti``) or some native row (``left_semi``) repeats.

    Pairs share a document and page, so one shuffle by these; the box test comes before the text test.
    """
    # texts are normalised and split once a row, not once a pair
    a = prefixed(ocr, "o_", "pos", "text").withColumn("o_parts", T.similarity_parts(F.col("o_text")))
    b = prefixed(native, "n_", "pos", "text").select("doc_id", "page_number", *("n_" + c for c in BOX), T.similarity_parts(F.col("n_text")).alias("n_parts"))
    same = (a["doc_id"] == b["doc_id"]) & (a["page_number"] == b["page_number"])
    near = F.when(G.iou("o_", "n_") >= min_iou, T.similarity_of(F.col("n_parts"), F.col("o_parts")) >= min_similarity).otherwise(False)
    return a.join(b, same & near, how).select("doc_id", "page_number", *(F.col("o_" + c).alias(c) for c in ("pos", "text", *BOX)))


def merge(native: DataFrame, ocr: DataFrame, prefer_native: bool = True, **limits) -> DataFrame:
    """Native rows, then the recognised ones that stay, with source and deduplication."""
    first = native.select("doc_id", "page_number", "pos", "text", *BOX).withColumn("source", F.lit("native")).withColumn("deduplication", F.lit(None).cast("string"))
    unique = duplicates(ocr, native, **limits).withColumn("source", F.lit("ocr")).withColumn("deduplication", F.lit("not_checked_or_unique"))
    out = first.unionByName(unique)
    if not prefer_native:
        out = out.unionByName(duplicates(ocr, native, how="left_semi", **limits).withColumn("source", F.lit("ocr")).withColumn("deduplication", F.lit("kept")))
    return out


_KEEP = """aggregate(regions, cast(array() as array<struct<pos:int,type:string,x0:double,y0:double,x1:double,y1:double>>),
  (s, r) -> if(exists(s, k -> k.type = r.type AND
    (greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0D) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0D))
    >= {iou}D * ((k.x1 - k.x0) * (k.y1 - k.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0D) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0D))),
    s, concat(s, array(r))))"""


def new_regions(regions: DataFrame, elements: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Regions that repeat no element of their kind, nor an earlier region that was kept on the page.

    The first test is an anti join; the second a fold in order over the few regions of a page.
    """
    table = F.create_map(*(F.lit(x) for pair in REPEATS.items() for x in pair))
    r = prefixed(regions.withColumn("type", table[F.col("type")]).where("type IS NOT NULL"), "r_", "pos", "type")
    e = prefixed(elements, "e_", "type")
    fresh = r.join(e, (r["doc_id"] == e["doc_id"]) & (r["page_number"] == e["page_number"]) & (F.col("r_type") == F.col("e_type")) & (G.iou("r_", "e_") >= min_iou), "left_anti")
    row = F.struct(F.col("r_pos").cast("int").alias("pos"), F.col("r_type").alias("type"), *(F.col("r_" + c).cast("double").alias(c) for c in BOX))
    pages = fresh.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("regions"))
    return pages.select("doc_id", "page_number", F.explode(F.expr(_KEEP.format(iou=min_iou))).alias("r")).select("doc_id", "page_number", "r.*")
