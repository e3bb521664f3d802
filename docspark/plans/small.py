"""Queries of small functions: styles, media, regions, messages, confidences, JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import office
from ..operators import layout, messages
from .base import docs, lit, query, values
from .layouts import S_NATIVE, S_OCR, _native, _ocr

STYLES = values("style", [("Heading 1",), ("heading2",), ("Заголовок 7",), ("Normal",), ("Heading",), ("toc 0",), ("",)])


@query(f"SELECT style, contains(lower(style), 'heading') OR contains(lower(style), 'заголовок') AS is_heading, greatest(1, least(3, coalesce(TRY_CAST(nullif(regexp_replace(style, '[^0-9]', '', 'g'), '') AS INT), 1))) AS level FROM ({STYLES})")
def heading_styles(spark, sf_dir):
    return spark.sql(STYLES).select("style", office.is_heading_style(F.col("style")).alias("is_heading"), office.heading_level(F.col("style")).alias("level"))


TARGETS = values("folder target want", [("ppt/slides", "../media/image1.PNG", "ppt/media/image1.PNG"), ("word", "media/a.jpeg", "word/media/a.jpeg"), ("xl", "/docProps/x.emf", "docProps/x.emf"), ("a/b", "./c/../d.xyz", "a/b/d.xyz")])
_MEDIA = "CASE lower(regexp_extract(want, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN {lit(e)} THEN {lit(m)}" for e, m in office.MEDIA.items()) + " ELSE 'application/octet-stream' END"


@query(f"SELECT target, want AS path, {_MEDIA} AS mime_type FROM ({TARGETS})")
def media_targets(spark, sf_dir):
    path = office.resolve_target(F.col("folder"), F.col("target"))
    return spark.sql(TARGETS).select("target", path.alias("path"), office.media_type(path).alias("mime_type"))


_KINDS = "CASE pos % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'table' WHEN 2 THEN 'list_item' WHEN 3 THEN 'formula' ELSE 'paragraph' END AS type, CASE WHEN pos % 31 = 4 THEN 'page_watermark' END AS role"


@query(
    f"""SELECT doc_id, page_number, pos, CASE WHEN contains(coalesce(role, ''), 'watermark') THEN 'watermark' WHEN base = 'text' AND y0 <= 112 THEN 'header' WHEN base = 'text' AND y1 >= 1288 THEN 'footer' ELSE base END AS region
    FROM (SELECT *, CASE type WHEN 'heading' THEN 'title' WHEN 'table' THEN 'table' WHEN 'list_item' THEN 'list' WHEN 'formula' THEN 'formula' ELSE 'text' END AS base FROM (SELECT *, {_KINDS} FROM {S_NATIVE}))"""
)
def heuristic_regions(spark, sf_dir):
    rows = _native(spark, sf_dir).selectExpr("*", *[x.strip() for x in _KINDS.replace(" AS type,", " AS type;").split(";")])
    return rows.select("doc_id", "page_number", "pos", layout.heuristic_region(*(F.col(c) for c in ("type", "role", "y0", "y1"))).alias("region"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({lit(c)}, {lit(t)})" for c, t in [*messages.RUSSIAN.items(), ("OTHER", "fallback")]) + ") AS t(code, message)")
def localized_messages(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c in [*messages.RUSSIAN, "OTHER"]], "code string")
    return rows.select("code", messages.localized(F.col("code"), F.lit("fallback")).alias("message"))


@query(f"SELECT doc_id, coalesce(min(confidence), 1.0) AS min_confidence, coalesce(min(confidence), 1.0) < 0.65 AS low FROM documents LEFT JOIN (SELECT doc_id, confidence FROM {S_OCR}) USING (doc_id) GROUP BY doc_id")
def min_confidence(spark, sf_dir):
    rows = _ocr(spark, sf_dir).groupBy("doc_id").agg(F.min("confidence").alias("m"))
    least = F.coalesce("m", F.lit(1.0))
    return docs(spark, sf_dir).select("doc_id").join(rows, "doc_id", "left").select("doc_id", least.alias("min_confidence"), (least < 0.65).alias("low"))


@query("SELECT event_id, props->>'$.k' AS k, props IS NOT NULL AS present FROM events")
def json_fields(spark, sf_dir):
    return docs(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNotNull().alias("present"))


@query(
    """SELECT doc_id, w, h, round(640.0 / greatest(w, h), 6) AS scale, greatest(round(w * (640.0 / greatest(w, h)))::INT, 1) AS width, greatest(round(h * (640.0 / greatest(w, h)))::INT, 1) AS height
    FROM (SELECT doc_id, (doc_id * 37 % 1901 + 3)::INT AS w, (doc_id * 53 % 1403 + 5)::INT AS h FROM documents)"""
)
def letterbox(spark, sf_dir):
    sizes = docs(spark, sf_dir).selectExpr("doc_id", "CAST(doc_id * 37 % 1901 + 3 AS INT) AS w", "CAST(doc_id * 53 % 1403 + 5 AS INT) AS h")
    fitted = office.letterbox(F.col("w"), F.col("h"), 640)
    return sizes.select("doc_id", "w", "h", fitted.alias("b")).select("doc_id", "w", "h", F.round("b.scale", 6).alias("scale"), "b.width", "b.height")
