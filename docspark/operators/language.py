"""Language detection by script, at any grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def detect(rows: DataFrame, text: str = "text", default: str = "ru", min_chars: int = 40) -> DataFrame:
    """``rows`` with language, confidence, is_mixed and detected (array of language and confidence)."""
    body = F.col("_body")
    cyr, lat = F.greatest(T.cyrillic_ratio(body), F.lit(0.35)), F.greatest(T.latin_ratio(body), F.lit(0.35))
    short = (F.length(body) < min_chars) | (body == "")
    has_c, has_l = body.rlike(T.CYRILLIC), body.rlike("[A-Za-z]")
    entry = lambda lang, c: F.struct(lang.alias("language"), c.cast("double").alias("confidence"))
    fallback = F.array(entry(F.lit(default), F.lit(0.2)))
    detected = (
        F.when(short, fallback)
        .when(has_c & has_l, F.array(entry(F.lit("ru"), cyr), entry(F.lit("en"), lat)))
        .when(has_c, F.array(entry(F.lit("ru"), F.greatest(T.cyrillic_ratio(body), F.lit(0.8)))))
        .when(has_l, F.array(entry(F.lit("en"), F.greatest(T.latin_ratio(body), F.lit(0.8)))))
        .otherwise(fallback)
    )
    out = rows.withColumn("_body", T.trim(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("detected", detected)
    mixed = F.size("detected") == 2
    first = F.col("detected")[0]
    language = F.when(mixed & (F.col("detected")[1]["confidence"] > first["confidence"]), "en").otherwise(first["language"])
    confidence = F.when(mixed, F.greatest(first["confidence"], F.col("detected")[1]["confidence"])).when(first["confidence"] == 0.2, 0.2).otherwise(0.9)
    return out.withColumn("language", language).withColumn("confidence", confidence).withColumn("is_mixed", mixed).drop("_body")


def force(rows: DataFrame, hint: str | None) -> DataFrame:
    """A user's language hint overrides what was detected."""
    return rows if hint is None else rows.withColumn("language", F.lit(hint))
