"""Validation of document tables: one row per issue, or its count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

TEXT_TYPES = ("text", "text_ocr", "heading", "paragraph", "blockquote", "list_item", "code", "caption")
FATAL, ERROR, WARNING = "fatal", "error", "warning"


def dangling_assets(elements: DataFrame, assets: DataFrame) -> DataFrame:
    """Elements whose asset isn't there; the reference table may be large, so no side is broadcast by hand."""
    return elements.where("asset_id IS NOT NULL").join(assets.select("doc_id", "asset_id").distinct(), ["doc_id", "asset_id"], "left_anti")


def dangling_chunks(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, element_id) of chunk members that no element has."""
    refs = chunks.select("doc_id", "chunk_id", F.explode("element_ids").alias("element_id"))
    return refs.join(elements.select("doc_id", "element_id").distinct(), ["doc_id", "element_id"], "left_anti").select("doc_id", "chunk_id", "element_id")


def issues(documents: DataFrame, pages: DataFrame, elements: DataFrame, assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, code, severity, n: how often each rule is broken in a document.

    documents (doc_id, document_id, schema_version, page_count, language), pages (doc_id, page_number,
    language), elements (doc_id, page_number, pos, element_id, type, text, provenance, confidence,
    reading_order, global_order, asset_id), assets (doc_id, asset_id), chunks (doc_id, chunk_id, element_ids).
    """
    blank = lambda c: F.col(c).isNull() | T.is_blank(F.col(c))
    repeats = lambda df, key: df.where(F.col(key).isNotNull()).groupBy("doc_id", key).count().where("count > 1").groupBy("doc_id").agg(F.sum(F.col("count") - 1).alias("n"))
    count = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"))

    def counted(df, rules):
        """Rules on single rows of one table: all counted in one pass."""
        sums = df.groupBy("doc_id").agg(*(F.count_if(test).alias(code) for code, _, test in rules))
        each = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("n")) for code, severity, _ in rules)))
        return sums.select("doc_id", each.alias("i")).where("i.n > 0").select("doc_id", "i.code", "i.severity", "i.n")

    one = lambda df: df.select("doc_id").distinct().withColumn("n", F.lit(1).cast("bigint"))
    actual = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    miscounted = documents.join(actual, "doc_id", "left").where("page_count IS NOT NULL AND page_count != coalesce(pages, 0)")
    later = F.lag("reading_order").over(W.partitionBy("doc_id", "page_number").orderBy("pos"))
    disorder = elements.where("reading_order IS NOT NULL").withColumn("_before", later).where("reading_order < _before").select("doc_id", "page_number").distinct()
    rows = [
        counted(documents, [("DOCUMENT_ID_EMPTY", FATAL, blank("document_id")), ("SCHEMA_VERSION_EMPTY", FATAL, blank("schema_version")), ("DOCUMENT_LANGUAGE_EMPTY", WARNING, blank("language"))]),
        counted(pages, [("PAGE_LANGUAGE_EMPTY", WARNING, blank("language"))]),
        counted(
            elements,
            [
                ("ELEMENT_MISSING_PROVENANCE", ERROR, F.col("provenance").isNull()),
                ("ELEMENT_MISSING_CONFIDENCE", ERROR, F.col("confidence").isNull()),
                ("TEXT_ELEMENT_CONTENT_EMPTY", ERROR, F.col("type").isin(*TEXT_TYPES) & blank("text") & (blank("html") if "html" in elements.columns else F.lit(True))),
            ],
        ),
    ]
    found = [
        ("PAGE_COUNT_MISMATCH", ERROR, count(miscounted)),
        ("DUPLICATE_ASSET_ID", ERROR, repeats(assets, "asset_id")),
        ("DUPLICATE_ELEMENT_ID", ERROR, repeats(elements, "element_id")),
        ("GLOBAL_ORDER_DUPLICATE", ERROR, repeats(elements, "global_order")),
        ("ASSET_REFERENCE_NOT_FOUND", ERROR, count(dangling_assets(elements, assets))),
        ("READING_ORDER_INVALID", ERROR, count(disorder)),
        ("CHUNK_ELEMENT_REF_MISSING", ERROR, one(dangling_chunks(chunks, elements))),
    ]
    named = [df.select("doc_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n") for code, severity, df in found]
    return reduce(DataFrame.unionByName, rows + named)
