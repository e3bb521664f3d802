"""Sinks: document models as JSON, page texts and Markdown, reports, assets, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T

# Folders of assets by type, and extensions by MIME type.
FOLDERS = {"page_image": "pages", "image": "images", "table": "tables", "formula": "formulas"}
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff", "image/webp": "webp", "image/svg+xml": "svg"}


def document_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and its non-blank pages in order, a blank line between."""
    kept = pages.where(~T.is_blank(F.col(column)))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", column))), lambda p: p[column]), "\n\n").alias(column))


def models(documents: DataFrame, pages: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and its whole model as a struct column; each child table is gathered by document once."""

    def gathered(df, name, *order):
        row = F.struct(*order, *(c for c in df.columns if c != "doc_id" and c not in order))
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias(name))

    out = documents.join(gathered(pages, "pages", "page_number"), "doc_id", "left").join(gathered(elements, "elements", "page_number", "pos"), "doc_id", "left").join(gathered(chunks, "chunks", "n"), "doc_id", "left")
    return out.select("doc_id", F.struct(F.lit("1.0.0").alias("schema_version"), *(c for c in out.columns)).alias("model"))


def write_models(rows: DataFrame, path: str, pretty: bool = False) -> None:
    """JSON texts, partitioned by a bucket of documents, so that one document is found without a scan of all."""
    options = {"pretty": "true"} if pretty else {}
    text = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("bucket"), F.to_json("model", options).alias("model"))
    text.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_model(spark, path: str, doc_id) -> DataFrame:
    """One document's model by its bucket."""
    key = F.lit(doc_id)
    return spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(key), F.lit(256))) & (F.col("doc_id") == key)).select("model")


def asset_rows(assets: DataFrame) -> DataFrame:
    """Assets (doc_id, idx, type, name, mime_type, content) with a repeatable id, a path and a digest."""
    ident = F.sha2(F.concat_ws(":", "doc_id", "idx"), 256)
    folder = F.coalesce(F.create_map(*(F.lit(x) for p in FOLDERS.items() for x in p))[F.col("type")], F.lit("other"))
    ext = F.coalesce(F.create_map(*(F.lit(x) for p in EXTENSIONS.items() for x in p))[F.col("mime_type")], F.lit("bin"))
    stem = T.sanitize_filename(F.regexp_replace(F.coalesce("name", F.lit("asset")), r"\.[^.]*$", ""))
    return assets.select("*", F.substring(ident, 1, 32).alias("asset_id"), F.concat_ws("/", folder, F.concat(stem, F.lit("_"), F.substring(ident, 1, 8), F.lit("."), ext)).alias("path"), F.sha2("content", 256).alias("sha256"))


def asset_bytes(assets: DataFrame, limit_mb: int = 2048) -> DataFrame:
    """doc_id, bytes and whether they pass the limit."""
    return assets.groupBy("doc_id").agg(F.sum(F.length("content")).alias("bytes")).withColumn("over_limit", F.col("bytes") > limit_mb * (1 << 20))


def report_markdown(report: DataFrame, title: Column | str = "doc_id") -> DataFrame:
    """doc_id and its report as a Markdown list."""
    lines = [F.concat(F.lit(f"- **{c}**: "), F.col(c).cast("string")) for c in report.columns if c != "doc_id"]
    return report.select("doc_id", F.concat_ws("\n", F.concat(F.lit("# "), F.col(title).cast("string") if isinstance(title, str) else title), *lines).alias("markdown"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest record of each key."""
    from .operators.metrics import latest

    return latest(current.unionByName(changes), key, order)


def read_model_files(spark, path: str, schema: str) -> DataFrame:
    """Models from JSON files of one document each."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def write_layout_debug(regions: DataFrame, elements: DataFrame, path: str) -> None:
    """Regions and order of elements, one JSON row per page; pages without regions have an empty list."""
    page = ("doc_id", "page_number")
    rows = lambda df, name, *cols: df.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    found = rows(elements, "elements", "reading_order", "element_id", "type").join(rows(regions, "regions", "region_id", "region_type"), list(page), "left")
    empty = F.array().cast("array<struct<region_id:string,region_type:string>>")
    found.withColumn("regions", F.coalesce("regions", empty)).write.mode("overwrite").json(path)
