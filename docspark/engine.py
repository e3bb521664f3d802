"""The whole way from files to models: probe, route by format, extract, order, chunk, validate, write.

Files are read once into a table partitioned by format, so that a format's reader meets its own
files only; what the readers and services find is written once as a table of elements, numbered in
reading order. Pages, chunks and issues come from these tables; shuffles are by document only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import backends, sinks
from .config import Config
from .functions import text as T
from .operators import book, chunking, domain, language, layout, legal, ocr, paging, quality, tables, validation
from .sources import convert, files, html, image, markdown, ooxml, pdf, txt

BOX = ("x0", "y0", "x1", "y1")
ELEMENT = ("doc_id", "page_number", "part", "pos", "type", "tag", "role", "text", "markdown", "confidence", "asset_id", "warning", "chunk_text", *BOX)
TYPES = {"page_number": "int", "part": "int", "pos": "int", "confidence": "double", **dict.fromkeys(BOX, "double")}
#: Elements of a page come in parts: tables found in a text, the text itself, what was taken out of it.
BEFORE, BODY, AFTER = -1, 0, 1
#: An element's place in its document is one number: the page above these bits, the reading order in them.
ORDER_BITS = 32


@dataclass
class Corpus:
    """Tables of a corpus, all keyed by doc_id."""

    documents: DataFrame
    pages: DataFrame
    elements: DataFrame
    chunks: DataFrame
    issues: DataFrame
    assets: DataFrame | None = None

    def quality(self) -> DataFrame:
        return quality.element_stats(self.elements, self.pages)


def _shape(df: DataFrame, **given) -> DataFrame:
    """The common columns of elements; missing ones are null."""
    have, given = set(df.columns), {"part": F.lit(BODY)} | given
    return df.select(*((given[c] if c in given else F.col(c) if c in have else F.lit(None)).cast(df.schema[c].dataType if c == "doc_id" else TYPES.get(c, "string")).alias(c) for c in ELEMENT))


def _tables_first(found: DataFrame, grid: str, role: str = "data_table", page: str | None = None) -> DataFrame:
    t = found.where(F.col(grid).isNotNull())
    t = t.select("doc_id", (F.lit(1) if page is None else F.col(page)).alias("page_number"), F.lit("table").alias("type"), F.lit(grid).alias("tag"), tables.plain(F.col(grid)).alias("text"), tables.markdown(F.col(grid)).alias("markdown"), F.lit(role).alias("role"), tables.linearized(F.col(grid)).alias("chunk_text"))
    return _shape(t, part=F.lit(BEFORE), pos=F.lit(0))


def read_texts(docs: DataFrame) -> DataFrame:
    """Elements of plain texts (doc_id, text): the first table of each kind, then the lines."""
    found = tables.detect(docs)
    return _tables_first(found, "pipe_table").unionByName(_tables_first(found, "tab_table")).unionByName(_shape(txt.elements(docs), page_number=F.lit(1), confidence=F.lit(0.99)))


def read_pdfs(files_: DataFrame, config: Config = Config()) -> DataFrame:
    """Elements of PDF files: tables and blocks of pages with text; pages without, up to the number that the file declares, as images to be read."""
    read = pdf.read(files_.select("doc_id", "content"))
    pages = pdf.pages(read.where("error IS NULL").select("doc_id", "text"), min_chars=config.native_text_min_chars)
    found = tables.detect(pages)
    declared = read.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest("page_hint", F.lit(1)))).alias("page_number"))
    scanned = declared.join(pages.where("NOT requires_ocr").select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")
    failed = read.where("error IS NOT NULL").select("doc_id", F.lit("error").alias("type"), F.lit(0).alias("pos"), F.col("error").alias("warning"))
    return (
        _shape(pdf.blocks(pages), confidence=F.lit(0.95), tag=F.lit("pdf_text"))
        .unionByName(_tables_first(found, "pipe_table", page="page_number"))
        .unionByName(_shape(scanned, type=F.lit("page_image"), role=F.lit("requires_ocr"), pos=F.lit(0), part=F.lit(AFTER)))
        .unionByName(_shape(failed, page_number=F.lit(1)))
    )


def read_files(probed: DataFrame, config: Config = Config()) -> DataFrame:
    """Elements of all files (doc_id, format, content), by format."""
    of = lambda *f: probed.where(F.col("format").isin(*f))
    body = F.make_valid_utf8(F.col("content").cast("string"))  # bad bytes become replacement marks
    plain = of("txt").select("doc_id", T.normalize_newlines(body).alias("text"))
    marked = of("md").select("doc_id", body.alias("text"))
    md = markdown.elements(marked)
    formulas = markdown.formulas(marked).select("doc_id", F.col("n").alias("pos"), F.lit("formula").alias("type"), F.col("latex").alias("text"), F.concat(F.lit("$$\n"), "latex", F.lit("\n$$")).alias("markdown"))
    pages = html.elements(of("html").select("doc_id", body.alias("html")), key="doc_id")
    scans = image.pages(of("image").select("doc_id", "content")).select("doc_id", "page_number", F.lit("page_image").alias("type"), F.lit(0).alias("pos"), F.col("error").alias("warning"))
    reader, spare = backends.of(config.backends, "ocr")
    lines = None
    if reader:
        lines = backends.apply(of("image").select("doc_id", F.lit(1).alias("page_number"), F.col("content").alias("image")), reader, spare)
        lines = ocr.split_low_confidence(lines, config.min_text_confidence, config.drop_low_confidence)[0]
    converted = convert.run(of("doc", "rtf").select("doc_id", "format", "content"))
    office = ooxml.elements(of("docx", "xlsx", "pptx").select("doc_id", "format", "content").unionByName(converted.where("status = 'ok' AND format = 'docx'").select("doc_id", "format", "content")))
    # DOCX has no pages of its own
    office = office.where("page_name IS NOT NULL OR role LIKE 'slide%' OR role = 'speaker_notes' OR type = 'error'").unionByName(
        paging.with_pages(office.where("page_name IS NULL AND coalesce(role, '') NOT LIKE 'slide%' AND coalesce(role, '') != 'speaker_notes' AND type != 'error'"), config.docx_lines_per_page)
    )
    cell_text = F.when(F.size("cells") > 0, tables.linearized(tables.grid_of(F.col("cells"))))
    failed = converted.where("status != 'ok'").select("doc_id", F.lit("error").alias("type"), F.lit(0).alias("pos"), F.concat_ws("; ", "diagnostics").alias("warning"))
    parts = [
        read_texts(plain),
        _tables_first(tables.detect(marked), "pipe_table"),
        _shape(md.withColumn("pos", F.col("order")).withColumn("role", F.col("type")), page_number=F.lit(1)),
        _shape(formulas, page_number=F.lit(1), role=F.lit("math_formula"), part=F.lit(AFTER)),
        _shape(pages.withColumn("pos", F.col("order")).withColumn("chunk_text", cell_text), page_number=F.lit(1)),
        read_pdfs(of("pdf"), config),
        _shape(scans),
        *([_shape(lines.withColumn("pos", F.col("pos") + 1))] if lines is not None else []),
        _shape(office.withColumnRenamed("asset", "asset_id").withColumn("chunk_text", cell_text)),
        _shape(failed, page_number=F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(elements: DataFrame, config: Config = Config()) -> DataFrame:
    """Elements in reading order: reading_order within the page, global_order within the document, element_id.

    Elements with boxes are ordered by column, top and left, and typed as headers and footers where
    these recur on the pages; the others keep their order.
    """
    rows = elements.withColumn("_key", F.xxhash64("part", "pos", "type", "tag", "role", "text", "warning"))
    by_place = [F.lit(0)] * 3
    if config.reading_order == "layout":
        rows = layout.column_keys(rows, gap=config.column_gap)
        by_place = [F.coalesce(F.when(F.col("y0").isNotNull(), c), F.lit(0)) for c in (F.col("column"), F.col("y0"), F.col("x0"))]
    order = ["part", *by_place, "pos", "type", "tag", "_key"]
    rows = rows.withColumn("reading_order", F.row_number().over(W.partitionBy("doc_id", "page_number").orderBy(*order)))
    rows = rows.withColumn("global_order", F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "reading_order"))).withColumn("pos", F.col("reading_order"))
    boxed = rows.where("y0 IS NOT NULL").select("doc_id", "page_number", "pos", "text", *BOX)
    bands = layout.headers_footers(boxed).groupBy("doc_id", "page_number", "pos").agg(F.min("band").alias("band"))
    rows = rows.join(bands, ["doc_id", "page_number", "pos"], "left")
    out = rows.withColumns({
        "type": F.coalesce("band", "type"), "element_id": F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_e"), F.col("pos").cast("string")),
        "provenance": F.coalesce("tag", F.lit("parser")), "confidence": F.coalesce("confidence", F.lit(0.9)),
    })
    return out.select(*(c for c in ELEMENT if c != "part"), "element_id", "reading_order", "global_order", "provenance")


def build(documents: DataFrame, elements: DataFrame, config: Config = Config(), assets: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Corpus:
    """Pages, chunks and issues from numbered elements and one row per document (doc_id, document_id, ...); ``keep`` may write a table that is read again."""
    content = elements.where("type != 'error'")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "type", "text", "markdown")))
    joined = lambda f, sep: F.array_join(F.filter(F.transform("_e", lambda e: e[f]), lambda x: x.isNotNull() & (x != "")), sep)
    pages = content.groupBy("doc_id", "page_number").agg(ordered.alias("_e"))
    pages = pages.select("doc_id", "page_number", joined("text", "\n").alias("text"), joined("markdown", "\n\n").alias("markdown"))
    pages = keep(language.detect(pages, default=config.default_language, min_chars=config.language_min_chars).drop("detected", "confidence", "is_mixed"))
    held = content.where(~F.col("type").isin("header", "footer")) if config.exclude_headers_from_chunks else content
    place = F.shiftleft(F.col("page_number").cast("long"), ORDER_BITS).bitwiseOR(F.col("pos").cast("long"))
    flat = held.select("doc_id", place.alias("pos"), "type", F.coalesce("chunk_text", "text", F.lit("")).alias("text"), F.coalesce("markdown", "text", F.lit("")).alias("markdown"))
    chunks = chunking.flags(chunking.chunk(chunking.gather(flat), config.max_tokens, positions=True))
    name = lambda p: F.concat(F.lit("p"), F.shiftright(p, ORDER_BITS).cast("string"), F.lit("_e"), p.bitwiseAND(F.lit((1 << ORDER_BITS) - 1)).cast("string"))
    chunks = keep(chunks.withColumn("element_ids", F.transform("positions", name)).drop("positions"))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("text"))
    facts = content.groupBy("doc_id").agg(
        F.min("confidence").alias("min_confidence"), F.coalesce(F.bool_or(F.col("role") == "layout_table_placeholder"), F.lit(False)).alias("placeholder_tables"),
        F.coalesce(F.bool_or(F.col("role") == "layout_formula_placeholder"), F.lit(False)).alias("placeholder_formulas"),
        (F.bool_or(F.col("type") == "table") & F.bool_or(F.col("type").isin("image", "page_image")) & F.bool_or(F.col("type") == "formula")).alias("_mixed"),
    )
    described = documents.join(whole, "doc_id", "left").join(facts, "doc_id", "left")
    described = language.detect(described, default=config.default_language, min_chars=config.language_min_chars).drop("detected", "confidence", "is_mixed")
    described = domain.detect(described, mixed=F.coalesce("_mixed", F.lit(False))).drop("_mixed")
    described = described.withColumn("profile", domain.profile(F.col("domain"))).withColumn("schema_version", F.lit("1.0.0"))
    described = described.withColumn("legal_missing", (F.col("domain") == "legal") & ~legal.required_present(F.coalesce("text", F.lit(""))))
    filled = {"min_confidence": 1.0, "placeholder_tables": False, "placeholder_formulas": False}
    described = keep(domain.slow_path(described.fillna(filled), config.slow_path_threshold, config.allow_slow_path).withColumnRenamed("reasons", "slow_path_reasons").withColumnRenamed("should_run", "slow_path"))
    assets = elements.where("false").select("doc_id", "asset_id") if assets is None else assets
    issues = validation.issues(described, pages, content, assets, chunks.select("doc_id", "chunk_id", "element_ids"))
    return Corpus(described, pages, content, chunks, issues, assets)


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only where there are no other machines."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="docspark-")
    return f"{shared}/process-{uuid.uuid4().hex}"


def process(spark: SparkSession, path: str, config: Config = Config(), work: str | None = None) -> Corpus:
    """All files under ``path``; the tables of the corpus are written under ``work``, which is the caller's to delete."""
    work = work or work_folder(spark)

    def stored(df: DataFrame, *partitions: str) -> DataFrame:
        place = f"{work}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    # one row to a small row group: contents may be large
    probed = files.probe(spark, path).withColumn("doc_id", F.xxhash64("uri")).where(F.col("size_bytes") <= config.max_file_size_mb * (1 << 20))
    probed = stored(probed, "format")
    office = probed.where(F.col("format").isin(*ooxml.READERS)).select("doc_id", "format", "content")
    assets = stored(sinks.asset_rows(ooxml.media(office)).withColumnRenamed("asset_id", "asset_key").withColumn("asset_id", F.col("name")))
    elements = stored(numbered(read_files(probed, config), config))
    return build(probed.drop("content"), elements, config, assets, stored)


def enrich_legal(corpus: Corpus) -> DataFrame:
    """Legal fields of the documents that are legal ones."""
    return legal.extract(corpus.documents.where("domain = 'legal'"))


def enrich_books(corpus: Corpus) -> DataFrame:
    """Chapters, footnotes and dehyphenated text of the documents that are books."""
    books = corpus.documents.where(F.col("domain").isin("fiction", "historical_book")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return book.dehyphenate(books.withColumn("chapters", book.chapters(F.col("text"))).withColumn("footnotes", book.footnotes(F.col("text"))))


def write(corpus: Corpus, path: str, config: Config = Config()) -> None:
    """Models as JSON, texts and Markdown, assets with their bytes, and the tables themselves."""
    models = sinks.models(corpus.documents.drop("text"), corpus.pages, corpus.elements, corpus.chunks)
    sinks.write_models(models, f"{path}/models")
    sinks.document_text(corpus.pages).write.mode("overwrite").parquet(f"{path}/plain_text")
    sinks.document_text(corpus.pages, "markdown").write.mode("overwrite").parquet(f"{path}/markdown")
    for name in ("elements", "chunks", "issues"):
        getattr(corpus, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if corpus.assets is not None and "content" in corpus.assets.columns:
        over = sinks.asset_bytes(corpus.assets, config.max_assets_mb).where("over_limit").select("doc_id")
        corpus.assets.join(over, "doc_id", "left_anti").write.mode("overwrite").parquet(f"{path}/assets")
