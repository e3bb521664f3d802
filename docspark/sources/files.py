"""Files: probing, format detection, upload checks, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats with their extensions and MIME types, in the order they are tested.
FORMATS = (
    ("pdf", ("pdf",), ("application/pdf",)),
    ("docx", ("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    ("doc", ("doc",), ("application/msword",)),
    ("html", ("html", "htm"), ("text/html",)),
    ("md", ("md", "markdown"), ("text/markdown",)),
    ("rtf", ("rtf",), ("application/rtf", "text/rtf")),
    ("pptx", ("pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",)),
    ("xlsx", ("xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",)),
    ("image", ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp"), ()),
    ("txt", ("txt", "log"), ("text/plain",)),
)
# First bytes, in hexadecimal, of files of known types.
MAGIC = (("25504446", "application/pdf"), ("89504e47", "image/png"), ("ffd8ff", "image/jpeg"), ("7b5c727466", "text/rtf"), ("424d", "image/bmp"), ("49492a00", "image/tiff"), ("4d4d002a", "image/tiff"), ("d0cf11e0", "application/msword"))
MEBIBYTE = 1 << 20


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def detect_format(ext: Column, mime_ext: Column, mime_magic: Column) -> Column:
    mime = F.lower(F.coalesce(mime_magic, mime_ext, F.lit("")))
    found = None
    for name, exts, mimes in FORMATS:
        test = ext.isin(*exts) | (mime.isin(*mimes) if mimes else F.startswith(mime, F.lit("image/")))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise("unknown")


def magic(content: Column) -> Column:
    start = F.lower(F.hex(F.substring(content, 1, 8)))
    found = None
    for prefix, mime in MAGIC:
        found = F.when(F.startswith(start, F.lit(prefix)), mime) if found is None else found.when(F.startswith(start, F.lit(prefix)), mime)
    return found


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with size, extension, format, sha256, protection and document id; contents stay in their rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = extension(name)
    out = files.select(
        F.col("path").alias("uri"), name.alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        detect_format(ext, F.lit(None).cast("string"), magic(F.col("content"))).alias("format"), F.translate(name, ".", "_").alias("document_id"), "content",
    )
    locked = (F.col("format") == "pdf") & F.contains(F.decode("content", "ISO-8859-1"), F.lit("/Encrypt"))
    return out.withColumn("is_encrypted", locked)


def safe_name(name: Column) -> Column:
    """The file's own name with unusual characters replaced, or null where nothing usable is left."""
    own = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(own, "[^A-Za-z0-9._-]", "_")
    return F.when(own.isin("", ".", "..") | F.contains(name, F.lit("..")), None).otherwise(clean)


def upload_error(name: Column, size: Column, max_mb: int = 512) -> Column:
    """The code of the first check that an upload fails, or null."""
    known = extension(safe_name(name)).isin(*(e for _, exts, _ in FORMATS for e in exts))
    return (
        F.when(size == 0, "EMPTY_FILE")
        .when(size > max_mb * MEBIBYTE, "DOCUMENT_TOO_LARGE")
        .when(safe_name(name).isNull(), "INVALID_FILENAME")
        .when(~known, "UNSUPPORTED_FILE_TYPE")
    )


def safe_entry(path: Column) -> Column:
    """Whether a path inside an archive stays inside it."""
    return ~(F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike("^[A-Za-z]:"))
