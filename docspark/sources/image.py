"""Images: dimensions from file headers, page elements, sidecar files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_SIDECAR = "array<struct<text:string,bbox:array<float>,confidence:float>>"
LAYOUT_SIDECAR = "array<struct<type:string,bbox:array<float>,confidence:float>>"


def dimensions(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of PNG, JPEG, BMP, GIF, TIFF and WebP files."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:1] == b"I" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        found = {}
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0] if at + 2 <= len(data) else 0):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) == 12:
                tag, kind = struct.unpack(order + "HH", entry[:4])
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
        if 256 in found and 257 in found:
            return found[256], found[257]
    return None


def pages(files: DataFrame) -> DataFrame:
    """doc_id, width, height, error of image files (doc_id, content): one page each."""

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")

    found = files.select("doc_id", size("content").alias("s"))
    return found.select("doc_id", F.lit(1).alias("page_number"), "s.width", "s.height", F.when(F.col("s.width").isNull(), "IMAGE_DECODE_FAILED").alias("error"))


def sidecar(spark: SparkSession, path: str, kind: str = "ocr") -> DataFrame:
    """(image, rows) from files beside images, named <image>.ocr.json or <image>.layout.json."""
    schema = OCR_SIDECAR if kind == "ocr" else LAYOUT_SIDECAR
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{kind}.json", recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("name"))
    rows = files.select(F.regexp_replace("name", rf"\.{kind}\.json$", "").alias("image"), F.explode(F.from_json("value", schema)).alias("r"))
    return rows.select("image", "r.*") if kind == "ocr" else rows.select("image", "r.type", "r.bbox", F.coalesce("r.confidence", F.lit(0.9)).alias("confidence"))
