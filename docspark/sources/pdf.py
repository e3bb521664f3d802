"""PDF text: pages, their classes, blocks; and a reader of simple PDF files."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_texts(text: Column) -> Column:
    """Texts between form feeds, trimmed; one empty page for a blank text."""
    return F.transform(F.split(T.trim(F.coalesce(text, F.lit(""))), "\f"), T.trim)


def pages(docs: DataFrame, text: str = "text", min_chars: int = 20) -> DataFrame:
    """doc_id, page_number, text, native_chars, content_mode, requires_ocr, a row per page; narrow."""
    rows = docs.select("doc_id", F.posexplode(page_texts(F.col(text))).alias("p", "text"))
    chars = F.length(F.regexp_replace("text", f"{T.SPACE}+", ""))
    mode = F.when(F.col("native_chars") >= min_chars, "digital").when(F.col("native_chars") == 0, "scanned").otherwise("unknown")
    rows = rows.select("doc_id", (F.col("p") + 1).alias("page_number"), "text", chars.alias("native_chars"))
    return rows.withColumn("content_mode", mode).withColumn("requires_ocr", F.col("native_chars") < min_chars)


def document_mode(page_rows: DataFrame) -> DataFrame:
    """doc_id, pages, content_mode."""
    has = lambda m: F.max((F.col("content_mode") == m).cast("int")) == 1
    found = page_rows.groupBy("doc_id").agg(F.count("*").alias("pages"), has("digital").alias("d"), has("scanned").alias("s"))
    mode = F.when(F.col("d") & F.col("s"), "hybrid").when(F.col("d"), "digital").when(F.col("s"), "scanned").otherwise("unknown")
    return found.select("doc_id", "pages", mode.alias("content_mode"))


def blocks(page_rows: DataFrame) -> DataFrame:
    """doc_id, page_number, pos, type, text: paragraphs between blank lines; short ones without lower case are headings."""
    rows = page_rows.select("doc_id", "page_number", F.posexplode(F.filter(F.transform(F.split("text", "\n\n"), T.trim), lambda b: b != "")).alias("pos", "text"))
    heading = (F.octet_length("text") < 80) & ~F.col("text").rlike(r"\p{Ll}")
    return rows.select("doc_id", "page_number", "pos", F.when(heading, "heading").otherwise("text").alias("type"), "text")


def extract_text(data: bytes) -> str:
    """Text of a PDF whose pages show strings with Tj, TJ, ' and " in plain or Flate streams; pages end with form feeds."""
    out = []
    for match in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = match[1]
        if b"FlateDecode" in data[max(0, match.start() - 300) : match.start()].rpartition(b" obj")[2]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        lines = []
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            for op in re.finditer(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.)*\))\s*(TJ|Tj|'|\")|(T\*|Td|TD)", block, re.S):
                if op[3]:
                    lines.append("\n")
                    continue
                parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", op[1], re.S)
                text = b"".join(re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(m[1], m[1]), p) for p in parts)
                lines.append(text.decode("utf-8", "replace") if text[:2] != b"\xfe\xff" else text[2:].decode("utf-16-be", "replace"))
        out.append(re.sub(r"\n+", "\n", "".join(lines)).strip())
    return "\f".join(out)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, text, is_encrypted, page_hint, error) of PDF files (doc_id, content)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                data = data or b""
                locked = b"/Encrypt" in data
                try:
                    text = "" if locked else extract_text(data)
                except Exception:  # one broken file must not end the job; the error says that it has no text
                    text = ""
                hint = len(re.findall(rb"/Type\s*/Page[^s]", data))
                rows.append((doc_id, text, locked, hint, None if text else "PDF_NATIVE_TEXT_EXTRACTION_FAILED"))
            cols = list(zip(*rows)) or [()] * 5
            types = (b.schema.field("doc_id").type, pa.string(), pa.bool_(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "text", "is_encrypted", "page_hint", "error"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, text string, is_encrypted boolean, page_hint int, error string")


def visual_blocks(spans: DataFrame, dy: float = 4.0, gap: float = 24.0, line_gap: float = 1.8) -> DataFrame:
    """Spans (doc_id, page_number, pos, text, box) to lines to blocks, each taken by the first that fits.

    First-fit depends on the order of all before, so each page is one group.
    """
    import pandas as pd

    def build(page: pd.DataFrame) -> pd.DataFrame:
        lines: list[list[dict]] = []
        for s in page.sort_values("pos").to_dict("records"):
            for line in lines:
                last = line[-1]
                if abs(line[0]["y0"] - s["y0"]) <= dy and s["x0"] - last["x1"] <= gap:
                    line.append(s)
                    break
            else:
                lines.append([s])
        rows = []
        for line in sorted(lines, key=lambda x: min(s["y0"] for s in x)):
            line.sort(key=lambda s: s["x0"])
            box = [f(s[c] for s in line) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))]
            text = line[0]["text"] + "".join((" " if b["x0"] - a["x1"] > 2 else "") + b["text"] for a, b in zip(line, line[1:]))
            for block in rows:
                height = max(block["_h"], 1.0)
                if 0 <= box[1] - block["y1"] <= line_gap * height and min(box[2], block["x1"]) > max(box[0], block["x0"]):
                    block.update(text=block["text"] + "\n" + text, x0=min(block["x0"], box[0]), x1=max(block["x1"], box[2]), y1=max(block["y1"], box[3]))
                    break
            else:
                rows.append({"text": text, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "_h": box[3] - box[1]})
        key = page.iloc[0]
        return pd.DataFrame([(key["doc_id"], key["page_number"], i, r["text"], r["x0"], r["y0"], r["x1"], r["y1"]) for i, r in enumerate(rows)], columns=["doc_id", "page_number", "pos", "text", "x0", "y0", "x1", "y1"])

    return spans.groupBy("doc_id", "page_number").applyInPandas(build, "doc_id long, page_number int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
