"""Office packages: DOCX, XLSX and PPTX to rows of elements, with the standard library over Arrow batches.

Tags are matched by their exact names. A package that breaks a limit or can't be read gives one
row of type ``error`` with a code in ``warning``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = "struct<row:int,column:int,rowspan:int,colspan:int,text:string,formula:string,is_header:boolean>"
DDL = f"page_number int, page_name string, pos int, type string, tag string, role string, text string, markdown string, list_type string, cells array<{CELL}>, asset string, warning string"
_CELL = pa.struct([("row", pa.int32()), ("column", pa.int32()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("text", pa.string()), ("formula", pa.string()), ("is_header", pa.bool_())])
FIELDS = {"page_number": pa.int32(), "page_name": pa.string(), "pos": pa.int32(), "type": pa.string(), "tag": pa.string(), "role": pa.string(), "text": pa.string(), "markdown": pa.string(), "list_type": pa.string(), "cells": pa.list_(_CELL), "asset": pa.string(), "warning": pa.string()}
#: Bytes of an entry and of a whole package, unpacked.
MOST_ENTRY, MOST_TOTAL = 32 << 20, 256 << 20
MOST_ROWS = 200
MOST_COLUMNS = 1000


class PackageError(ValueError):
    pass


def local(node) -> str:
    return node.tag.rpartition("}")[2]


def attr(node, name, default=None):
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), default)


def find_all(node, *names):
    return [n for n in node.iter() if local(n) in names]


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data or b""))
        except zipfile.BadZipFile as e:
            raise PackageError("OOXML_PACKAGE_INVALID") from e
        total = 0
        for entry in self.zip.infolist():
            name = entry.filename
            if name.startswith("/") or "\\" in name or ".." in name.split("/"):
                raise PackageError("OOXML_UNSAFE_PATH")
            total += entry.file_size
            if entry.file_size > MOST_ENTRY or total > MOST_TOTAL:
                raise PackageError("OOXML_TOO_LARGE")
        self.names = sorted(e.filename for e in self.zip.infolist())

    def xml(self, name):
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except ElementTree.ParseError as e:
            raise PackageError("OOXML_XML_INVALID") from e

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id: (target path, type, external) of a part."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else []:
            outside = attr(r, "TargetMode") == "External"
            target = attr(r, "Target", "")
            path = target if outside else posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:]
            out[attr(r, "Id")] = (path, attr(r, "Type", "").rpartition("/")[2], outside)
        return out


def row(page, pos, kind, text="", **more):
    base = dict.fromkeys(FIELDS) | {"page_number": page, "pos": pos, "type": kind, "text": text, "markdown": text, "cells": []}
    return base | more


def paragraph_text(p) -> str:
    parts = []
    for n in p.iter():
        name = local(n)
        if name == "t":
            parts.append(n.text or "")
        elif name == "tab":
            parts.append("\t")
        elif name in ("br", "cr"):
            parts.append("\n")
    return "".join(parts)


def _styles(package):
    headings, mono = set(), set()
    root = package.xml("word/styles.xml")
    for s in find_all(root, "style") if root is not None else []:
        name = next((attr(n, "val", "") for n in s if local(n) == "name"), "").lower()
        fonts = [v.lower() for n in find_all(s, "rFonts") for v in n.attrib.values()]
        if "heading" in name or "заголовок" in name:
            headings.add(attr(s, "styleId"))
        if "code" in name or any("courier" in f or "mono" in f or "consolas" in f for f in fonts):
            mono.add(attr(s, "styleId"))
    return headings, mono


def _numbering(package):
    root = package.xml("word/numbering.xml")
    if root is None:
        return {}
    formats = {}
    for a in (n for n in root if local(n) == "abstractNum"):
        formats[attr(a, "abstractNumId")] = next((attr(f, "val") for f in find_all(a, "numFmt")), "decimal")
    out = {}
    for n in (n for n in root if local(n) == "num"):
        ref = next((attr(x, "val") for x in n if local(x) == "abstractNumId"), None)
        out[attr(n, "numId")] = "unordered" if formats.get(ref) == "bullet" else "ordered"
    return out


def docx(data: bytes) -> list[dict]:
    package = Package(data)
    root = package.xml("word/document.xml")
    if root is None:
        raise PackageError("DOCX_DOCUMENT_XML_MISSING")
    headings, mono = _styles(package)
    numbers, relations = _numbering(package), package.relations("word/document.xml")
    body = next((n for n in root if local(n) == "body"), root)
    out = []
    for block in body:
        if local(block) == "tbl":
            cells, width = [], 0
            for r, tr in enumerate(n for n in block if local(n) == "tr"):
                column = 0
                for tc in (n for n in tr if local(n) == "tc"):
                    span = int(next((attr(g, "val", "1") for g in find_all(tc, "gridSpan")), "1"))
                    text = "\n".join(t for t in (paragraph_text(p) for p in find_all(tc, "p")) if t.strip())
                    cells.append({"row": r, "column": column, "rowspan": 1, "colspan": span, "text": text, "formula": None, "is_header": r == 0})
                    column += span
                width = max(width, column)
            merged = bool(find_all(block, "vMerge")) or any(c["colspan"] > 1 for c in cells)
            out.append(row(1, len(out), "table", " | ".join(c["text"] for c in cells), tag="table", role="data_table", cells=cells, warning="COMPLEX_TABLE_MARKDOWN_APPROXIMATION" if merged else None))
        elif local(block) == "p":
            style = next((attr(s, "val", "") for s in find_all(block, "pStyle")), "")
            text = paragraph_text(block).strip()
            number = next((attr(n, "val") for n in find_all(block, "numId")), None)
            for math in find_all(block, "oMath"):
                formula = "".join(t.text or "" for t in find_all(math, "t"))
                out.append(row(1, len(out), "formula", formula, tag="formula", role="math_formula", markdown=f"$$\n{formula}\n$$"))
            for blip in find_all(block, "blip"):
                target = relations.get(attr(blip, "embed"))
                if target and not target[2]:
                    out.append(row(1, len(out), "image", "", tag="img", role="embedded_image", asset=target[0], markdown=f"![image]({target[0]})"))
            if not text:
                continue
            named = style in headings or "heading" in style.lower() or "заголовок" in style.lower()
            if number is not None:
                out.append(row(1, len(out), "list_item", text, tag="li", role="list_item", list_type=numbers.get(number, "ordered"), markdown=f"- {text}"))
            elif style in mono:
                out.append(row(1, len(out), "code", text, tag="code", role="code_block", markdown=f"```\n{text}\n```"))
            elif named or (len(text.encode()) < 100 and text[0].isupper()):
                level = max(1, min(3, int("".join(c for c in style if c.isdigit()) or 1)))
                out.append(row(1, len(out), "heading", text, tag=f"h{level}", role="section_title", markdown=f"{'#' * level} {text}"))
            else:
                out.append(row(1, len(out), "paragraph", text, tag="p", role="paragraph"))
    for part, kind, role in (("footnotes", "footnote", "footnote"), ("endnotes", "footnote", "endnote"), ("comments", "paragraph", "comment"), ("header", "header", "page_header"), ("footer", "footer", "page_footer")):
        for name in package.names:
            if re.fullmatch(rf"word/{part}\d*\.xml", name):
                for t in find_all(package.xml(name), "t"):
                    if (t.text or "").strip():
                        out.append(row(1, len(out), kind, t.text.strip(), tag=part, role=role))
    return out


def _column(name: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", name)[0]:
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def sheets(package: Package):
    """(name, width, texts of the rows that hold any by their number, formulas by place) of each sheet.

    Rows are kept as they are filled, since a sheet may have its cells far apart.
    """
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise PackageError("XLSX_WORKBOOK_XML_MISSING")
    relations = package.relations("xl/workbook.xml")
    shared = package.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in find_all(si, "t")) for si in (n for n in shared if local(n) == "si")] if shared is not None else []
    for sheet in find_all(book, "sheet"):
        path = relations.get(attr(sheet, "id"), ("", "", False))[0]
        root = package.xml(path)
        grid, formulas = {}, {}
        for r, tr in enumerate(find_all(root, "row") if root is not None else []):
            given = str(attr(tr, "r", ""))
            at = int(given) - 1 if re.fullmatch("[0-9]{1,7}", given) and int(given) else r
            for k, c in enumerate(n for n in tr if local(n) == "c"):
                col = _column(attr(c, "r", "")) if attr(c, "r") else k
                value = next((n.text or "" for n in c if local(n) == "v"), "")
                kind = attr(c, "t", "n")
                if kind == "s" and re.fullmatch("[0-9]{1,9}", value) and int(value) < len(strings):
                    value = strings[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in find_all(c, "t"))
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                formula = next((n.text for n in c if local(n) == "f" and n.text), None)
                if formula:
                    formulas[at, col] = "=" + formula
                grid[at, col] = " ".join(value.split())
        width = max((c for _, c in grid), default=-1) + 1
        rows: dict[int, dict[int, str]] = {}
        for (r, c), v in grid.items():
            rows.setdefault(r, {})[c] = v
        yield attr(sheet, "name", ""), width, {r: v for r, v in sorted(rows.items()) if any(x.strip() for x in v.values())}, formulas


def _cell(r: int, c: int, text: str, formula: str | None, is_header: bool) -> dict:
    formula = formula or (text if text.startswith("=") and len(text) > 1 else None)
    return {"row": r, "column": c, "rowspan": 1, "colspan": 1, "text": text, "formula": formula, "is_header": is_header}


def xlsx(data: bytes) -> list[dict]:
    package = Package(data)
    media = [n for n in package.names if n.startswith("xl/media/")]
    out = []
    for page, (name, width, rows, formulas) in enumerate(sheets(package), 1):
        pos = 0
        runs: list[list[int]] = []
        for r in rows:
            if runs and r == runs[-1][1]:
                runs[-1][1] = r + 1
            else:
                runs.append([r, r + 1])
        for a, b in runs:
            for s in range(a, b, MOST_ROWS):
                cells = []
                for r in range(s, min(b, s + MOST_ROWS)):
                    # of a sheet wider than any table is only the filled cells count
                    for c in range(width) if width <= MOST_COLUMNS else sorted(rows[r]):
                        cells.append(_cell(r - s, c, rows[r].get(c, ""), formulas.get((r, c)), r == s))
                out.append(row(page, pos, "table", " | ".join(c["text"] for c in cells), page_name=name, tag="table", role="sheet_range", cells=cells))
                pos += 1
        for m in media:  # the workbook's media go to every sheet
            out.append(row(page, pos, "image", "", page_name=name, tag="img", role="embedded_image", asset=m))
            pos += 1
    return out


def pptx(data: bytes) -> list[dict]:
    package = Package(data)
    deck = package.xml("ppt/presentation.xml")
    if deck is None:
        raise PackageError("PPTX_PRESENTATION_XML_MISSING")
    relations = package.relations("ppt/presentation.xml")
    if not relations:
        raise PackageError("PPTX_RELATIONSHIP_MISSING")
    out = []
    for page, ref in enumerate((n for n in find_all(deck, "sldId")), 1):
        path = relations.get(next((v for k, v in ref.attrib.items() if k.endswith("}id")), None), ("", "", False))[0]
        slide = package.xml(path)
        if slide is None:
            out.append(row(page, 0, "error", warning="PPTX_SLIDE_MISSING"))
            continue
        links, pos = package.relations(path), 0
        for i, shape in enumerate(find_all(slide, "sp")):
            lines, bullets = [], []
            for p in find_all(shape, "p"):
                line = "".join(t.text or "" for t in find_all(p, "t")).strip()
                if line:
                    lines.append(line)
                    if find_all(p, "buChar", "buAutoNum"):
                        bullets.append(line)
            if not lines:
                continue
            title = i == 0 or any(attr(ph, "type") in ("title", "ctrTitle") for ph in find_all(shape, "ph"))
            text = "\n".join(lines)
            kind, mark = ("heading", f"# {text}") if title else ("text", text)
            out.append(row(page, pos, kind, text, tag="shape", role="slide_title" if title else "slide_text", markdown=mark))
            pos += 1
            if bullets:
                out.append(row(page, pos, "list", "\n".join(bullets), tag="ul", role="slide_list", list_type="unordered", markdown="\n".join(f"- {b}" for b in bullets)))
                pos += 1
        for table in find_all(slide, "tbl"):
            cells = [
                {"row": r, "column": c, "rowspan": 1, "colspan": 1, "text": "".join(t.text or "" for t in find_all(tc, "t")), "formula": None, "is_header": r == 0}
                for r, tr in enumerate(find_all(table, "tr")) for c, tc in enumerate(n for n in tr if local(n) == "tc")
            ]
            out.append(row(page, pos, "table", " | ".join(c["text"] for c in cells), tag="table", role="slide_table", cells=cells))
            pos += 1
        for blip in find_all(slide, "blip"):
            target = links.get(attr(blip, "embed"))
            if target and not target[2]:
                out.append(row(page, pos, "image", "", tag="img", role="slide_image", asset=target[0]))
                pos += 1
        for target, kind, outside in links.values():
            notes = package.xml(target) if kind == "notesSlide" and not outside else None
            text = "\n".join(t.text.strip() for t in find_all(notes, "t") if (t.text or "").strip()) if notes is not None else ""
            if text:
                out.append(row(page, pos, "footnote", text, tag="notes", role="speaker_notes"))
                pos += 1
    return out


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def elements(files: DataFrame) -> DataFrame:
    """Rows of elements of office files (doc_id, format, content); files of other formats are passed over."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for doc_id, form, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "format", "content"))):
                try:
                    found = READERS[form](data)
                except PackageError as e:
                    found = [row(1, 0, "error", warning=str(e))]
                except Exception as e:  # one broken file must not end the job
                    found = [row(1, 0, "error", warning=f"OFFICE_READ_FAILED: {type(e).__name__}: {e}")]
                ids += [doc_id] * len(found)
                rows += found
            cols = [pa.array(ids, b.schema.field("doc_id").type), *(pa.array([r[f] for r in rows], t) for f, t in FIELDS.items())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *FIELDS])

    chosen = files.where(F.col("format").isin(*READERS)).select("doc_id", "format", "content")
    return chosen.mapInArrow(run, f"doc_id {kind}, {DDL}")


def media(files: DataFrame) -> DataFrame:
    """Media of office files (doc_id, format, content): (doc_id, idx, type, name, mime_type, content); broken files have none."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for doc_id, data in zip(b.column("doc_id"), b.column("content")):
                try:
                    package = Package(data.as_py())
                    names = [n for n in package.names if re.match("(word|xl|ppt)/media/", n)]
                    bodies = [package.zip.read(n) for n in names]
                except Exception:  # its elements say what is wrong with it
                    names, bodies = [], []
                cols = [pa.array([doc_id.as_py()] * len(names), doc_id.type), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "idx", "name", "content"])

    found = files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, idx int, name string, content binary")
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    mime = F.create_map(*(F.lit(x) for pair in (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("bmp", "image/bmp"), ("svg", "image/svg+xml"), ("tiff", "image/tiff"), ("webp", "image/webp")) for x in pair))[ext]
    return found.select("doc_id", "idx", F.lit("image").alias("type"), "name", mime.alias("mime_type"), "content")
