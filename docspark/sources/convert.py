"""Legacy formats through converters: target by target, converter by converter, the first that succeeds."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

# Which converters make what from what.
SUPPORTS = {
    "libreoffice": {"doc": ("docx", "pdf"), "rtf": ("docx", "pdf")},
    "pandoc": {"rtf": ("docx", "html", "txt")},
}
COMMANDS = {
    "libreoffice": lambda exe, src, out, target: [exe, "--headless", "--convert-to", target, "--outdir", out, src],
    "pandoc": lambda exe, src, out, target: [exe, src, "-o", f"{out}/{Path(src).stem}.{target}"],
}
PROGRAMS = {"libreoffice": ("soffice", "libreoffice"), "pandoc": ("pandoc",)}
TARGETS = ("docx", "html", "pdf", "txt")


def attempts(form: str, targets=TARGETS):
    """(target, converter) in the order in which they are tried."""
    return [(t, name) for t in targets for name, table in SUPPORTS.items() if t in table.get(form, ())]


def convert(data: bytes, form: str, seconds: int = 120, targets=TARGETS) -> tuple[str | None, bytes | None, list[str]]:
    """(target, content, diagnostics)."""
    said = []
    for target, name in attempts(form, targets):
        exe = next((p for p in map(shutil.which, PROGRAMS[name]) if p), None)
        if exe is None:
            said.append(f"CONVERTER_UNAVAILABLE: {name}")
            continue
        with tempfile.TemporaryDirectory() as box:
            src = Path(box, f"input.{form}")
            src.write_bytes(data)
            try:
                done = subprocess.run(COMMANDS[name](exe, str(src), box, target), capture_output=True, timeout=seconds, cwd=box)
            except subprocess.TimeoutExpired:
                said.append(f"CONVERTER_TIMEOUT: {name}")
                continue
            made = Path(box, f"input.{target}")
            if done.returncode == 0 and made.exists():
                return target, made.read_bytes(), said
            said.append(f"CONVERTER_FAILED: {name}")
    return None, None, said


def run(files: DataFrame, **limits) -> DataFrame:
    """(doc_id, format, content, status, diagnostics) of files (doc_id, format, content): each conversion within its task."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            rows = []
            for doc_id, form, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "format", "content"))):
                target, made, said = convert(data or b"", form, **limits)
                rows.append((doc_id, target, made, "ok" if target else "failed", said))
            cols = list(zip(*rows)) or [()] * 5
            types = (b.schema.field("doc_id").type, pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "format", "content", "status", "diagnostics"])

    return files.select("doc_id", "format", "content").mapInArrow(work, f"doc_id {kind}, format string, content binary, status string, diagnostics array<string>")
