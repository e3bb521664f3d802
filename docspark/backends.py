"""Model backends: deterministic stand-ins and HTTP services, chosen by availability, called in batches.

A backend takes (doc_id, page_number, image) rows and returns rows of lines or regions. Backends run
inside ``mapInArrow``, so a service is called from executors, once per batch, and a failing one falls
back to the stand-in with the reason kept.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

LINES = "page_number int, pos int, type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, backend string, warning string"
_NAMES = ("page_number", "pos", "type", "text", "x0", "y0", "x1", "y1", "confidence", "backend", "warning")
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), *(pa.float64(),) * 5, pa.string(), pa.string())


class BackendError(RuntimeError):
    """Codes: timeout, http, invalid."""


@dataclass(frozen=True)
class Backend:
    """A stand-in: the same two lines, or one region, for every page."""

    name: str = "mock_ocr"
    kind: str = "ocr"

    def available(self) -> bool:
        return True

    def call(self, pages: list[dict]) -> list[list[dict]]:
        if self.kind == "layout":
            return [[{"type": "text", "text": None, "bbox": (0.0, 0.0, 1000.0, 1400.0), "confidence": 0.4}] for _ in pages]
        return [[{"type": "text_ocr", "text": f"mock line {i}", "bbox": (50.0, 40.0 * i, 600.0, 40.0 * i + 24.0), "confidence": 0.9} for i in (1, 2)] for _ in pages]


@dataclass(frozen=True)
class HttpBackend(Backend):
    """A service with ``/healthz`` and one path per kind that takes and gives JSON."""

    url: str = "http://127.0.0.1:1"
    seconds: float = 30.0
    paths: dict = field(default_factory=lambda: {"ocr": "/v1/ocr", "layout": "/v1/layout", "tables": "/v1/tables", "parse": "/v1/parse"})

    def _open(self, path: str, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=self.seconds) as answer:
                return json.loads(answer.read() or b"{}")
        except TimeoutError as e:
            raise BackendError("timeout") from e
        except urllib.error.URLError as e:
            raise BackendError("timeout" if isinstance(e.reason, TimeoutError) else "http") from e
        except ValueError as e:
            raise BackendError("invalid") from e

    def available(self) -> bool:
        try:
            self._open("/healthz")
            return True
        except BackendError:
            return False

    def call(self, pages: list[dict]) -> list[list[dict]]:
        out = []
        for p in pages:
            got = self._open(self.paths[self.kind], {"page_number": p["page_number"], "image_base64": base64.b64encode(p["image"] or b"").decode()})
            regions = got.get("regions")
            if not isinstance(regions, list) or any(len(r.get("bbox") or ()) != 4 for r in regions):
                raise BackendError("invalid")
            out.append([{"type": r.get("type", "text_ocr"), "text": r.get("text"), "bbox": r["bbox"], "confidence": float(r.get("confidence", 0.8))} for r in regions])
        return out


def choose(primary: Backend | None, fallbacks: list[Backend], is_up: Callable[[Backend], bool] | None = None) -> tuple[Backend | None, list[str]]:
    """(the first available backend, why others were passed over)."""
    is_up, said = is_up or (lambda b: b.available()), []
    for b in [primary, *fallbacks]:
        if b is None:
            continue
        if is_up(b):
            return b, said
        said.append(f"BACKEND_UNAVAILABLE: {b.name}")
    return None, said


def of(config: dict, kind: str) -> tuple[Backend | None, Backend | None]:
    """(backend, fallback) of a kind by configuration: services under ``config[kind]`` ({"url", "seconds", "name"} or a
    list of them), the first that is up; ``mock_<kind>`` allows the stand-in. Without either there is none."""
    given = config.get(kind) or []
    services = [HttpBackend(g.get("name", kind), kind, g["url"], float(g.get("seconds", 30))) for g in (given if isinstance(given, list) else [given])]
    spare = Backend(f"mock_{kind}", kind) if config.get(f"mock_{kind}") else None
    if not services:
        return spare, None
    found, _ = choose(services[0], [*services[1:], *([spare] if spare else [])])
    return found, spare


def apply(pages: DataFrame, backend: Backend, fallback: Backend | None = None) -> DataFrame:
    """Lines or regions of pages (doc_id, page_number, image)."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            given, ids, rows = b.select(["doc_id", "page_number", "image"]).to_pylist(), [], []
            for page in given:
                used, warning = backend, None
                try:
                    found = backend.call([page])[0]
                except BackendError as e:
                    warning = f"BACKEND_FALLBACK: {backend.name}: {e}"
                    used = fallback
                    found = fallback.call([page])[0] if fallback else []
                for i, r in enumerate(found):
                    ids.append(page["doc_id"])
                    rows.append((page["page_number"], i, r["type"], r["text"], *map(float, r["bbox"]), r["confidence"], used.name, warning))
            cols = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=["doc_id", *_NAMES])

    return pages.select("doc_id", "page_number", "image").mapInArrow(run, f"doc_id {kind}, {LINES}")
