"""One explicit configuration: JSON with comments and trailing commas, layered, the later layer winning."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

_TOKENS = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*[}\]])', re.S)


def loads(text: str):
    """JSON whose comments and trailing commas are passed over; texts stay as they are."""
    return json.loads(_TOKENS.sub(lambda m: m[1] or "", text))


def load(path: str | Path) -> dict:
    return loads(Path(path).read_text(encoding="utf-8"))


def get(tree, *keys, default=None):
    """The value at a path of keys, or the default where a key is missing."""
    for k in keys:
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def merged(*layers: dict) -> dict:
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass(frozen=True)
class Config:
    default_language: str = "ru"
    locale: str = "ru"
    max_tokens: int = 1000
    native_text_min_chars: int = 20
    min_text_confidence: float = 0.5
    drop_low_confidence: bool = False
    dedup_iou: float = 0.5
    dedup_similarity: float = 0.8
    prefer_native_text: bool = True
    max_rows_per_table: int = 200
    table_chunk_rows: int = 20
    docx_lines_per_page: int = 80
    reading_order: str = "layout"
    column_gap: float = 0.08
    exclude_headers_from_chunks: bool = True
    slow_path_threshold: float = 0.65
    allow_slow_path: bool = True
    max_file_size_mb: int = 512
    max_assets_mb: int = 2048
    language_min_chars: int = 40
    backends: dict = field(default_factory=lambda: {"mock_ocr": False, "heuristic_layout": True})

    @classmethod
    def of(cls, *layers: dict) -> Config:
        """From trees of settings; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in merged(*layers).items() if k in known})

    def override(self, **changes) -> Config:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
