"""Messages of diagnostics in the reader's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Russian texts by code; other languages show the message given.
RUSSIAN = {
    "LOW_OCR_CONFIDENCE": "Низкая уверенность OCR-распознавания.",
    "OCR_BACKEND_FALLBACK_TO_MOCK": "ONNX OCR недоступен; используется mock OCR.",
    "TABLE_PLACEHOLDER_CREATED": "На странице обнаружена таблица, но структура таблицы пока не распознана.",
    "FORMULA_PLACEHOLDER_CREATED": "Формула обнаружена, но распознавание пока не выполнено.",
    "LAYOUT_DETECTION_FAILED": "Не удалось выполнить layout detection для страницы.",
    "SCANNED_TABLE_DETECTION_FAILED": "Не удалось обнаружить таблицы на скане.",
    "FORMULA_DETECTION_FAILED": "Не удалось обнаружить формулы на странице.",
    "FORMULA_RECOGNITION_FAILED": "Не удалось распознать формулу для обнаруженного региона.",
    "DEBUG_ARTIFACT_WRITE_FAILED": "Не удалось сохранить debug-артефакт layout/reading order.",
}


def localized(code: Column, fallback: Column, locale: str = "ru") -> Column:
    if locale != "ru":
        return fallback
    return F.coalesce(F.create_map(*(F.lit(x) for pair in RUSSIAN.items() for x in pair))[code], fallback)
