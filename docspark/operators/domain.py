"""Domain detection, model routing and the slow-path decision, as expressions over a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a domain.
LEGAL = [
    "договор", "соглашение", "стороны", "заказчик", "исполнитель", "арендатор", "арендодатель", "истец", "ответчик", "суд",
    "решение", "постановление", "инн", "кпп", "огрн", "неустойка", "штраф", "обязательство", "реквизиты",
]
FICTION = ["глава", "роман", "рассказ", "стихотворение", "эпиграф", "диалог", "часть первая"]
HISTORICAL = ["ѣ", "і", "ѳ", "ѵ", "дореформенная орфография", "старый скан"]
SCIENTIFIC = ["формула", "теорема", "лемма", "уравнение", "доказательство", "рисунок", "таблица", "литература", "doi"]
PROFILES = {"legal": "legal_fast", "fiction": "fiction_modern", "historical_book": "fiction_historical", "scientific": "scientific", "mixed_enterprise": "mixed_enterprise", "unknown": "mixed_enterprise"}


def hits(text: Column, markers) -> Column:
    """How many of the markers occur in the lower-cased text."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def confidence(n: Column, base: float) -> Column:
    return F.least(F.lit(0.95), F.lit(base) + F.least(F.lit(0.28), n * 0.08))


def detect(rows: DataFrame, text: str = "text", mixed: Column | None = None) -> DataFrame:
    """``rows`` with domain, domain_hits and domain_confidence; ``mixed`` marks tables, images and formulas together."""
    low = F.col("_low")  # lowered once, in a step before the tests
    every = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_h", F.struct(hits(low, LEGAL).alias("l"), hits(low, FICTION).alias("f"), hits(low, HISTORICAL).alias("h"), hits(low, SCIENTIFIC).alias("s")))
    legal, fiction, old, science = (F.col(f"_h.{k}") for k in "lfhs")
    kinds = [
        (old > 0, "historical_book", old, 0.7),
        ((legal > 0) & (legal >= fiction) & (legal >= science), "legal", legal, 0.65),
        ((science > 0) & (science >= fiction), "scientific", science, 0.62),
        (fiction > 0, "fiction", fiction, 0.6),
    ]
    mixed = F.lit(False) if mixed is None else mixed
    name, count, sure = F.lit("unknown"), F.lit(0), F.lit(0.3)
    name, sure = F.when(mixed, "mixed_enterprise").otherwise(name), F.when(mixed, 0.72).otherwise(sure)
    for test, kind, n, base in reversed(kinds):
        name, count, sure = F.when(test, kind).otherwise(name), F.when(test, n).otherwise(count), F.when(test, confidence(n, base)).otherwise(sure)
    return every.withColumn("domain", name).withColumn("domain_hits", count).withColumn("domain_confidence", sure).drop("_h", "_low")


def parse_override(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*PROFILES), low)


def profile(domain: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PROFILES.items() for x in pair))
    return table[domain]


def first_available(backends: dict[str, bool], primary: Column, fallbacks: Column) -> Column:
    """The primary backend if it is available, else the first fallback that is, else null."""
    up = F.array(*(F.lit(b) for b, on in backends.items() if on)) if any(backends.values()) else F.array().cast("array<string>")
    return F.get(F.filter(F.concat(F.array(primary), fallbacks), lambda b: F.array_contains(up, b)), F.lit(0))


def slow_path(rows: DataFrame, threshold: float = 0.65, enabled: bool = True, forced: bool = False) -> DataFrame:
    """``rows`` (min_confidence, placeholder_tables, placeholder_formulas, profile, legal_missing) with reasons and should_run."""
    reason = lambda test, code: F.when(test, F.lit(code))
    found = F.array_compact(
        F.array(
            reason(F.col("min_confidence") < threshold, "low_confidence"),
            reason(F.col("placeholder_tables"), "placeholder_tables"),
            reason(F.col("placeholder_formulas"), "placeholder_formulas"),
            reason(F.col("profile") == "legal_high_accuracy", "high_accuracy_profile"),
            reason(F.startswith("profile", F.lit("legal")) & F.col("legal_missing"), "legal_fields_missing"),
            reason(F.lit(forced), "forced"),
        )
    )
    found = found if enabled else F.array().cast("array<string>")
    return rows.withColumn("reasons", found).withColumn("should_run", F.size("reasons") > 0)
