"""Legal fields by pattern; values stay texts."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of identifiers, dates, amounts and citations, and the roles of parties.
IDENTIFIERS = (
    ("ИНН", r"(?iU)инн\s*[:№]?\s*([0-9]{10,12})", 1),
    ("КПП", r"(?iU)кпп\s*[:№]?\s*([0-9]{9})", 1),
    ("ОГРН", r"(?iU)огрн\s*[:№]?\s*([0-9]{13,15})", 1),
    ("contract_number", r"(?iU)(договор|контракт)\s*(?:№|N|#)\s*([А-ЯA-Za-z0-9\-\/]+)", 2),
)
DATE = r"(?U)\b([0-3]?\d\.[0-1]?\d\.(?:19|20)?\d\d)\b"
AMOUNT = r"(?U)\b([0-9]{1,3}(?:[\s\x{00A0}]?[0-9]{3})*(?:[\.,][0-9]{1,2})?)\s*(руб\.?|р\.|RUB|₽)?\b"
CITATION = r"(?iU)(ст\.?\s*[0-9]+(?:\.[0-9]+)?\s*(?:гк\s*рф|ук\s*рф|коап\s*рф)?)"
ROLES = ("Заказчик", "Исполнитель", "Арендатор", "Арендодатель", "Истец", "Ответчик")


def identifiers(text: Column) -> Column:
    """array of (kind, value), the first of equal ones, by kind and position."""

    def named(kind):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    return F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), named(k)) for k, p, g in IDENTIFIERS)))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(1))


def amounts(text: Column) -> Column:
    """array of (value, currency); whole numbers of under four digits are none."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)).alias("value"), F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(2)).alias("currency"))
    kept = F.filter(pairs, lambda a: ~(a["value"].rlike("^[0-9]*$") & (F.length(a["value"]) < 4)))
    return F.transform(kept, lambda a: F.struct(a["value"].alias("value"), F.nullif(a["currency"], F.lit("")).alias("currency")))


def parties(text: Column, low: Column | None = None) -> Column:
    """Roles that occur in any case; ``low`` is the lower-cased text where it is at hand."""
    low = F.lower(text) if low is None else low
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(r.lower())), F.lit(r)) for r in ROLES)))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def required_present(text: Column) -> Column:
    """Whether a text names a party, a date and an identifier."""
    return (F.size(parties(text)) > 0) & (F.size(dates(text)) > 0) & (F.size(identifiers(text)) > 0)


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all legal fields, document_type, confidence and whether the required ones are present."""
    x = F.coalesce(F.col(text), F.lit(""))
    low = F.col("_low")  # lowered once, in a step before the tests
    has = lambda *words: reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words))
    docs = docs.withColumn("_low", F.lower(x))
    out = docs.withColumns({"identifiers": identifiers(x), "dates": dates(x), "amounts": amounts(x), "parties": parties(x, low), "citations": citations(x)})
    n = F.size("parties") + F.size("dates") + F.size("identifiers") + F.size("amounts")
    return out.withColumns({
        "document_type": F.when(has("договор", "контракт"), "contract").when(has("решение", "суд"), "court_act"),
        "clauses": F.when(has("предмет"), F.array(F.lit("Предмет"))).otherwise(F.array().cast("array<string>")),
        "risks": F.when(has("штраф", "неустойка"), F.array(F.lit("penalty_clause"))).otherwise(F.array().cast("array<string>")),
        "confidence": F.when(n == 0, 0.25).otherwise(F.least(F.lit(0.95), 0.45 + n * 0.07)),
        "required_present": (F.size("parties") > 0) & (F.size("dates") > 0) & (F.size("identifiers") > 0),
    }).drop("_low")
