"""Regression checks of document models: volatile fields masked, expectations, summaries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields whose values change from run to run.
VOLATILE = ("document_id", "job_id", "processed_at", "uploaded_at", "duration_ms", "sha256", "asset_id", "path", "hostname", "model_warmup_ms")
MASK = "<normalized>"


def _masked(value, names, inside=None):
    if isinstance(value, list):
        return [_masked(v, names) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if k.endswith("_ms"):
            out[k] = 0
        elif k in ("path", "hostname"):
            out[k] = "<normalized_path>" if k == "path" else "<normalized_host>"
        else:
            out[k] = MASK if k in names else _masked(v, names)
    return out


def normalize(model: Column, ignore: tuple[str, ...] = ()) -> Column:
    """A model's JSON with keys in order and volatile values masked at every depth."""
    names = frozenset(VOLATILE) | frozenset(ignore)

    @F.pandas_udf("string")
    def masked(models: pd.Series) -> pd.Series:
        return models.map(lambda m: None if m is None else json.dumps(_masked(json.loads(m), names), ensure_ascii=False, sort_keys=True))

    return masked(model)


def compare(expected: DataFrame, actual: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """case_id and whether both models (case_id, model) are equal once masked."""
    a, b = expected.select("case_id", normalize(F.col("model"), ignore).alias("want")), actual.select("case_id", normalize(F.col("model"), ignore).alias("got"))
    return a.join(b, "case_id", "full").select("case_id", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("equal"))


def assertions(cases: DataFrame, pages: DataFrame, elements: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """case rows (doc_id and expectations, null where there is none) with the list of those that fail.

    min_pages, min_elements, must_contain_text (array), must_have_element_types (array),
    must_have_chunks, must_have_tables, must_have_ocr, max_errors.
    """
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    wanted = cases.select("doc_id", F.explode("must_contain_text").alias("needle"))
    texts = pages.select("doc_id", "text").unionByName(elements.select("doc_id", "text"))
    # a needle is looked for in its own document only
    seen = wanted.join(texts, "doc_id").where(F.contains("text", F.col("needle"))).select("doc_id", "needle").distinct().groupBy("doc_id").agg(F.collect_set("needle").alias("needles"))
    types = elements.groupBy("doc_id").agg(F.collect_set("type").alias("types"))
    rows = cases
    for df in (count(pages, "n_pages"), count(elements, "n_elements"), count(chunks, "n_chunks"), count(errors, "n_errors"), types, seen):
        rows = rows.join(df, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    none = F.array().cast("array<string>")
    has = lambda t: F.array_contains(F.coalesce("types", none), t)
    tests = {
        "min_pages": n("n_pages") < F.col("min_pages"),
        "min_elements": n("n_elements") < F.col("min_elements"),
        "must_contain_text": F.size(F.array_except(F.coalesce("must_contain_text", none), F.coalesce("needles", none))) > 0,
        "must_have_element_types": F.size(F.array_except(F.transform(F.coalesce("must_have_element_types", none), F.lower), F.coalesce("types", none))) > 0,
        "must_have_chunks": F.col("must_have_chunks") & (n("n_chunks") == 0),
        "must_have_tables": has("table") != F.col("must_have_tables"),
        "must_have_ocr": has("text_ocr") != F.col("must_have_ocr"),
        "max_errors": n("n_errors") > F.col("max_errors"),
    }
    return rows.select("doc_id", F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items()))).alias("failed"))


def summary(results: DataFrame) -> DataFrame:
    bad = F.size("failed") > 0
    return results.agg(F.count("*").alias("total"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"))
