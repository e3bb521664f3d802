"""Latency summaries by nearest rank, counters, latest records, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency(samples: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """count, min, max, mean and nearest-rank percentiles per key, exactly.

    Values are counted, then placed in ``buckets`` intervals of their key's range; running totals
    over intervals find those with the wanted ranks, and only their values are ranked. No key's
    values come together in one task.
    """
    rows = samples.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf")))
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    sums = rows.groupBy(key).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    span = F.col("max") - F.col("min")
    place = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("min")) / span * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = counts.join(sums.select(key, "min", "max", "count"), key).withColumn("bucket", place)
    totals = placed.groupBy(key, "bucket", "count").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(key).orderBy("bucket"))
    totals = totals.withColumn("before", upto - F.col("n"))
    # ranks count from 0; .5 goes up
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.floor((F.col("count") - 1) * q + 0.5).alias("rank")) for name, q in QUANTILES.items()))
    hit = totals.select(key, "bucket", "before", "n", F.explode(wanted).alias("w")).where("w.rank >= before AND w.rank < before + n").select(key, "bucket", "before", "w.name", "w.rank")
    inside = placed.select(key, "bucket", value, "n").join(hit.select(key, "bucket").distinct(), [key, "bucket"], "left_semi")
    inside = inside.withColumn("until", F.sum("n").over(W.partitionBy(key, "bucket").orderBy(value)))
    ranked = inside.join(hit, [key, "bucket"]).where("rank >= before + until - n AND rank < before + until")
    found = ranked.groupBy(key).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in QUANTILES))
    return sums.join(found, key)


def counters(events: DataFrame, name: str, value: str) -> DataFrame:
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count"), F.sum(value).alias("sum"))


def prometheus(counts: DataFrame) -> DataFrame:
    """One line of text per counter: name_sum and name_count."""
    safe = F.regexp_replace("name", "[^A-Za-z0-9_]", "_")
    lines = F.array(F.concat(safe, F.lit("_sum "), F.col("sum").cast("string")), F.concat(safe, F.lit("_count "), F.col("count").cast("string")))
    return counts.select(F.explode(lines).alias("line"))


def throughput(runs: DataFrame) -> DataFrame:
    """documents and pages a second of runs (documents, pages, seconds); at least a millisecond counts."""
    s = F.greatest(F.col("seconds"), F.lit(0.001))
    return runs.withColumn("documents_per_second", F.col("documents") / s).withColumn("pages_per_second", F.col("pages") / s)


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The record of each key with the greatest ``order``: partial maxima, one shuffle."""
    rest = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.hash(*rest))).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counting repeats."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))
