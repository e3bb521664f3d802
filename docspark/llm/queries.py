"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprints, mixing, near_dedup, quality_crf, quality_rules, secret_scan, sentencepiece_codec, token_counts, toxicity, url_filter
from .common import crc_remainder, read_table


def op1_quality_rules(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    judged = quality_rules.judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"))


def held_out(modulus: int, remainder: int):
    """Whether labels of a row are kept from learning; a row without doc_id has no label, and isn't."""
    return F.coalesce(crc_remainder("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op3_toxicity(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels, learn_from=crc_remainder("doc_id", 3) != 1)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark, sf_dir):
    return mixing.word_budget(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(read_table(spark, sf_dir, "documents"))


def op7_quality_crf(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality_crf.score(docs, labels, learn_from=crc_remainder("doc_id", 4) != 2)
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.group(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_secret_scan(spark, sf_dir):
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return token_counts.report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_toxicity,
        op4_mixing,
        op5_url_filter,
        op6_fingerprints,
        op7_quality_crf,
        op8_near_dedup,
        op9_secret_scan,
        op10_token_counts,
    )
}
ORACLES = {"op4_mixing": mixing.ORACLE, "op5_url_filter": url_filter.ORACLE, "op8_near_dedup": near_dedup.ORACLE}
