"""Corpus pipeline: quality rules, near-dedup, secret scans, source mixing, SentencePiece encoding."""

from __future__ import annotations

import uuid

from docspark.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece_codec
from docspark.llm.common import delete, read_table, scratch, shared_dir


def quality(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality_rules.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def secrets(spark, docs, sf_dir):
    """Secrets in texts are masked; every document stays."""
    return secret_scan.redact(docs)


def mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each document that the mix holds."""
    return sentencepiece_codec.encode(docs, "doc_id", "lang", "source")


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("secret_scan", secrets), ("mixing", mix), ("sentencepiece", encode)]

#: The isolation forest and the encoder are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each one's rows are written as Parquet and read again, and what led to them is deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
