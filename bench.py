"""Times the headline queries, warm, and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores,
BENCH_QUERIES a comma-separated choice. Each query runs once to warm up and is then timed over a
full materialization. ``plain_python`` is a one-core loop over the same texts for the chunker.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "txt_line_class", "doc_chunks", "chunk_stats_by_lang", "lang_detect", "doc_stats", "dup_ratio_exact", "domain_profile", "legal_summary", "dehyphenate",
    "ocr_dedup", "reading_order_two_col", "header_footer", "ocr_paragraphs", "pdf_page_class", "docx_paginate", "pipe_table_detect", "md_elements", "html_elements",
    "validate_issues", "latency_summary", "counters",
)


def plain_chunks(texts: list[str], most: int = 200) -> int:
    """The packing rules in a straight loop, to compare with."""
    chunks = 0
    for text in texts:
        size = held = 0
        for line in text.split("\n"):
            line = line.rstrip()
            if not line:
                continue
            bare = line.strip()
            n = len(line.encode())
            heading = bare.startswith("#") or (len(bare.encode()) <= 80 and any(c.isupper() for c in bare) and not any(c.islower() for c in bare))
            if held and (heading or (size + n) // 4 + 1 > most):
                chunks += 1
                size = held = 0
            size += n + (1 if held else 0)
            held += 1
        chunks += held > 0
    return chunks


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from docspark.plans.registry import QUERIES

    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docspark-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r[0] for r in docs.select("text").collect()]
    began = time.perf_counter()
    plain_chunks(texts)
    plain = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    rate = round(len(texts) / seconds["doc_chunks"]) if "doc_chunks" in seconds else None
    print(json.dumps({"metric": "headline_queries_warm_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "documents": len(texts), "doc_chunks_documents_per_second": rate, "plain_python_chunks_sec": plain}))
    spark.stop()


if __name__ == "__main__":
    main()
