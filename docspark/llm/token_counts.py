"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Documents are counted by their number of tokens; the histogram has a row per distinct
length. For each length n as a context limit: documents and tokens at or above it, documents
below or at it as a share (quantiles), and the tokens left when every document is cut to n.

Suffix sums run in two levels: within blocks of 1,024 lengths and over the blocks, so no
task holds more than a block or the list of blocks.

Defined results: null and empty texts have length 0; special-token strings are ordinary
text; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, process_cache

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def lengths(docs: DataFrame, *keep: str, rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns and n_tokens, a row per document."""
    # the vocabulary file: its size doesn't depend on the corpus
    ranks = docs.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        encode = process_cache(("tiktoken", hash(ranks.value), pattern), lambda: _encoding(ranks.value, pattern)).encode_ordinary
        for b in batches:
            counts = pa.array([len(encode(t.as_py() or "")) for t in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), counts], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ddl + "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """n_tokens and docs: how many documents have that length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, block: int = 1024) -> DataFrame:
    """The histogram with, for each length, docs_from, tokens_from, docs_all, tokens_all, share_within, tokens_cut."""
    rows = hist.withColumn("_b", F.floor(F.col("n_tokens") / block))
    sums = rows.groupBy("_b").agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("_t"))
    after = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    sums = sums.select("_b", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c + "_after") for c in ("_d", "_t")), F.sum("_d").over(every).alias("docs_all"), F.sum("_t").over(every).alias("tokens_all"))
    inside = W.partitionBy("_b").orderBy(F.desc("n_tokens"))
    rows = rows.withColumn("_di", F.sum("docs").over(inside)).withColumn("_ti", F.sum(F.col("docs") * F.col("n_tokens")).over(inside)).join(sums, "_b")
    docs_from, tokens_from = F.col("_di") + F.col("_d_after"), F.col("_ti") + F.col("_t_after")
    return rows.select(
        "n_tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "docs_all", "tokens_all",
        ((F.col("docs_all") - docs_from + F.col("docs")) / F.col("docs_all")).alias("share_within"),
        (F.col("tokens_all") - tokens_from + docs_from * F.col("n_tokens")).alias("tokens_cut"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents stays within."""
    return sums.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def tokens_within(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when documents are cut to ``limit``, which need not be a length that occurs."""
    above = F.col("n_tokens") >= limit
    most = lambda c, test=True: F.coalesce(F.max(F.when(F.lit(test) if test is True else test, F.col(c))), F.lit(0))
    return sums.agg((most("tokens_all") - most("tokens_from", above) + most("docs_from", above) * limit).alias("tokens"))


def report(docs: DataFrame, block: int = 1024, **tokenizer) -> DataFrame:
    # the histogram is read twice; written once, it lets texts be encoded once. Dealt by block, it takes a file for
    # each block at most, not for each shuffle partition: for every file the executor starts processes (chmod)
    hist = histogram(lengths(docs, **tokenizer)).repartition(F.floor(F.col("n_tokens") / block))
    return suffix_sums(materialize(hist), block)
