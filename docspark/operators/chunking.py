"""Semantic chunks: elements packed in order up to a token limit, cut at headings and tables.

The fold runs inside each document's row over (byte length, kind) pairs and yields only where
chunks start; texts are joined afterwards from slices. No row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Estimated tokens of a chunk at most.
MAX_TOKENS = 1000

_FOLD = """aggregate(elements,
  named_struct('size', 0L, 'held', 0, 'i', 0, 'title', cast(-1 as int), 'alone', false, 'starts', cast(array() as array<struct<at:int,title:int>>)),
  (s, e) -> named_struct(
    'size', CASE WHEN {new} THEN octet_length(e.text) + 0L WHEN e.text = '' THEN s.size ELSE s.size + octet_length(e.text) + if(s.size > 0, 1, 0) END,
    'held', if({new}, 1, s.held + 1),
    'i', s.i + 1,
    'title', if(e.type = 'heading', s.i, s.title),
    'alone', e.type = 'table',
    'starts', if({new}, concat(s.starts, array(named_struct('at', s.i, 'title', if(e.type = 'heading', s.i, if(e.type = 'table', -2, s.title))))), s.starts)),
  s -> s.starts)"""
_NEW = "(s.held = 0 OR s.alone OR e.type IN ('heading', 'table') OR (s.size + octet_length(e.text)) div 4 + 1 > {most})"


def chunk(rows: DataFrame, max_tokens: int = MAX_TOKENS, positions: bool = False) -> DataFrame:
    """Chunks of ``rows`` (doc_id, elements, ...): one row each, in document order; with ``positions`` of all their elements if wanted.

    ``elements`` is an array of (pos, type, text, markdown); a table stands alone and leaves the
    section's title as it was.
    """
    fold = _FOLD.format(new=_NEW.format(most=int(max_tokens)))
    cut = rows.withColumn("_starts", F.expr(fold))
    cut = cut.withColumn(
        "_chunks",
        F.expr(
            """transform(_starts, (s, k) -> named_struct('n', k + 1, 'title_at', s.title,
               'part', slice(elements, s.at + 1, coalesce(get(_starts, k + 1).at, size(elements)) - s.at)))"""
        ),
    )
    title = F.expr("CASE WHEN c.title_at = -2 THEN 'Таблица' WHEN c.title_at >= 0 THEN get(elements, c.title_at).text END")
    every = [c for c in rows.columns if c != "elements"]
    # an outer explode: the plain one would infer a filter that repeats the whole fold below it
    flat = cut.select(*every, "elements", F.explode_outer("_chunks").alias("c")).where("c IS NOT NULL").select(*every, "c.n", title.alias("title"), "c.part")
    texts, marks = (F.array_join(F.filter(F.transform("part", lambda x: x[f]), lambda x: x != ""), sep) for f, sep in (("text", "\n"), ("markdown", "\n\n")))
    table = F.col("part")[0]["type"] == "table"
    flat = flat.select(
        *every, "n", F.concat(F.when(table, "chunk_table_").otherwise("chunk_"), "n").alias("chunk_id"), "title", texts.alias("text"), marks.alias("markdown"),
        F.size("part").alias("n_elements"), F.col("part")[0]["pos"].alias("first_pos"), F.element_at("part", -1)["pos"].alias("last_pos"), table.alias("is_table"),
        *([F.transform("part", lambda x: x["pos"]).alias("positions")] if positions else []),
    )
    return flat.withColumn("token_estimate", T.token_estimate(F.col("text")))


def flags(chunks: DataFrame) -> DataFrame:
    """``chunks`` with chunk_type and what they contain."""
    text, md, table = F.col("text"), F.col("markdown"), F.col("is_table")
    fence, pipe = F.lit("```"), F.lit("|")
    kind = F.when(table | F.contains(text, pipe), "table").when(F.contains(text, fence), "code").otherwise("section")
    low = T.ascii_lower(text)
    has = lambda c, s: F.contains(c, F.lit(s))
    return chunks.select(
        "*",
        kind.alias("chunk_type"),
        (table | (kind == "table") | F.contains(md, pipe)).alias("contains_table"),
        F.when(table, has(text, "=") | has(text, "SUM(")).otherwise(has(md, "$$") | (has(text, "=") & has(text, "^"))).alias("contains_formula"),
        (~table & has(md, "![")).alias("contains_image"),
        (~table & has(low, "invoice") & has(low, "total")).alias("contains_ocr"),
        (~table & ((kind == "code") | F.contains(md, fence))).alias("contains_code"),
    )


def gather(elements: DataFrame, *keys: str) -> DataFrame:
    """Rows of elements to one row per document with their ordered array: one shuffle by document."""
    row = F.struct("pos", "type", "text", "markdown")
    return elements.groupBy(*(keys or ("doc_id",))).agg(F.array_sort(F.collect_list(row)).alias("elements"))
