"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its weighted share of all sizes, held to ``most`` times its own size;
the excess is shared again by weight until no target is above its limit (a water level over
the sources). Each document of a source expects target / source size copies. Documents are
laid out in blocks, the expected copies are summed in that order, one random offset per
source is added, and a document is emitted once for each integer boundary that its interval
crosses. Sums are whole multiples of 2^-20, so that equal runs agree and no document gets
more than ``most`` copies. Documents lie in order of size class, so the words taken come near the target.

Ranks come from two levels: counts of blocks, summed within a source, and row numbers within
a block. Blocks are cut so that one holds about ``block_rows`` rows, and at least ``blocks`` are made of all
rows, so a source with a third of the rows is spread over many tasks. Only narrow rows are ranked; texts are
joined to their copies by a number that each written row has. The source table has one row per distinct source name.

Defined results: null text has size 0; sources of size 0 have target 0 and take nothing; a
null source is a source of its own and comes last; rows that tie or repeat get
consecutive places and each its own copies; an empty table gives an empty result. Columns of
the same names as the operator's own are carried under other names inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Blocks that all rows together are cut into at least, about, and rows of a block beyond that.
BLOCKS = 1024
BLOCK_ROWS = 65536
ONE = 1 << 20


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text) -> F.Column:
    """A fixed pseudo-random whole number below 2^32, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def size_class(size) -> F.Column:
    """Sizes that share their first two digits and number of digits."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, ...) with each source's target.

    With limits sorted by limit / weight, the first j sources stay at their limit and the rest
    share what is left by weight, where j is the first for which the next limit isn't reached.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = sizes.withColumn("_i", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    every = every.withColumn("_w", w).withColumn("_limit", F.col("source_size") * most)
    total = F.sum("source_size").over(W.partitionBy())
    by_level = W.orderBy(F.col("_limit") / F.col("_w"), "_i")
    every = every.withColumn("_left", total - F.coalesce(F.sum("_limit").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    every = every.withColumn("_level", F.col("_left") / F.sum("_w").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # the first source that isn't cut off at its limit sets the level for all after it
    holds = F.when(F.col("_limit") >= F.col("_level") * F.col("_w"), F.col("_level"))
    level = F.first(holds, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.coalesce(level * F.col("_w"), F.col("_limit").cast("double"))
    return every.withColumn("target", F.least(F.col("_limit").cast("double"), share)).drop("_i", "_w", "_limit", "_left", "_level")


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS, seed: str = "mix") -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with source_size, target, copies and taken."""
    rows = rows.withColumn("_class", size_class(F.col("size")))
    classes = materialize(rows.groupBy("source", "_class").agg(F.count("*").alias("_n"), F.sum("size").alias("_s")))
    sizes = targets(classes.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, most)
    # one row per source and class of about 200; each is cut into blocks by its share of all rows
    every = classes.agg(F.sum("_n")).first()[0] or 1
    blocks = max(blocks, every // block_rows)
    spread = classes.select("source", "_class", F.ceil(F.col("_n") * blocks / F.lit(every)).alias("_cuts"))
    spread = spread.withColumnRenamed("source", "_source").withColumnRenamed("_class", "_cls")
    block = F.pmod(_number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("_cuts"))
    cut = rows.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_cls")), "left").withColumn("_block", block).drop("_source", "_cls", "_cuts")
    heights = cut.groupBy("source", "_class", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy(F.desc("_class"), "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heights = heights.withColumn("_before", before).join(sizes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    heights = heights.select(F.col("source").alias("_source"), F.col("_class").alias("_cls"), F.col("_block").alias("_blk"), "_before", "source_size", "target")
    ranked = cut.withColumn("_row", F.row_number().over(W.partitionBy("source", "_class", "_block").orderBy("size", "doc_id")))
    placed = ranked.join(heights, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_cls")) & (F.col("_block") == F.col("_blk")))
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    offset = F.pmod(_number(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), F.lit(ONE))
    until = F.col("_before") + F.col("_row")
    crossed = F.floor((until * expected + offset) / F.lit(ONE)) - F.floor(((until - 1) * expected + offset) / F.lit(ONE))
    placed = placed.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return placed.drop("_class", "_block", "_row", "_source", "_cls", "_blk", "_before")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, each as many times as it is taken, with their own columns."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    pick = {n: F.col(inner[names.index(n)]) for n in ("doc_id", "source", "text")}
    # written once, rows keep their number however often they are read
    own = materialize(docs.toDF(*inner).withColumn("_size", word_count(pick["text"])).withColumn("_number", F.monotonically_increasing_id()))
    rows = own.select("_number", pick["doc_id"].alias("doc_id"), pick["source"].alias("source"), F.col("_size").alias("size"))
    copies = plan(rows, **how).where("copies > 0").select("_number", "copies")
    taken = own.join(copies, "_number").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*inner).toDF(*names)


def word_budget(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row per document."""
    # the narrow rows are written once, so that texts are read and counted once
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return plan(rows, **how).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (SELECT *, length(size::VARCHAR) * 100 + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT AS cls FROM rows),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i, source_size * {MOST} AS lim FROM sized),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY lim / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (
  SELECT source, source_size, least(lim::DOUBLE, coalesce(first_value(CASE WHEN lim >= level * w THEN level END IGNORE NULLS) OVER (ORDER BY lim / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, lim::DOUBLE)) AS target FROM levels),
spread AS (SELECT source, cls, ceil(count(*) * greatest({BLOCKS}, (SELECT count(*) FROM rows) // {BLOCK_ROWS}) / (SELECT count(*) FROM rows)::DOUBLE)::BIGINT AS cuts FROM classed GROUP BY source, cls),
cut AS (
  SELECT c.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::BIGINT % cuts AS block
  FROM classed c JOIN spread s ON c.source IS NOT DISTINCT FROM s.source AND c.cls = s.cls),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls DESC, block, size, doc_id) AS k FROM cut),
placed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, k,
         CASE WHEN g.source_size > 0 THEN round(g.target / g.source_size * {ONE})::BIGINT ELSE 0 END AS e,
         ('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8))::UBIGINT::BIGINT % {ONE} AS u
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (((k * e + u) // {ONE}) - (((k - 1) * e + u) // {ONE})) * size AS taken FROM placed
"""
