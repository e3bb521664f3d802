"""Markdown: elements by line rules and fences, display formulas, the first pipe table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def elements(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, order (from 1), type, tag, text, markdown. Fences pair up by a running count; an open one at the end is dropped."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")))).alias("pos", "line"))
    rows = rows.withColumn("line", T.trim_end(F.col("line"))).withColumn("fence", F.startswith("line", F.lit("```")))
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("block", before)
    inside = F.col("block") % 2 == 1
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    code = rows.where(inside).groupBy("doc_id", "block").agg(F.max("pos").alias("pos"), F.max(F.col("fence").cast("int")).alias("closed"), body.alias("text")).where("closed = 1")
    code = code.select("doc_id", "pos", F.lit("code").alias("type"), F.lit("code").alias("tag"), "text", F.concat(F.lit("```\n"), "text", F.lit("\n```")).alias("markdown"))
    line = F.col("line")
    kind = F.when(F.startswith(line, F.lit("#")), "heading").when(line.rlike("^[-*] "), "list_item").when(F.startswith(line, F.lit(">")), "blockquote").otherwise("paragraph")
    tag = F.create_map(*map(F.lit, ("heading", "h", "list_item", "li", "blockquote", "blockquote", "paragraph", "p")))
    bare = F.when(kind == "heading", T.trim(F.regexp_replace(line, "^#+", ""))).when(kind == "list_item", T.trim(F.substring(line, 3, 1 << 30))).when(kind == "blockquote", T.trim(F.regexp_replace(line, "^>+", ""))).otherwise(line)
    plain = rows.where(~inside & ~F.col("fence") & (line != "")).select("doc_id", "pos", kind.alias("type"), tag[kind].alias("tag"), bare.alias("text"), line.alias("markdown"))
    every = plain.unionByName(code).withColumn("order", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    return every.select("doc_id", "order", "type", "tag", "text", "markdown")


_FORMULAS = r"""aggregate(_lines, named_struct('open', false, 'held', cast(array() as array<string>), 'out', cast(array() as array<string>)),
  (s, raw) -> transform(array(regexp_replace(raw, r'^SPACE+|SPACE+$', '')), l -> CASE
    WHEN startswith(l, '$$') AND s.open THEN named_struct('open', false, 'held', cast(array() as array<string>),
      'out', concat(s.out, filter(array(regexp_replace(array_join(s.held, '\n'), r'^SPACE+|SPACE+$', '')), x -> x != '')))
    WHEN startswith(l, '$$') AND length(l) > 4 AND endswith(l, '$$') AND regexp_replace(l, r'^(\$\$)+SPACE*|SPACE*(\$\$)+$', '') != '' THEN named_struct('open', false, 'held', s.held,
      'out', concat(s.out, array(regexp_replace(l, r'^(\$\$)+SPACE*|SPACE*(\$\$)+$', ''))))
    WHEN startswith(l, '$$') THEN named_struct('open', true, 'held', cast(array() as array<string>), 'out', s.out)
    WHEN s.open THEN named_struct('open', true, 'held', concat(s.held, array(l)), 'out', s.out)
    WHEN l rlike r'^\\\[.*\\\]$' THEN named_struct('open', false, 'held', s.held, 'out', concat(s.out, filter(array(regexp_replace(l, r'^(\\\[)+SPACE*|SPACE*(\\\])+$', '')), x -> x != '')))
    ELSE s END)[0],
  s -> s.out)""".replace("SPACE", T.SPACE)


def formulas(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n (from 1), latex of display formulas: a fold over the lines of texts that hold a mark."""
    marked = docs.where(F.contains(text, F.lit("$$")) | F.contains(text, F.lit("\\["))).withColumn("_lines", T.lines(F.col(text)))
    found = marked.select("doc_id", F.posexplode_outer(F.expr(_FORMULAS)).alias("i", "latex")).where("latex IS NOT NULL")
    return found.select("doc_id", (F.col("i") + 1).alias("n"), "latex")
