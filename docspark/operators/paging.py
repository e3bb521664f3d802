"""Synthetic pages, list groups and sheet ranges: ordered folds and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def estimated_lines(text: Column) -> Column:
    return F.greatest(F.size(T.lines(text)), F.floor(F.length(text) / 80).cast("int") + 1)


_FOLD = """aggregate(elements, named_struct('used', 0, 'page', 1, 'held', 0, 'out', cast(array() as array<int>)),
  (s, e) -> CASE WHEN s.held > 0 AND s.used + greatest(e.need, 1) > {limit}
    THEN named_struct('used', greatest(e.need, 1), 'page', s.page + 1, 'held', 1, 'out', concat(s.out, array(s.page + 1)))
    ELSE named_struct('used', s.used + greatest(e.need, 1), 'page', s.page, 'held', s.held + 1, 'out', concat(s.out, array(s.page))) END,
  s -> s.out)"""


def paginate(rows: DataFrame, line_limit: int = 80) -> DataFrame:
    """``rows`` (doc_id, elements with ``need`` lines each) with ``pages``: the page of each element; a fold within the row."""
    return rows.withColumn("pages", F.expr(_FOLD.format(limit=max(20, int(line_limit)))))


def with_pages(elements: DataFrame, line_limit: int = 80) -> DataFrame:
    """``elements`` (doc_id, pos, text, ...) with synthetic page numbers; the fold gets positions and line counts only."""
    need = F.struct("pos", estimated_lines(F.coalesce("text", F.lit(""))).alias("need"))
    folded = paginate(elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(need)).alias("elements")), line_limit)
    placed = folded.select("doc_id", F.explode_outer(F.arrays_zip(F.col("elements.pos").alias("pos"), F.col("pages").alias("page"))).alias("z")).select("doc_id", "z.pos", F.col("z.page").alias("_page"))
    return elements.drop("page_number").join(placed, ["doc_id", "pos"]).withColumnRenamed("_page", "page_number")


def islands(rows: DataFrame, key: Column, *by: str, order: str = "pos") -> DataFrame:
    """``rows`` with ``island``: runs of consecutive rows of one non-null key; other rows go."""
    w = W.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_k", key)
    new = F.col("_k").isNotNull() & ~F.coalesce(F.lag("_k").over(w) == F.col("_k"), F.lit(False))
    return marked.withColumn("_n", new.cast("int")).withColumn("island", F.sum("_n").over(w)).where("_k IS NOT NULL").drop("_k", "_n")


def list_kind(line: Column) -> Column:
    bare = T.trim(line)
    return F.when(bare.rlike(r"^[0-9]+[.)]"), "ordered").when(bare.rlike(r"^[-*] "), "unordered")


def list_groups(lines: DataFrame) -> DataFrame:
    """(doc_id, island, list_type, first_pos, items) of consecutive items of one kind."""
    rows = islands(lines.withColumn("list_type", list_kind(F.col("line"))), F.col("list_type"), "doc_id")
    return rows.groupBy("doc_id", "island", "list_type").agg(F.min("pos").alias("first_pos"), F.count("*").alias("items"))


def sheet_ranges(rows: DataFrame) -> DataFrame:
    """(sheet, start_row, end_row, columns) of maximal runs of non-blank rows; all rows if every one is blank."""
    width = F.max(F.size("cells")).over(W.partitionBy("sheet"))
    filled = F.exists("cells", lambda c: ~T.is_blank(c))
    marked = rows.withColumn("columns", width).withColumn("filled", filled)
    some = F.max(F.col("filled").cast("int")).over(W.partitionBy("sheet"))
    marked = marked.withColumn("_some", some).where("columns > 0")
    runs = islands(marked, F.when(F.col("filled") | (F.col("_some") == 0), F.lit(1)), "sheet", order="row")
    return runs.groupBy("sheet", "island").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.max("columns").alias("columns")).drop("island")


def table_segments(ranges: DataFrame, most: int = 200) -> DataFrame:
    """Ranges cut into pieces of at most ``most`` rows."""
    starts = F.explode(F.sequence(F.col("start_row"), F.col("end_row"), F.lit(most)))
    return ranges.withColumn("segment_start", starts).withColumn("segment_end", F.least(F.col("segment_start") + most - 1, F.col("end_row")))


def a1(row: Column, column: Column) -> Column:
    """Cell name of zero-based row and column, for up to 18,278 columns."""
    c = column.cast("int")
    first, second = F.floor((c - 702) / 676).cast("int"), F.floor((c - 26) / 26).cast("int")
    letter = lambda n: F.chr(n + 65)
    three = F.concat(letter(first), letter(F.floor(F.pmod(c - 702, F.lit(676)) / 26).cast("int")), letter(F.pmod(c - 702, F.lit(26))))
    name = F.when(c < 26, letter(c)).when(c < 702, F.concat(letter(second), letter(F.pmod(c, F.lit(26))))).otherwise(three)
    return F.concat(name, (row + 1).cast("string"))
