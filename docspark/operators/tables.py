"""Tables in lines of text, and their renderings; everything within the document's row.

A table is a grid: an array of rows of cells of one width, the first row being the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pipe_cells(line: Column) -> Column:
    """Cells between pipes, trimmed; outer pipes don't count."""
    return F.transform(F.split(F.regexp_replace(T.trim(line), r"^\|+|\|+$", ""), r"\|", -1), T.trim)


def tab_cells(line: Column) -> Column:
    return F.transform(F.split(line, "\t", -1), T.trim)


def _padded(rows: Column) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def _until(lines: Column, start: Column, mark: str) -> Column:
    """Lines from ``start`` (from 0) up to the first without ``mark``."""
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    gaps = lambda r: F.filter(F.transform(r, lambda x, i: F.when(~F.contains(x, F.lit(mark)), i)), lambda i: i.isNotNull())
    return _bound(rest, lambda r: F.slice(r, F.lit(1), F.coalesce(F.get(gaps(r), F.lit(0)), F.size(r))))


def pipe_table(lines: Column) -> Column:
    """Grid of the first pipe table of an array of lines, or null: a header, a line with ``---``, rows while there are pipes."""
    heads = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 2),
        lambda i: F.contains(F.get(lines, i), F.lit("|")) & F.contains(F.get(lines, i + 1), F.lit("---")) & (F.size(pipe_cells(F.get(lines, i))) >= 2),
    )
    first = F.when(F.size(lines) >= 2, F.get(heads, F.lit(0)))
    rows = _bound(first, lambda i: F.concat(F.array(pipe_cells(F.get(lines, i))), F.filter(F.transform(_until(lines, i + 2, "|"), pipe_cells), lambda r: F.size(r) >= 2)))
    return F.when(first.isNotNull(), _bound(rows, _padded))


def tab_table(lines: Column) -> Column:
    """Grid of the first run of two or more lines with tabs, or null."""
    heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.contains(F.get(lines, i), F.lit("\t")) & F.contains(F.get(lines, i + 1), F.lit("\t")))
    first = F.when(F.size(lines) >= 2, F.get(heads, F.lit(0)))
    return F.when(first.isNotNull(), _bound(_bound(first, lambda i: F.transform(_until(lines, i, "\t"), tab_cells)), _padded))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pipe_table and tab_table; texts without a mark are passed over."""
    x = F.col(text)
    lines = T.lines(T.normalize_newlines(x))
    none = F.lit(None).cast("array<array<string>>")
    pipe = F.when(F.contains(x, F.lit("|")) & F.contains(x, F.lit("---")), _bound(lines, pipe_table)).otherwise(none)
    tab = F.when(F.contains(x, F.lit("\t")), _bound(lines, tab_table)).otherwise(none)
    return docs.withColumn("pipe_table", pipe).withColumn("tab_table", tab)


def markdown(grid: Column) -> Column:
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(grid[0], lambda c: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(row(grid[0]), rule), F.transform(F.slice(grid, F.lit(2), F.size(grid)), row)), "\n")


def csv(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, T.csv_escape), ",")), "\n")


def html(grid: Column) -> Column:
    def row(r, i):
        tag = F.when(i == 0, "th").otherwise("td")
        cells = F.transform(r, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), T.html_escape(c), F.lit("</"), tag, F.lit(">")))
        return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))

    return F.concat(F.lit("<table><tbody>"), F.array_join(F.transform(grid, row), ""), F.lit("</tbody></table>"))


def plain(grid: Column) -> Column:
    return F.array_join(F.flatten(grid), " | ")


def cells(grids: DataFrame, grid: str = "grid") -> DataFrame:
    """``grids`` exploded to row, column, text, is_header."""
    keep = [c for c in grids.columns if c != grid]
    rows = grids.select(*keep, F.posexplode(grid).alias("row", "_r"))
    return rows.select(*keep, "row", F.posexplode("_r").alias("column", "text")).withColumn("is_header", F.col("row") == 0)


def grid_of(cells: Column) -> Column:
    """Grid of an array of cells (row, column, text); the first of cells at one place, holes are empty, null without cells."""
    place = lambda r, c: r * 100_000 + c
    keys = F.array_distinct(F.transform(cells, lambda x: place(x["row"], x["column"])))
    texts = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.get(F.filter(cells, lambda x: place(x["row"], x["column"]) == k), F.lit(0))["text"].alias("v"))))
    last = lambda name: F.array_max(F.transform(cells, lambda x: x[name]))
    rows = lambda m: F.transform(F.sequence(F.lit(0), last("row")), lambda r: F.transform(F.sequence(F.lit(0), last("column")), lambda c: F.coalesce(F.try_element_at(m, place(r, c)), F.lit(""))))
    return F.when(F.size(cells) > 0, _bound(texts, rows))


def linearized(grid: Column, most: int = 20) -> Column:
    """A table's text for chunks: its linearized pieces, a line each row."""
    return F.array_join(F.transform(linearize(grid, most), lambda p: p["text"]), "\n")


def linearize(grid: Column, most: int = 20) -> Column:
    """array of (row_start, row_end, text): up to ``most`` rows each, every value with its header."""
    head = grid[0]

    def line(r, i):
        parts = F.transform(r, lambda v, c: F.concat(F.get(head, c), F.lit(" = "), v))
        return F.concat(F.lit("Строка "), (i + 1).cast("string"), F.lit(": "), F.array_join(parts, "; "), F.lit("."))

    first = F.when(F.size(grid) > 1, 1).otherwise(0)
    starts = F.sequence(first, F.size(grid) - 1, F.lit(most))

    def piece(s):
        end = F.least(s + most, F.size(grid))
        return F.struct(s.alias("row_start"), (end - 1).alias("row_end"), F.array_join(F.slice(F.transform(grid, line), s + 1, end - s), "\n").alias("text"))

    return F.transform(starts, piece)
