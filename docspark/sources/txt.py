"""Plain text: classified lines, as an array within each document's row or exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ELEMENT = "array<struct<pos:int,type:string,text:string,markdown:string>>"


def _type(line: Column, bare: Column) -> Column:
    shout = (F.octet_length(bare) <= 80) & bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}")
    return (
        F.when(F.startswith(bare, F.lit("#")) | shout, "heading")
        .when(bare.rlike("^([-*] |[0-9]+[.)])"), "list_item")
        .when(F.startswith(line, F.lit("    ")) | F.contains(line, F.lit("{")) | F.contains(line, F.lit("}")) | F.contains(line, F.lit(";")), "code")
        .otherwise("paragraph")
    )


def line_type(line: Column) -> Column:
    """heading, list_item, code or paragraph of a line without trailing white space; the first that fits."""
    return _type(line, T.trim(line))


def _markdown(kind: Column, line: Column, bare: Column) -> Column:
    return (
        F.when(kind == "heading", F.concat(F.lit("# "), bare))
        .when(kind == "list_item", F.concat(F.lit("- "), T.trim(F.ltrim(line, F.lit("-* ")))))
        .when(kind == "code", F.concat(F.lit("```\n"), line, F.lit("\n```")))
        .otherwise(line)
    )


def elements_in_row(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``elements``: its non-blank lines, classified; no explode, no shuffle.

    Each step is a pass of its own, because a lambda computes an expression anew wherever it is used.
    """
    rows = F.transform(T.lines(T.normalize_newlines(F.col(text))), lambda x, i: F.struct(i.cast("int").alias("pos"), T.trim_end(x).alias("line")))
    rows = F.filter(rows, lambda e: e["line"] != "")
    rows = F.transform(rows, lambda e: F.struct(e["pos"].alias("pos"), e["line"].alias("line"), T.trim(e["line"]).alias("bare")))
    rows = F.transform(rows, lambda e: F.struct(e["pos"].alias("pos"), e["line"].alias("line"), e["bare"].alias("bare"), _type(e["line"], e["bare"]).alias("type")))
    rows = F.transform(rows, lambda e: F.struct(e["pos"].alias("pos"), e["type"].alias("type"), e["line"].alias("text"), _markdown(e["type"], e["line"], e["bare"]).alias("markdown")))
    return docs.withColumn("elements", rows)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, line: non-blank lines without trailing white space."""
    rows = docs.select("doc_id", F.posexplode(T.lines(T.normalize_newlines(F.col(text)))).alias("pos", "line"))
    return rows.withColumn("line", T.trim_end(F.col("line"))).where("line != ''")


def elements(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, type, text, markdown, a row per non-blank line; narrow."""
    rows = lines(docs, text).withColumn("bare", T.trim(F.col("line"))).withColumn("type", _type(F.col("line"), F.col("bare")))
    return rows.select("doc_id", "pos", "type", F.col("line").alias("text"), _markdown(F.col("type"), F.col("line"), F.col("bare")).alias("markdown"))
