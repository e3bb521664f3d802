"""Text functions as columns; all stay in the JVM.

White space means Unicode white space, spelled out because ``\\s`` covers ASCII only in some engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of Unicode white space; valid in Java and RE2 alike.
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one after the other, for the trim functions, which need no pattern.
SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CYRILLIC = r"[\x{0400}-\x{052F}]"
AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that canonical text replaces, and by what.
QUOTES_DASHES, PLAIN = "«»„“”’‘—–−", "\"\"\"\"\"''---"


def trim(x: Column) -> Column:
    return F.trim(x, F.lit(SPACES))


def trim_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def is_blank(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES)) == ""


def ascii_lower(x: Column) -> Column:
    return F.translate(x, AZ, LOWER)


def squeeze(x: Column) -> Column:
    """White space trimmed and collapsed to single spaces."""
    return trim(F.regexp_replace(x, f"{SPACE}+", " "))


def normalize_newlines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(x: Column) -> Column:
    """Lines without their ends; the empty piece after a final newline is no line."""
    return F.split(F.regexp_replace(x, r"\n\z", ""), "\n", -1)


def canonical_punctuation(x: Column) -> Column:
    return F.translate(x, QUOTES_DASHES, PLAIN)


def tighten_punctuation(x: Column) -> Column:
    for mark in ",.;:":
        x = F.replace(x, F.lit(" " + mark), F.lit(mark))
    return x


def normalize_russian(x: Column) -> Column:
    return tighten_punctuation(canonical_punctuation(squeeze(x)))


def normalize_similarity(x: Column) -> Column:
    """Lower-case ASCII letters and digits, all else as single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", " "))


def similarity_parts(x: Column) -> Column:
    """What ``similarity`` needs of one text, worked out once: normal form, the same without spaces, tokens."""
    n = normalize_similarity(x)
    return F.struct(n.alias("n"), F.replace(n, F.lit(" "), F.lit("")).alias("c"), F.split(n, " ").alias("t"))


def similarity_of(a: Column, b: Column) -> Column:
    """Similarity of two texts by their parts, in steps: equal, equal without spaces, contained, else shared tokens of ``a``."""
    shared = F.size(F.filter(a["t"], lambda t: F.array_contains(b["t"], t))) / F.greatest(F.size(a["t"]), F.size(b["t"]))
    within = F.contains(a["n"], b["n"]) | F.contains(b["n"], a["n"]) | F.contains(a["c"], b["c"]) | F.contains(b["c"], a["c"])
    return F.when((a["n"] == "") | (b["n"] == ""), 0.0).when(a["n"] == b["n"], 1.0).when(a["c"] == b["c"], 0.95).when(within, 0.85).otherwise(shared)


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts; where rows are many, put ``similarity_parts`` in columns and compare these."""
    parts = F.transform(F.array(F.struct(similarity_parts(a).alias("a"), similarity_parts(b).alias("b"))), lambda p: similarity_of(p["a"], p["b"]))
    return F.get(parts, F.lit(0))


def normalize_block(x: Column) -> Column:
    return squeeze(F.lower(x))


def is_page_number(x: Column) -> Column:
    return x.rlike("^[0-9]+$") | (F.startswith(x, F.lit("стр")) & x.rlike("[0-9]"))


def letter_ratio(x: Column, kind: str) -> Column:
    """Letters of the class ``kind`` among all letters; 0 without letters."""
    letters = F.length(F.regexp_replace(x, r"\P{L}+", ""))
    own = F.length(F.regexp_replace(F.regexp_replace(x, r"\P{L}+", ""), f"[^{kind}]+", ""))
    return F.when(letters == 0, 0.0).otherwise(own / letters)


def cyrillic_ratio(x: Column) -> Column:
    return letter_ratio(x, r"\x{0400}-\x{052F}")


def latin_ratio(x: Column) -> Column:
    return letter_ratio(x, "A-Za-z")


def token_estimate(x: Column) -> Column:
    return (F.octet_length(x) / F.lit(4)).cast("bigint") + 1


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)<[^>]+>", "")


def decode_entities(x: Column) -> Column:
    for safe, raw in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(safe), F.lit(raw))
    return x


def csv_escape(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike('[,"\n]'), quoted).otherwise(x)


def sanitize_filename(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")
