"""Books: dehyphenation, chapters, footnotes, contents, old orthography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Forms of chapter titles, in order of preference, and of footnotes.
CHAPTERS = (
    r"(?iumd)^\s*глава\s+[0-9ivxlcdm]+[\.:]?\s*(.*)$",
    r"(?iumd)^\s*часть\s+первая\s*(.*)$",
    r"(?iumd)^\s*[ivxlcdm]+\.\s+(.+)$",
    r"(?iumd)^\s*[0-9]+\.\s+(.+)$",
)
FOOTNOTE = r"(?md)^\s*(\[?[0-9]{1,2}\]?)[\)\.]\s+(.+)$"
OLD_LETTERS = "[ѣіѳѵ]"

_SKIP = "({x} rlike r'https?://' OR contains({x}, '|') OR contains({x}, '$'))".format  # lines that are left as they are
# The fold over lines: ``held`` is the line that waits for its continuation.
_FOLD = rf"""aggregate(_lines,
  named_struct('out', cast(array() as array<string>), 'code', false, 'held', cast(null as string), 'changed', false),
  (s, l) -> CASE
    WHEN s.held IS NOT NULL AND NOT {_SKIP(x='l')} THEN
      named_struct('out', concat(s.out, array(concat(regexp_replace(s.held, r'-+$', ''), regexp_replace(l, r'^{T.SPACE}+', '')))), 'code', s.code, 'held', cast(null as string), 'changed', true)
    ELSE named_struct(
      'out', concat(s.out, if(s.held IS NULL, cast(array() as array<string>), array(s.held)), if(OPENS, cast(array() as array<string>), array(l))),
      'code', s.code != startswith(regexp_replace(l, r'^{T.SPACE}+', ''), '```'),
      'held', if(OPENS, l, cast(null as string)), 'changed', s.changed) END,
  s -> named_struct('lines', if(s.held IS NULL, s.out, concat(s.out, array(s.held))), 'changed', s.changed))"""
_OPEN = rf"(NOT s.code AND regexp_replace(l, r'{T.SPACE}+$', '') rlike '-$' AND NOT startswith(regexp_replace(l, r'^{T.SPACE}+', ''), '```') AND NOT {_SKIP(x='l')})"


def dehyphenate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with dehyphenated (each line ended by a newline) and dehyphenation_applied; a fold within the row."""
    cut = docs.withColumn("_lines", F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(T.lines(F.col(text))))
    done = cut.withColumn("_d", F.expr(_FOLD.replace("OPENS", _OPEN)))
    joined = F.concat_ws("", F.transform("_d.lines", lambda x: F.concat(x, F.lit("\n"))))
    return done.withColumn("dehyphenated", joined).withColumn("dehyphenation_applied", F.col("_d.changed")).drop("_lines", "_d")


def chapters(text: Column) -> Column:
    """Titles by form, then position; the first of equal ones."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CHAPTERS))
    return F.array_distinct(F.filter(F.transform(every, T.trim), lambda t: t != ""))


def footnotes(text: Column) -> Column:
    """array of (marker, text)."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(1)).alias("marker"), F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(2)).alias("text"))


def title(text: Column) -> Column:
    return F.get(F.filter(F.transform(T.lines(text), T.trim), lambda x: x != ""), F.lit(0))


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with title, chapters (title, index), toc (title, page), footnotes and old_orthography."""
    done = dehyphenate(docs, text)
    body = F.col("dehyphenated")
    done = done.withColumn("_c", chapters(body))
    numbered = lambda name: F.transform("_c", lambda t, i: F.struct(t.alias("title"), (i + 1).alias(name)))
    return done.withColumns({
        "title": title(body), "chapters": numbered("index"), "toc": numbered("page"), "footnotes": footnotes(body), "old_orthography": F.lower(body).rlike(OLD_LETTERS),
    }).drop("_c")
