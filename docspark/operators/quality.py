"""Document statistics and the quality report."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from fractions import Fraction
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import txt

TEXT_LIKE = ("text", "text_ocr", "heading", "paragraph", "blockquote", "list_item", "code", "caption")


def word_count(x) -> F.Column:
    return F.regexp_count(x, F.lit(f"[^{T.SPACE[1:]}+")).cast("bigint")


def document_stats(rows: DataFrame) -> DataFrame:
    """Counts of a text document from its row's ``elements`` and text: no shuffle."""

    def of(*kinds):
        return F.size(F.filter("elements", lambda e: e["type"].isin(*kinds))).cast("bigint")

    return rows.select(
        "doc_id", F.lit(1).alias("pages"), F.size("elements").cast("bigint").alias("elements"), of(*TEXT_LIKE).alias("text_elements"), of("heading").alias("headings"),
        of("list_item").alias("list_items"), of("code").alias("code_blocks"), F.length("text").cast("bigint").alias("chars"), word_count(F.col("text")).alias("words"),
    )


def element_stats(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts per document from tables of elements and pages: partial sums, one shuffle each by document."""
    count = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    per = elements.groupBy("doc_id").agg(
        F.count("*").alias("elements"), count(*TEXT_LIKE).alias("text_elements"), count("text_ocr").alias("ocr_elements"), count("image", "page_image").alias("images"),
        count("table").alias("tables"), count("formula").alias("formulas"), count("list", "list_item").alias("lists"),
    )
    sums = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum(word_count(F.col("text"))).alias("words"), F.count_if(T.is_blank(F.col("text"))).alias("empty_pages"))
    return sums.join(per, "doc_id", "left").na.fill(0)


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, raw, block: the page's text (pos 0) and its lines, trimmed and normalized; narrow."""
    page = docs.select("doc_id", F.lit(0).alias("pos"), T.trim(F.col("text")).alias("raw"))
    lines = txt.lines(docs).select("doc_id", (F.col("pos") + 1).alias("pos"), T.trim(F.col("line")).alias("raw"))
    return page.unionByName(lines).where("raw != ''").withColumn("block", T.normalize_block(F.col("raw")))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """doc_id, chars, repeated: characters of blocks beyond their first occurrence."""
    counts = rows.groupBy("doc_id", F.xxhash64("block").alias("h"), "block").agg(F.count("*").alias("n")).withColumn("length", F.length("block").cast("bigint"))
    return counts.groupBy("doc_id").agg(F.sum(F.col("length") * F.col("n")).alias("chars"), F.sum(F.col("length") * (F.col("n") - 1)).alias("repeated"))


#: By byte: lower-case ASCII letters and digits, all else as a blank (``normalize_similarity`` of UTF-8).
_TOKENS = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))
#: What ``str.split`` takes for white space though SPACE hasn't it.
_NO_SPACES = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile(f"[{re.escape(T.SPACES)}]+")


def _halves(sizes) -> int:
    """Sum of half the shorter over all pairs."""
    return sum(i * (n // 2) for i, n in enumerate(sorted(sizes, reverse=True)))


def _respaced_chars(blocks: list) -> int:
    """Half the shorter of each pair of unequal blocks at different positions: all pairs, less what is equal."""
    every = [(k, pos, n) for k, (n, at) in enumerate(blocks) for pos in at]
    total = 0
    for sign, key in ((1, lambda x: 0), (-1, lambda x: x[0]), (-1, lambda x: x[1]), (1, lambda x: x[:2])):
        groups = defaultdict(list)
        for x in every:
            groups[key(x)].append(x[2])
        total += sign * sum(map(_halves, groups.values()))
    return total


def near_chars(places: dict[str, list[int]], least: Fraction) -> int:
    """Half the shorter of each pair of unequal blocks of one document with similarity ``least`` or more.

    ``places``: positions by block. Such pairs are equal without spaces, or share nearly all tokens of
    the earlier block ``a``: so any floor((1 - least) * tokens) + 1 distinct tokens of ``a`` hold one that ``b``
    has, and ``b`` has nearly as many distinct tokens. Blocks are taken from the last to the first: what no later
    one has rules most of them out, and the others look for partners by their rarest tokens.
    """
    if len(places) < 2:
        return 0
    texts, alike = defaultdict(list), defaultdict(list)
    for block, at in places.items():
        ts = block.encode().translate(_TOKENS).split()
        if ts:
            own = (len(block), sorted(at))
            texts[b" ".join(ts)].append(own)
            alike[b"".join(ts)].append(own)
    total = sum(_respaced_chars(x) for x in alike.values() if len(x) > 1)
    rows = []
    for an, own in texts.items():
        ts = an.split()
        rows.append((min(at[0] for _, at in own), max(at[-1] for _, at in own), an, b"".join(ts), len(ts), set(ts), own))
    num, den = least.numerator, least.denominator
    later = sorted(range(len(rows)), key=lambda i: rows[i][1])
    seen, postings, waiting, most = set(), defaultdict(list), [], 0
    for low, _, an, ac, n, ds, own in sorted(rows, key=lambda r: -r[0]):
        while later and rows[later[-1]][1] > low:
            waiting.append(i := later.pop())
            seen |= rows[i][5]
            most = max(most, len(rows[i][5]))
        slack = (den - num) * n // den
        if len(ds) - slack > most or len(ds - seen) > slack:
            continue
        for i in waiting:
            for t in rows[i][5]:
                postings[t].append(i)
        waiting.clear()
        counts, some = None, set()
        for t in nsmallest(slack + 1, ds, key=lambda t: len(postings.get(t, ()))):
            some.update(postings.get(t, ()))
        for i in some:
            _, high, bn, bc, m, db, other = rows[i]
            if high <= low or den * n < num * m or len(ds) - slack > len(db) or len(lacks := ds - db) > slack or bc in ac or ac in bc:
                continue
            counts = counts or Counter(an.split())
            if den * (n - sum(counts[t] for t in lacks)) >= num * max(n, m):
                total += sum(min(x, y) // 2 * sum(bisect_left(at, pos) for pos in to) for x, at in own for y, to in other)
    return total


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _squeeze(text: str, odd: bool) -> str:
    return _SPACES.sub(" ", text).strip(" ") if odd else " ".join(text.split())


def _places(texts: list[str]) -> dict[str, list[int]]:
    """Positions by block: pages at 0, their lines from 1."""
    places = defaultdict(list)
    for text in texts:
        odd = any(x in text for x in _NO_SPACES)
        found = [(i, x) for i, line in enumerate(_lines(text), 1) if (x := _squeeze(line, odd))]
        for i, x in [(0, " ".join(x for _, x in found)), *found] if found else ():
            places[x].append(i)
    return places


def _trimmed_chars(text: str) -> int:
    return len(text.strip(T.SPACES)) + sum(len(x.strip(T.SPACES)) for x in _lines(text))


def block_stats(docs: DataFrame, least: float = 0.92, raw: bool = False) -> DataFrame:
    """doc_id, elements, words, chars, repeated, near_chars (and raw_chars) of each document's ``blocks``.

    One shuffle of the texts by document, because rows may share a doc_id; all pairs are within a document, so
    they are found within its row. Blocks without doc_id are equal to no others, and needn't come together.
    """
    kind, share = docs.schema["doc_id"].dataType.simpleString(), Fraction(str(least))
    texts = docs.groupBy("doc_id").agg(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.col("text"))).alias("_raw"))
    fields = ("elements", "words", "chars", "repeated", "near_chars", *(["raw_chars"] if raw else []))

    def of(texts, raws):
        places = _places(texts)
        yield sum(pos > 0 for at in places.values() for pos in at)
        yield sum((x.count(" ") + 1) * len(at) for x, at in places.items())
        yield sum(len(x) * len(at) for x, at in places.items())
        yield sum(len(x) * (len(at) - 1) for x, at in places.items())
        yield near_chars(places, share)
        if raw:
            yield sum(map(_trimmed_chars, raws))

    def run(batches):
        for big in batches:
            for b in (big.slice(i, 100) for i in range(0, big.num_rows, 100)):
                raws = b.column("_raw").to_pylist() if raw else [()] * b.num_rows
                rows = [tuple(of(x, y)) for x, y in zip(b.column("_texts").to_pylist(), raws)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))], names=["doc_id", *fields])

    given = texts.select("doc_id", F.transform("_raw", F.lower).alias("_texts"), *(["_raw"] if raw else []))
    return given.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} long" for f in fields)]))


def near_duplicates(docs: DataFrame, least: float = 0.92) -> DataFrame:
    """doc_id, near_chars: half the shorter of each pair of unequal blocks with similarity ``least`` or more."""
    return block_stats(docs.where(~T.is_blank(F.col("text"))), least).select("doc_id", "near_chars")


def low_confidence_ratio(ocr: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id, ratio of rows below ``limit``; a missing confidence counts as 1."""
    return ocr.groupBy("doc_id").agg(F.avg((F.coalesce("confidence", F.lit(1.0)) < limit).cast("double")).alias("low_confidence_ocr_ratio"))


def text_report(docs: DataFrame) -> DataFrame:
    """The quality report of text documents, a row each."""
    blank = F.coalesce(T.is_blank(F.col("text")), F.lit(False))
    joined = docs.select("doc_id", blank.alias("blank")).join(block_stats(docs, raw=True), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ratio = F.round(F.least(F.lit(1.0), (F.col("repeated") + F.col("near_chars")) / F.nullif("chars", F.lit(0))), 4)
    none = F.lit(0)
    return joined.select(
        "doc_id", F.lit("txt").alias("format"), F.lit(1).alias("pages"), zero("elements").alias("elements"), zero("raw_chars").alias("chars"), zero("words").alias("words"),
        *(none.alias(n) for n in ("tables", "images", "formulas", "ocr_elements")), F.col("blank").cast("int").alias("empty_pages"),
        F.coalesce(ratio, F.lit(0.0)).alias("duplicate_text_ratio"), F.lit(0.0).alias("low_confidence_ocr_ratio"),
    )
