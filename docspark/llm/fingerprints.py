"""I-Match fingerprints: hashes of the distinct terms of a document within randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band (``low`` to ``high`` of all
documents, that is, an inverse-document-frequency band); terms are words in ASCII lower case without ASCII punctuation. A document's distinct lexicon
terms, sorted, are hashed within each of several random subsets of the lexicon. Subsets come in scales: scale k keeps a
term with probability 2^-k; a document uses the scale at which one to two of its terms are expected
in a subset, and the next, so that short and long documents are about as tolerant of edits.
Likeness is the share of equal hashes among subsets that aren't empty, at a scale both have.

The band's lower end bounds the lexicon: terms in at least ``low`` of N documents are at most
(mean distinct terms of a document) / ``low``, whatever N; that is what executors are sent. Document
frequencies are exact: tasks count their own terms and flush when these are many, one
aggregation by term adds the counts up.

The edited text of a document takes its end from the next document by doc_id. Documents are dealt
once by ranges of doc_id and sorted there; each range also gets the first document of the next one.
The ranges' bounds come from a range partitioning of the bare ids; their number grows with the rows.

Defined results: null texts count as empty; a text with fewer than ``least`` lexicon terms is
hashed over all its terms; empty texts have the fingerprint of no term; equal texts have
equal fingerprints and likeness 1; documents that share a doc_id follow each other by their first ``LEAD``
characters and then in a fixed order; null
doc_ids come first (all documents of one id, or of none, are sorted in one range); a single document is its own successor; an empty table gives an
empty result. Columns beyond doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache
from .near_dedup import mix, step_key

SUBSETS = 24
PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}|*$%&#<>", b" " * 22)
LOWEST = -(2**63)
LEAD = 100


def terms_of(data: bytes | None) -> set[bytes]:
    return set((data or b"").lower().translate(PUNCTUATION).split())


def _zeros(terms: list[bytes]) -> np.ndarray:
    """Leading zero bits of each term's random number for each subset; at scale k, 'k or more' is membership."""
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)
    out = np.zeros((len(terms), SUBSETS), np.uint8)
    for j in range(SUBSETS):
        g = mix(h ^ step_key(j + 1)) >> np.uint64(32)
        out[:, j] = 32 - np.ceil(np.log2(g.astype(float) + 1)).astype(np.uint8)
    return out


class Lexicon:
    def __init__(self, terms: list[bytes], least: int = 4):
        self.terms = sorted(terms)
        self.least = least
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.zeros = _zeros(self.terms)
        self.raw = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)

    def fingerprint(self, data: bytes | None) -> str:
        words = terms_of(data)
        at = np.sort(np.fromiter((self.at[w] for w in words if w in self.at), np.int64))
        if len(at) >= self.least:
            zeros, raw = self.zeros[at], self.raw[at]
        else:
            own = sorted(words)
            zeros, raw = _zeros(own), np.array([xxhash.xxh3_64_intdigest(t) for t in own], np.uint64)
        k = max(0, len(raw).bit_length() - 1)
        parts = []
        for scale in (k, k + 1):
            for j in range(SUBSETS):
                chosen = raw[zeros[:, j] >= scale]
                parts.append(hashlib.blake2b(chosen.tobytes(), digest_size=3).hexdigest() if len(chosen) else "------")
        return f"{k:02d}" + "".join(parts)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    ka, kb = int(a[:2]), int(b[:2])
    best = 0.0
    for scale in {ka, ka + 1} & {kb, kb + 1}:
        i, j = 2 + 6 * SUBSETS * (scale - ka), 2 + 6 * SUBSETS * (scale - kb)
        x = [a[i + 6 * s : i + 6 * s + 6] for s in range(SUBSETS)]
        y = [b[j + 6 * s : j + 6 * s + 6] for s in range(SUBSETS)]
        used = sum(p != "------" or q != "------" for p, q in zip(x, y))
        same = sum(p == q != "------" for p, q in zip(x, y))
        best = max(best, same / used if used else 0.0)
    return best


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1, most_terms: int = 500_000) -> Lexicon:
    """Terms in ``low`` to ``high`` of the documents (at least two), exactly; a task holds ``most_terms`` counts at once."""
    data = docs.select(F.col("text").cast("binary").alias("data"))

    def count(batches):
        counts = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column("data"):
                counts.update(terms_of(t.as_py()))
                if len(counts) > most_terms:
                    yield flush()
        yield flush()

    total = docs.count()
    df = data.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = df.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= high * total)).select("term")
    return Lexicon([bytes(r[0]) for r in band.toLocalIterator()])


def edited(own: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first, or all."""
    k = len(own) // 4
    return own[: len(own) - k] + following[:k]


def range_starts(ids: DataFrame, ranges: int) -> np.ndarray:
    """The smallest place of each range that holds any, in order: a number per range."""
    dealt = ids.repartitionByRange(ranges, "place").select("place", F.spark_partition_id().alias("range"))
    return np.array(sorted(r["place"] for r in dealt.groupBy("range").agg(F.min("place").alias("place")).toLocalIterator()), np.int64)


def fingerprint(docs: DataFrame, rows_per_range: int = 20_000, least_ranges: int = 256, least_rows: int = 500, **band) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A range holds about ``rows_per_range`` documents, or fewer where that makes less than ``least_ranges`` ranges of ``least_rows``.
    """
    spark = docs.sparkSession
    terms = lexicon(docs, **band).terms
    digest = hashlib.blake2b(b" ".join(terms)).digest()
    # bounded by the band's lower end, whatever the number of documents
    sent = spark.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select("doc_id", place.alias("place"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    total = docs.count()
    ranges = max(1, total // rows_per_range, min(least_ranges, total // least_rows))
    starts = range_starts(rows.select("place"), ranges)
    # a number per range: 8 bytes for rows_per_range documents
    bounds = spark.sparkContext.broadcast(starts)

    def deal(batches):
        """Each document to its range; the first document of a range also closes the one before, of the first range the last."""
        starts, pack = bounds.value, zstandard.ZstdCompressor(1)
        for b in batches:
            at = b.column("place").to_numpy(zero_copy_only=False)
            number = np.searchsorted(starts, at, "right") - 1
            texts = [t.as_py() for t in b.column("data")]
            lead = [t[: 4 * LEAD].decode(errors="ignore")[:LEAD].encode() for t in texts]
            packed = [pack.compress(t) for t in texts]
            first = {}
            for i in np.flatnonzero(starts[number] == at).tolist():
                if number[i] not in first or (lead[i], packed[i]) < first[number[i]][:2]:
                    first[number[i]] = (lead[i], packed[i], i)
            heads = np.array([i for *_, i in first.values()], np.int64)
            every = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(lead, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "place", "lead", "packed"])
            for part, to, after in ((every, number, 0), (every.take(pa.array(heads)), (number[heads] - 1) % len(starts), 1)):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.int32()), pa.array(np.full(len(to), after), pa.int32())], names=[*part.schema.names, "range", "after"])

    # texts are the bulk of what is dealt: they go packed
    dealt = rows.mapInArrow(deal, f"doc_id {kind}, place long, lead binary, packed binary, range int, after int")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "after", "place", "lead", "packed")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = process_cache(("i-match", digest), lambda: Lexicon(sent.value))
        at, unpack = None, zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc_id, packed, rng, after in zip(*(b.column(c) for c in ("doc_id", "packed", "range", "after"))):
                doc_id, rng, after, text = doc_id.as_py(), rng.as_py(), after.as_py(), unpack.decompress(packed.as_py()).decode()
                fp = words.fingerprint(text.encode())
                if at is not None and at[2] == rng:
                    new = edited(at[1], text).encode()
                    efp = words.fingerprint(new)
                    out.append((at[0], len(at[1]), hashlib.sha256(new).hexdigest(), at[3], efp, likeness(at[3], efp), likeness(at[3], fp)))
                # of the documents that close a range only the first is next
                at = None if after else (doc_id, text, rng, fp)
            cols = list(zip(*out)) if out else [()] * 7
            types = (b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
