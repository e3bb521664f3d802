"""Near-duplicate grouping by SuperMinHash, banding, verification on full sets and component search.

1. Each document becomes its set of distinct word shingles (64-bit hashes), a digest of that
   set and a SuperMinHash signature cut into bands. Documents of equal digests are one node,
   so that exact copies never meet each other again.
2. A band value shared by several nodes makes them candidates. Nodes are first compared with
   one hub of their buckets; what is confirmed joins one component. In buckets that still hold
   several components, all nodes outside the largest are gathered in blocks, and the buckets' nodes pass
   by these, so that every pair of different components has been compared and none is lost,
   while rows count nodes by blocks and not pairs. Shingles that no other candidate has bound each
   intersection exactly: nodes that the bound keeps from every partner leave their buckets.
3. A comparison takes both documents' whole sets. Members of a hub or block with many candidates
   are dealt over salted groups, each with its own copy of the hub or block.
4. Components come from repeated star contraction over tables in the shared folder.

A pair at the threshold escapes all bands with a probability of at most ``miss``.

Defined results: texts without words (null, blank) have n_shingles 0 and link with nothing;
rows that repeat a doc_id and a text are all returned; one doc_id on different texts is one
node that links by any of them; a null doc_id has component_id null and kept true; an
empty table gives an empty result. Columns beyond doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def step_key(i: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * i & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``most`` of them."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(data: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of the whole sequence if it is shorter."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(len(h) - k + 1, 1)
    acc = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        acc = mix(acc * GOLDEN + h[j : j + n])
    return np.unique(acc)


def super_minhash(items: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of distinct 64-bit items: rank j + r of an element lands in slot p[j] of its own permutation.

    All elements take step j together, which gives the same minima as one element at a time,
    and steps end once every slot holds less than any later rank.
    """
    h = np.full(m, np.inf)
    perm = None
    for j in range(m):
        r = (mix(items + step_key(2 * j + 1)) >> np.uint64(11)).astype(float) * 2.0**-53 + j
        pick = (mix(items + step_key(2 * j + 2)) % np.uint64(m - j)).astype(np.int64) + j
        if j == 0:
            slot = first = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int32), (len(items), 1))
                rows = np.arange(len(items))
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(h, slot, r)
        if h.max() < j + 1:
            break
    return h


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = super_minhash(items, bands * rows).view(np.uint64).reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        acc = mix(acc * GOLDEN + sig[:, j])
    return acc.view(np.int64)


def digest_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def id_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            n, digest, keys = [], [], []
            for t in b.column("data"):
                items = shingle_set(t.as_py(), k, hashes)
                n.append(len(items))
                digest.append(digest_of(items) if len(items) else None)
                keys.append(band_keys(items, bands, rows) if len(items) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int, group: int = 128) -> DataFrame:
    """Those (hub, node) pairs whose whole sets satisfy 100 * intersection >= percent * union; ``texts``: (node, data)."""
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    dealt = pairs.join(load, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = load.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    rows = dealt.unionByName(hubs).join(texts, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", "member")

    def run(batches):
        hashes, at, sets = WordHashes(), None, []
        for b in batches:
            hub_out, node_out = [], []
            for hub, part, member, node, data in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "member", "node", "data"))):
                items = shingle_set(data, k, hashes)
                if (hub, part) != at:
                    at, sets = (hub, part), []
                if not member:
                    sets.append(items)
                    continue
                for other in sets:
                    common = len(items) + len(other) - len(np.union1d(items, other))
                    if common and 100 * common >= percent * (len(items) + len(other) - common):
                        hub_out.append(hub)
                        node_out.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(hub_out, pa.int64()), pa.array(node_out, pa.int64())], names=["hub", "node"])

    return rows.mapInArrow(run, "hub long, node long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that isn't its component's smallest; star contraction."""
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    while True:
        degree = e.groupBy("v").agg(F.count("*").alias("n"))
        open_ends = degree.where("n > 1").select("v").limit(1).unionByName(e.select("m").join(e.select(F.col("v").alias("m")), "m", "left_semi").select(F.col("m").alias("v")).limit(1))
        if open_ends.isEmpty():
            return e.select(F.col("v").alias("node"), F.col("m").alias("root"))
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v != m").distinct()
        large = materialize(large)
        # small star: a node and its smaller neighbours move to the smallest neighbour
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(low.select("v", F.col("low").alias("m"))).where("v != m").distinct()
        nxt = materialize(small)
        discard(e)
        discard(large)
        e = nxt


def block_links(able: DataFrame, texts: DataFrame, k: int, percent: int, keep, block: int = 200_000, group: int = 2000) -> DataFrame:
    """Links (hub, node) that join the components which meet in buckets; ``able``: (key, node, n, root).

    ``keep`` writes a table that the caller deletes later. In each bucket the largest component stands against all nodes outside it. These are gathered
    in blocks of about ``block`` shingles, and the nodes of the buckets that a block touches
    pass by it once, dealt over groups of ``group``. Rows count nodes by blocks, never pairs; a block yields
    only links that join what it hasn't joined yet.
    """
    largest = able.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    outside = able.join(largest, "key").where("root != main").select("key", "node", "n", "root", "main")
    strays = outside.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("main").alias("anchor"))
    blocks = strays.groupBy("anchor").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    strays = keep(strays.join(blocks, "anchor").select("node", "root", "anchor", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part")))
    touched = outside.select("key", "node").join(strays, "node").select("key", "anchor", "part").distinct()
    passing = keep(able.join(touched, "key").select("anchor", "part", "node", "root").distinct())
    load = passing.groupBy("anchor", "part").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    dealt = passing.join(load, ["anchor", "part"]).select("anchor", "part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("salts")).cast("int").alias("salt"), "node", "root", F.lit(1).alias("member"))
    held = strays.join(load, ["anchor", "part"]).select("anchor", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", "root", F.lit(0).alias("member"))
    place = ("anchor", "part", "salt")
    rows = dealt.unionByName(held).join(texts, "node").repartition(*place).sortWithinPartitions(*place, "member")

    def run(batches):
        hashes, at, block_sets, lead = WordHashes(), None, None, {}

        def find(x):
            while lead.setdefault(x, x) != x:
                lead[x] = x = lead[lead[x]]
            return x

        def ready():
            """The block's shingles in order, whose they are, and its nodes' sizes."""
            names, roots, sets = zip(*block_sets)
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(every, kind="stable")
            return names, roots, np.array([len(x) for x in sets]), every[order], owner[order]

        index = None
        for b in batches:
            hub_out, node_out = [], []
            for *where, member, node, root, data in zip(*(b.column(c).to_pylist() for c in (*place, "member", "node", "root", "data"))):
                if where != at:
                    at, block_sets, index = where, [], None
                    lead.clear()
                items = shingle_set(data, k, hashes)
                if not member:
                    block_sets.append((node, root, items))
                    continue
                if index is None:
                    index = ready()
                names, roots, sizes, every, owner = index
                low, high = np.searchsorted(every, items, "left"), np.searchsorted(every, items, "right")
                hit = high > low
                if not hit.any():
                    continue
                low, high = low[hit], high[hit]
                spans = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
                common = np.bincount(owner[spans], minlength=len(names))
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(items) - common)):
                    x, y = find(roots[i]), find(root)
                    if x != y:
                        lead[max(x, y)] = min(x, y)
                        hub_out.append(names[i])
                        node_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(hub_out, pa.int64()), pa.array(node_out, pa.int64())], names=["hub", "node"])

    return rows.mapInArrow(run, "hub long, node long")


def own_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(node, text_id, own): how many shingles of a node's text no other text has; texts without any are left out.

    ``text_id`` is the beginning of the set's digest, as a node may stand on several texts.
    """

    def run(batches):
        hashes = WordHashes()
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                sets = [shingle_set(t.as_py(), k, hashes) for t in b.column("data")]
                sizes = [len(x) for x in sets]
                node = np.repeat(b.column("node").to_numpy(), sizes)
                text_id = np.repeat(np.array([id_of(digest_of(x)) for x in sets], np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(node), pa.array(text_id)], names=["shingle", "node", "text_id"])

    once = texts.mapInArrow(run, "shingle long, node long, text_id long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("text_id").alias("text_id")).where("c = 1")
    return once.groupBy("node", "text_id").agg(F.count("*").alias("own"))


def group(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row per document."""
    bands = bands_for(percent / 100, rows, miss)
    sketch = materialize(_sketch(docs, k, bands, rows))
    nodes = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.min_by("keys", "doc_id").alias("keys"))
    nodes = materialize(nodes)
    made = []

    def keep(df):
        made.append(materialize(df))
        return made[-1]

    text_id = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("text_id")
    member = nodes.select(F.explode("keys").alias("key"), "node", "n", text_id)
    crowded = member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    active = keep(member.join(crowded, "key"))
    # texts of nodes in shared buckets, which all comparisons read
    candidates = active.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("data")).join(candidates, "node", "left_semi")
    texts = keep(texts)
    # shingles that no other candidate has lie in no intersection: two texts share at most ``common``
    own = own_shingles(texts, k)
    shared = active.select("node", "text_id", "n").distinct().join(own, ["node", "text_id"], "left").select("node", "text_id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    shared = keep(shared.where(f"100 * common >= {percent} * n"))
    active = keep(active.select("key", "node", "text_id").join(shared, ["node", "text_id"]).drop("text_id"))

    def possible(n, common, hub_n, hub_common):
        return f"100 * least({common}, {hub_common}) >= {percent} * ({n} + {hub_n} - least({common}, {hub_common}))"

    def as_hubs(df, *more):
        return df.select("key", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("common").alias("hub_common"), *more)

    reach = possible("n", "common", "hub_n", "hub_common")
    # first every node against one hub of its buckets: that with the smallest share of shingles of its own,
    # which in a group of edited copies is the text closest to all of them
    alone = (F.col("n") - F.col("common")) / F.col("n")
    hubs = as_hubs(active.groupBy("key").agg(F.min(F.struct(alone.alias("alone"), "node", "n", "common")).alias("h"), F.count("*").alias("c")).where("c > 1").select("key", "h.*"), "alone")
    first = active.join(hubs, "key").where("node != hub").where(reach).groupBy("node").agg(F.min(F.struct("alone", "hub")).alias("h")).select("node", "h.hub")
    found = confirm(keep(first.select("hub", "node")), texts, k, percent)
    roots = components(found.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    placed = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # components by bucket, and buckets where two or more could reach the smallest node there
    parts = placed.groupBy("key", "root").agg(F.max("common").alias("common"), F.min("n").alias("n"))
    several = parts.groupBy("key").agg(F.min("n").alias("least_n"), F.count("*").alias("c")).where("c > 1").select("key", "least_n")
    reaches = f"100 * common >= {percent} * (n + least_n - common)"
    mixed = parts.join(several, "key").where(reaches).groupBy("key").agg(F.first("least_n").alias("least_n"), F.count("*").alias("c")).where("c > 1").select("key", "least_n")
    able = keep(placed.join(mixed, "key").where(reaches).select("key", "node", "n", "root"))
    more = block_links(able, texts, k, percent, keep).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # a doc_id on several texts ties their nodes together
    ids = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    several = ids.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("doc_id")
    same = ids.join(several, "doc_id").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    made.append(roots)
    roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(same))
    for table in made:  # all but the sketch, its nodes and the roots
        discard(table)
    placed = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(placed, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each group left, with their own columns; repeats of a kept row go too.

    Rows that share the kept doc_id but not their text all stay, since neither is a copy by its id alone; of rows that
    share both, the first in the order of their JSON stays.
    """
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    own_id, own_text = (inner[names.index(n)] for n in ("doc_id", "text"))
    left = docs.toDF(*inner).withColumn("_id", F.col(own_id).cast("long"))
    gone = group(docs, **how).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    again = left.groupBy("_id").count().where("count > 1 AND _id IS NOT NULL").select("_id")
    marks = gone.withColumn("_gone", F.lit(True)).unionByName(again.join(gone, "_id", "left_anti").withColumn("_gone", F.lit(False)))
    left = left.join(marks, "_id", "left")
    once = left.where("_gone IS NULL").select(*inner)
    # only rows whose doc_id recurs are dealt out by doc_id and text
    row = F.struct(*inner)
    repeated = left.where("NOT _gone").groupBy("_id", own_text).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.unionByName(repeated.select(*(F.col("_row")[c].alias(c) for c in inner))).toDF(*names)


def _oracle(k: int = 3, percent: int = 85) -> str:
    """The same rows in DuckDB's SQL, by all pairs that share a shingle; for small tables whose doc_ids are distinct."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: {shingle}))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM words),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT node, n, unnest(s) AS shingle FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT x.doc_id, coalesce(len(x.s), 0)::BIGINT AS n_shingles, coalesce(r.root, x.doc_id) AS component_id, coalesce(r.root, x.doc_id) = x.doc_id AS kept
FROM sets x LEFT JOIN nodes n ON x.s = n.s LEFT JOIN roots r ON r.node = n.node
"""


ORACLE = _oracle()
