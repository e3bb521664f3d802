"""Quality rules with isolation forests over rule statistics.

Base rules reject short and repetitive documents. Every other document is judged by
isolation forests, one for each family of rules (marks, repetition, letters), so that a document that is
odd by one rule isn't lost among others that vary by nature. Trees of random splits are
grown on all of these documents, whatever their labels: each row is dealt to one tree, or to several
where a tree would have too few. A document that few splits isolate has a short mean path
and so a high anomaly score. Labels only calibrate the thresholds, on counts of all labelled rows:
families are taken by how well their scores part these, each on what those before it leave, and a family
that has no bad row left to show rejects nothing.

Defined results: null and blank texts have all statistics 0 and fail the base rules (under
50 words); equal texts get equal verdicts; repeated rows are judged row by row; an empty
table gives an empty result; without labels of both classes only the base rules reject;
documents without doc_id are judged and grow trees, but have no label.
Columns beyond doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_BYTES, code_points, materialize, scratch

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_adjacent")
STATS_DDL = ", ".join(f"{s} long" for s in STATS)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def duplicate_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(WS_BYTES))
        else:
            seen.add(line)
    return again


def statistics(data: bytes | None) -> tuple[int, ...]:
    data = data or b""
    words = data.split()
    return (
        len(words),
        code_points(data.translate(None, WS_BYTES)),
        len(data) - len(data.translate(None, SYMBOLS)),
        duplicate_lines(data),
        repeated_words(words),
        data.count(b"\n") + 1 if words else 0,
        len(data) - len(data.translate(None, UPPER)),
        data.count(b"!"),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def rates(stats: np.ndarray) -> dict[str, np.ndarray]:
    """Features by family of rules: statistics relative to the document's size."""
    words, chars, symbols, dup, repeat, lines, upper, bangs, adjacent = stats.astype(float).T
    per_word, per_char = 1 / np.maximum(words, 1), 1 / np.maximum(chars, 1)
    return {
        "marks": np.column_stack([symbols * per_char, bangs * per_char]),
        "repetition": np.column_stack([dup / np.maximum(lines, 1), repeat * per_word, adjacent * per_word]),
        "letters": np.column_stack([chars * per_word, upper * per_char]),
    }


def _average_path(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays in heap order; the model's size depends on ``trees`` and ``sample`` alone.

    Every row grows a tree: ``sample`` is the least number of rows a tree should have, not the most.
    """

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.depth, self.seed = trees, sample, int(np.ceil(np.log2(sample))), seed

    def share(self, n: int) -> int:
        """To how many trees each of ``n`` rows is dealt, so that a tree has about ``sample`` of them or more."""
        return min(self.trees, -(-self.trees * self.sample // max(n, 1)))

    def fit(self, x: np.ndarray) -> IsolationForest:
        first, share = np.random.default_rng(self.seed).permutation(len(x)), self.share(len(x))
        dealt = (x[(t - first) % self.trees < share] for t in range(self.trees))
        return self.assemble([(len(rows), *self.tree(t, rows)) for t, rows in enumerate(dealt) if len(rows)])

    def tree(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, split, path) of the nodes of tree ``t`` grown on the rows ``x``, whatever their order."""
        nodes = 2 ** (self.depth + 1) - 1
        arrays = np.full(nodes, -1, np.int8), np.zeros(nodes), np.zeros(nodes)
        self._grow(np.random.default_rng([self.seed, t]), arrays, 0, 0, x)
        return arrays

    def _grow(self, rng: np.random.Generator, arrays, node: int, depth: int, x: np.ndarray) -> None:
        feature, split, path = arrays
        low, high = x.min(axis=0), x.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth == self.depth or not len(usable):
            path[node] = depth + _average_path(len(x))
            return
        f = rng.choice(usable)
        # below the largest value, so that neither side is empty
        s = min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f]))
        feature[node], split[node] = f, s
        below = x[:, f] <= s
        self._grow(rng, arrays, 2 * node + 1, depth + 1, x[below])
        self._grow(rng, arrays, 2 * node + 2, depth + 1, x[~below])

    def assemble(self, grown: list[tuple]) -> IsolationForest:
        """The forest of the trees that got rows, each as (number of rows, feature, split, path)."""
        rows, feature, split, path = zip(*grown)
        self.trees, self.rows = len(grown), np.array(rows)
        self.feature, self.split, self.path = np.array(feature, np.int8), np.array(split), np.array(path)
        self.norm = float(_average_path(self.rows.mean())) or 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][at]
                nxt = 2 * at + 1 + (x[rows, f] > self.split[t][at])
                at = np.where(f < 0, at, nxt)
            total += self.path[t][at]
        return 2.0 ** (-total / self.trees / self.norm)


def calibrate(score: np.ndarray, bad: np.ndarray, false_reject: float, rows: np.ndarray | None = None) -> tuple[float, float]:
    """(threshold, gain): the threshold of the best balanced accuracy among those that reject at most
    ``false_reject`` of the good rows, and the share of bad rows less that of good ones it rejects.
    Each score stands for ``rows`` rows (1)."""
    if not bad.any() or bad.all():
        return 1.0, 0.0
    rows = np.ones(len(score)) if rows is None else rows
    found, at = np.unique(score, return_inverse=True)
    levels = (found[1:] + found[:-1]) / 2

    def share_over(of):
        upto = np.cumsum(np.bincount(at, rows * of, len(found)))
        return (upto[-1] - upto[np.searchsorted(found, levels) - 1]) / upto[-1]

    wrong, right = share_over(~bad), share_over(bad)
    fits = wrong <= false_reject
    if not fits.any():
        return 1.0, 0.0
    best = np.argmax((right - wrong)[fits])
    return float(levels[fits][best]), float((right - wrong)[fits][best])


class Rules:
    """The forests and thresholds; ``judge`` gives (largest score, whether any threshold is exceeded)."""

    def __init__(self, forests: dict[str, IsolationForest], thresholds: dict[str, float]):
        self.forests, self.thresholds = forests, thresholds

    def judge(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = rates(stats)
        scores = {k: f.score(x[k]) for k, f in self.forests.items()}
        over = [s > self.thresholds[k] for k, s in scores.items()]
        return np.max(list(scores.values()), axis=0), np.any(over, axis=0)


def document_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The statistics of each document, after the ``keep`` columns; one pass, no shuffle."""
    keep_ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column("_data")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c) for c in stats.T)], names=[*keep, *STATS])

    return docs.select(*keep, F.col("text").cast("binary").alias("_data")).mapInArrow(run, keep_ddl + STATS_DDL)


def stats_array(table) -> np.ndarray:
    return np.column_stack([table.column(s).to_numpy(zero_copy_only=False) for s in STATS])


def grow(stats: DataFrame, trees: int = 100, sample: int = 256) -> dict[str, IsolationForest]:
    """The forests from all rows of ``stats``: a row goes by its hash to one tree, or the same number for all."""
    plan = IsolationForest(trees, sample)
    share = plan.share(stats.count())
    first = F.pmod(F.xxhash64("doc_id", *STATS), F.lit(trees))
    dealt = stats.select(F.explode(F.sequence(first, first + (share - 1))).alias("_at"), *STATS)
    dealt = dealt.select(F.pmod("_at", F.lit(trees)).cast("int").alias("tree"), *STATS)

    def run(batches):
        held = [(b.column("tree").to_numpy(), stats_array(b)) for b in batches]
        if held:
            at, rows = (np.concatenate(part) for part in zip(*held))
            for t in np.unique(at).tolist():
                x = rates(rows[at == t])
                grown = [(t, k, len(v), *(a.tolist() for a in plan.tree(t, v))) for k, v in x.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*grown), schema)], schema=schema)

    nodes = pa.list_(pa.float64())
    schema = pa.schema([("tree", pa.int32()), ("family", pa.string()), ("n", pa.int64()), ("feature", pa.list_(pa.int32())), ("split", nodes), ("path", nodes)])
    ddl = "tree int, family string, n long, feature array<int>, split array<double>, path array<double>"
    # by number: the trees are few, and small partitions of them would be merged into one
    found = sorted(dealt.repartition(trees, "tree").mapInArrow(run, ddl).collect())
    families = rates(np.zeros((0, len(STATS))))
    return {k: IsolationForest(trees, sample).assemble([r[2:] for r in found if r["family"] == k]) for k in families}


#: Thresholds are multiples of 1 / GRID, so that labelled rows can be counted by score, however many there are.
GRID = 2**16


def thresholds(known: DataFrame, forests: dict[str, IsolationForest], false_reject: float, least_gain: float) -> dict[str, float]:
    """A threshold for each family from all ``known`` rows (y 1 good, 0 bad); 1.0 where it isn't to reject."""

    def run(batches):
        for b in batches:
            x = rates(stats_array(b))
            at = (pa.array(np.ceil(f.score(x[k]) * GRID).astype(np.int32)) for k, f in forests.items())
            yield pa.RecordBatch.from_arrays([b.column("y"), *at], names=["y", *forests])

    left = materialize(known.select("y", *STATS).mapInArrow(run, "y int, " + ", ".join(f"{k} int" for k in forests)))

    def best(k: str, rate: float) -> tuple[float, float]:
        # no more rows than two for each point of the grid, whatever the corpus
        found = np.array(left.groupBy(k, "y").count().collect(), np.int64).reshape(-1, 3)
        threshold, gain = calibrate(found[:, 0] / GRID, found[:, 1] == 0, rate, found[:, 2])
        return np.floor(threshold * GRID) / GRID, gain

    gains, chosen = {k: best(k, false_reject)[1] for k in forests}, dict.fromkeys(forests, 1.0)
    for k in sorted(forests, key=lambda k: -gains[k]):
        threshold, gain = best(k, false_reject / len(forests))
        if gain >= least_gain:
            chosen[k] = threshold
            left = left.where(F.col(k) <= int(threshold * GRID))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, false_reject: float = 0.003, least_gain: float = 0.05) -> Rules | None:
    """The rules: trees from all documents that pass the base rules, thresholds from all of these with labels; None without both classes."""
    with scratch(docs.sparkSession):
        stats = document_statistics(docs, "doc_id")
        stats = materialize(stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))))
        y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        known = materialize(stats.join(y.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")), "doc_id"))
        if known.select("y").distinct().count() < 2:
            return None
        forests = grow(stats)
        return Rules(forests, thresholds(known, forests, false_reject, least_gain))


def judge(docs: DataFrame, labels: DataFrame, *keep: str, **fitting) -> DataFrame:
    """``keep`` columns, the statistics, base_failed, anomaly (0 to 1) and kept, a row per document."""
    rules = fit(docs, labels, **fitting)
    keep = keep or ("doc_id",)
    keep_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column("_data")], np.int64).reshape(-1, len(STATS))
            failed = base_failed(stats[:, 0], stats[:, 4])
            anomaly, odd = rules.judge(stats) if rules else (np.zeros(len(stats)), np.zeros(len(stats), bool))
            cols = [*(b.column(k) for k in keep), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(anomaly), pa.array(~failed & ~odd)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *STATS, "base_failed", "anomaly", "kept"])

    source = docs.select(*keep, F.col("text").cast("binary").alias("_data"))
    return source.mapInArrow(run, keep_ddl + STATS_DDL + ", base_failed boolean, anomaly double, kept boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    at = names.index("text")
    renamed = docs.toDF(*inner).withColumn("text", F.col(inner[at])).withColumn("doc_id", F.col(inner[names.index("doc_id")]))
    return judge(renamed, labels, *inner, **fitting).where("kept").select(*inner).toDF(*names)
