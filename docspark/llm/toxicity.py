"""Toxicity scores by weak supervision.

Voters: words of a fixed lexicon; lexicon entries mined from labelled rows (words and word
beginnings that occur, or that make up a hundredth of the words, far more often in toxic ones);
and patterns (many insults for the length, an insult near "you", none at all). From the votes
alone, over labelled and unlabelled documents alike, a generative label model estimates by
expectation maximisation the share of toxic documents, which voters are correlated within the
classes, and how often and how many of a group of correlated voters fire on either class. Its
posteriors train a linear classifier, whose features are picked by their association with
the posteriors. Labels are used in two places only: to mine lexicon entries, and in a
last logistic step, over the classifier's margin and the insults' count and density, that fixes the scale of the score.

Only the text is an input of a score. The fit takes at most ``rows`` documents a class, of
rows whose labels may be used, and ``unlabelled`` others; its features and voters are bounded by parameters, so what
executors get doesn't grow with the corpus. Scoring is one pass without a shuffle.

Defined results: null and empty texts score what a text without any term scores; equal texts
score alike; a null doc_id is scored like any other; without labels of both classes the score comes from the fixed lexicon alone;
an empty table gives an empty result. Columns beyond doc_id and text are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, labelled_share

#: Insults in four languages, whole words.
LEXICON = tuple(
    """idiot idiots idiotic moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting
    clown fool imbecile cretin jerk bastard bitch asshole crap shit fuck fucking whore slut pig vermin filth
    dumm dummkopf trottel arschloch abschaum dreckskerl widerlich wertlos hurensohn schlampe
    idiote imbécile crétin connard salope ordure dégoûtant minable abruti pute
    idiota imbécil estúpido cretino basura asqueroso patético puta cabrón escoria""".split()
)
SECOND_PERSON = frozenset("you your youre u du dich ihr tu toi vous te tú ti usted".split())
_words = re.compile(r"[^\W\d_]+").findall


def terms_of(text: str | None) -> tuple[Counter, list[str]]:
    words = _words((text or "").lower())
    return Counter(words), words


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings of 4 to 6 letters."""
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n))


def dense_from(words: int) -> float:
    """How often a term must occur in a text of so many words to be dense in it."""
    return max(2.0, 0.01 * words)


class Model:
    """A linear classifier over features: ``term`` (occurs) and ``term#`` (is dense), and three numbers."""

    def __init__(self, vocabulary: dict[str, int], voters: set[str]):
        self.vocabulary = vocabulary
        self.insults = {v.removesuffix("#") for v in voters}
        self.bases = list(dict.fromkeys(f.removesuffix("#") for f in vocabulary))
        self.base_at = {f: i for i, f in enumerate(self.bases)}
        self.occurs = [vocabulary.get(f, -1) for f in self.bases]
        self.dense = [vocabulary.get(f + "#", -1) for f in self.bases]
        self.weights = np.zeros(len(vocabulary) + 3)
        self.bias, self.scale, self.lean, self.shift = 0.0, 1.0, np.zeros(3), 0.0
        self.known: dict[str, tuple] = {}

    def _look_up(self, word: str) -> tuple[tuple[int, ...], bool]:
        """Terms of a word in the vocabulary and whether it is an insult by any voter; remembered for many words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            every = features_of(word)
            found = self.known[word] = (tuple(self.base_at[f] for f in every if f in self.base_at), any(f in self.insults for f in every))
        return found

    def row(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Present features, and three numbers: log count of insults, their density, an insult near 'you'."""
        counts, words = terms_of(text)
        times, insults, hits = {}, 0, set()
        for w, n in counts.items():
            found, insult = self._look_up(w)
            for i in found:
                times[i] = times.get(i, 0) + n
            if insult:
                insults += n
                hits.add(w)
        near = 0
        if hits and not SECOND_PERSON.isdisjoint(counts):
            near = any(w in hits and not SECOND_PERSON.isdisjoint(words[max(0, i - 3) : i + 4]) for i, w in enumerate(words))
        least = dense_from(len(words))
        present = {self.occurs[i] for i in times} | {self.dense[i] for i, n in times.items() if n >= least}
        return sorted(present - {-1}), np.array([np.log1p(insults), min(1.0, 20 * insults / (len(words) + 1)), float(near)])

    def margin(self, present, numbers) -> float:
        return float(self.weights[present].sum() + self.weights[-3:] @ numbers + self.bias)

    def score(self, text: str | None) -> float:
        present, numbers = self.row(text)
        z = self.scale * self.margin(present, numbers) + self.lean @ numbers + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def correlated_groups(votes: np.ndarray, post: np.ndarray, least: float = 0.1) -> np.ndarray:
    """A group number for each voter: those whose votes correlate by ``least`` within the classes go together.

    The correlation is what the firing rates of either class leave unexplained.
    """
    on = post @ votes / max(post.sum(), 1e-9)
    off = (1 - post) @ votes / max((1 - post).sum(), 1e-9)
    left = votes - post[:, None] * on - (1 - post)[:, None] * off
    cov = left.T @ left
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    tied = cov / np.outer(spread, spread) > least
    group = np.arange(len(tied))
    while True:
        low = np.where(tied | np.eye(len(tied), dtype=bool), group, len(tied)).min(axis=1)
        if (low == group).all():
            return group
        group = low


def group_evidence(count: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Log odds of the toxic class from how many of a group's voters fire, 0 where none does.

    Either class has a share of documents in which the group fires, and beyond the first voter a negative binomial
    count of shape 2 there, so that rare counts take their odds from the shape of frequent ones. A group's
    silence is left to the clean voter: lexicon entries of one language say nothing about texts of another.
    """
    fires = count > 0
    if not fires.any():
        return np.zeros(len(count))
    # one document more in either class, in which it fires as often as in all
    share, more = np.zeros(2), np.zeros(2)
    for c, p in enumerate((1 - post, post)):
        among = p[fires].sum()
        share[c] = (among + fires.mean()) / (p.sum() + 1)
        extra = p[fires] @ (count[fires] - 1)
        more[c] = (extra + 0.1) / (extra + 2 * among + 2.1)
    shape = 2 * np.log((1 - more[1]) / (1 - more[0])) + (count - 1) * np.log(more[1] / more[0])
    return np.where(fires, np.log(share[1] / share[0]) + shape, 0)


def label_model(votes: np.ndarray, rounds: int = 40, pooled: int = 5, settle: int = 15, unseen: float = 0.02) -> np.ndarray:
    """Posterior of the toxic class from votes alone (1 fires, 0 doesn't; the last column is a vote for clean).

    Expectation maximisation of a generative model: every round estimates the share of toxic documents, which voters are
    correlated within the classes (all of them for the first ``pooled`` rounds, anew until round ``settle``), and how often and how many of a group of correlated voters fire on
    either class. Groups are independent given the class; the clean voter stands alone. How many toxic documents no
    voter sees can't be told from votes: ``unseen`` is their assumed share. A voter that never fires with another one can't
    be told to be right either: documents with a single vote start as rather clean and stay so unless others speak for it.
    """
    votes = np.asarray(votes, float)
    hits = votes[:, :-1].sum(axis=1)
    post = np.where(hits >= 2, 0.95, np.where(hits == 1, 0.1, 0.02))
    for i in range(rounds):
        prior = (post.sum() + 1) / (len(votes) + 2)
        if i < settle:
            group = correlated_groups(votes[:, :-1], post) if i >= pooled else np.zeros(votes.shape[1] - 1, int)
        counts = [votes[:, :-1][:, group == g].sum(axis=1) for g in np.unique(group)]
        silent = np.log(unseen / (((1 - post) @ votes[:, -1] + 0.5) / ((1 - post).sum() + 1)))
        odds = np.log(prior / (1 - prior)) + sum(group_evidence(c, post) for c in counts) + silent * votes[:, -1]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = i > pooled and np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post


def association(with_class: np.ndarray, either: np.ndarray, in_class: float, total: float) -> np.ndarray:
    """Signed chi-square of presence against a class, from counts (or sums of posteriors)."""
    gap = with_class * (total - in_class) - (either - with_class) * in_class
    return np.sign(gap) * gap**2 * total / np.maximum(either * (total - either) * in_class * (total - in_class), 1)


def _train(model: Model, rows, target: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> None:
    """Logistic regression on soft targets by Adam over the sparse rows."""
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    cols = np.concatenate([np.asarray(p, np.int64) for p, _ in rows]) if len(at) else np.empty(0, np.int64)
    numbers = np.array([x for _, x in rows])
    size, total = len(model.weights), weight.sum()
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, theta[cols], len(rows)) + numbers @ theta[size - 3 : size] + theta[size]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / total
        grad = np.concatenate([np.bincount(cols, err[at], size - 3), err @ numbers, [err.sum()]])
        grad[:size] += decay * theta[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = theta[:size], float(theta[size])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and intercept of a logistic regression on a few inputs, by damped Newton steps; the first slope rests at 1."""
    x = np.column_stack([x, np.ones(len(y))])
    rest = np.zeros(x.shape[1])
    rest[0] = 1.0
    theta = rest.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ ((p - y) * weight) + ridge * (theta - rest)
        step = np.linalg.solve((x * (p * (1 - p) * weight)[:, None]).T @ x + ridge * np.eye(len(theta)), grad)
        theta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def logistic_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of a one-variable logistic regression."""
    slope, shift = logistic(x, y, weight)
    return max(float(slope), 0.05), float(shift)


def train(texts: list[str], y: np.ndarray, share: float | None = None, features: int = 3000, mined: int = 120) -> Model:
    """The model from texts and labels (1 toxic, 0 clean, nan unknown); ``share`` of labelled rows are toxic where the sample's share isn't theirs."""
    lexicon = Model({w: i for i, w in enumerate(LEXICON)}, set(LEXICON))
    lexicon.weights[-3], lexicon.bias = 3.0, -2.5
    known = ~np.isnan(y)
    if not known.any() or y[known].min() == y[known].max():
        return lexicon
    number: dict[str, int] = {}
    have = []
    for t in texts:
        counts, words = terms_of(t)
        times: Counter = Counter()
        for w, n in counts.items():
            for f in features_of(w):
                times[f] += n
        least = dense_from(len(words))
        every = [number.setdefault(f, len(number)) for f in times]
        every += [number.setdefault(f + "#", len(number)) for f, n in times.items() if n >= least]
        have.append(np.array(every, np.int32))
    names, size = list(number), len(number)

    def counted(rows, weight=None):
        at = np.concatenate([have[i] for i in rows]) if len(rows) else np.empty(0, np.int32)
        return np.bincount(at, None if weight is None else np.repeat(weight, [len(have[i]) for i in rows]), size)

    # mined lexicon entries: chance associations of rare terms stay below the limits
    toxic, clean = counted(np.flatnonzero(y == 1)), counted(np.flatnonzero(y == 0))
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    chi = association(toxic, toxic + clean, n1, n0 + n1)
    strong = np.flatnonzero((toxic >= 3) & (chi > 20) & (toxic * n0 > 20 * clean * n1))
    strong = sorted((names[i] for i in strong), key=lambda f: (-chi[number[f]], f))
    voters = [w for w in LEXICON if w in number and toxic[number[w]] + clean[number[w]] >= 2]
    voters += [f for f in strong if f not in LEXICON][:mined]
    insults = set(LEXICON) | set(voters)
    # the label model sees votes only
    at = {number[f]: i for i, f in enumerate(voters)}
    fires = np.zeros((len(texts), len(voters)))
    for row, every in enumerate(have):
        for i in every.tolist():
            if i in at:
                fires[row, at[i]] = 1
    patterns = Model({}, insults)
    numbers = np.array([patterns.row(t)[1] for t in texts])
    several = np.column_stack([numbers[:, 1] > 0.2, numbers[:, 2] > 0, numbers[:, 0] == 0])
    posterior = label_model(np.hstack([fires, several]))
    every = np.arange(len(texts))
    either, with_class = counted(every), counted(every, posterior)
    chi = association(with_class, either, posterior.sum(), float(len(texts)))
    chosen = sorted((names[i] for i in np.flatnonzero((either >= 4) & (np.abs(chi) > 20))), key=lambda f: (-abs(chi[number[f]]), f))[:features]
    model = Model({f: i for i, f in enumerate(dict.fromkeys([*voters, *LEXICON, *chosen]))}, insults)
    built = [model.row(t) for t in texts]
    _train(model, built, posterior, np.ones(len(texts)), decay=1 / len(texts) + 1e-4)
    judged = np.array([[model.margin(*r), *r[1]] for r, k in zip(built, known) if k])
    share = n1 / (n0 + n1) if share is None else share
    weight = np.where(y[known] == 1, share / n1, (1 - share) / n0) * known.sum()
    model.scale, *lean, model.shift = logistic(judged, y[known], weight).tolist()
    model.lean = np.array(lean)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, rows: int = 2500, unlabelled: int = 2500, max_chars: int = 30_000, **how) -> Model:
    """The model from at most ``rows`` documents a class and ``unlabelled`` others, of up to ``max_chars`` characters."""
    found = labelled_sample(docs, labels, "toxic", rows, max_chars, learn_from, unlabelled).toLocalIterator()
    sample = sorted((r["text"], 2 if r["y"] is None else r["y"]) for r in found)
    y = np.array([b for _, b in sample], float)
    return train([t for t, _ in sample], np.where(y == 2, np.nan, y), labelled_share(labels, "toxic", learn_from), **how)


def score(docs: DataFrame, labels: DataFrame, *keep: str, learn_from=None, **fitting) -> DataFrame:
    """``keep`` columns and score, a row per document."""
    model = fit(docs, labels, learn_from, **fitting)
    keep = keep or ("doc_id",)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column("_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), scores], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ddl + "score double")
