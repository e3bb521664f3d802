"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features, with those of its neighbours, give its own weight;
a matrix of transitions ties neighbouring labels. Forward-backward gives each line's
probability of being good; weighted by the lines' lengths these make the document's quality,
which a logistic step on labelled rows turns into the score.

The fit takes at most ``rows`` labelled documents a class. Lines have no labels of their own: they are
latent, and the field is fitted to the documents' labels through the marginals, so that a bad
document may hold good lines and transitions learn where labels change. Scoring takes every
line of every text, in one pass without a shuffle.

Defined results: a document without doc_id is scored like any other; null, empty and blank texts have no line to judge and score the share of
good rows among the labelled ones (0.5 without labels); equal texts score alike; a single
long line is a chain of one; without labels of both classes every score is that share; an
empty table gives an empty result. Columns beyond doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, labelled_share
from .toxicity import logistic_scale

SYMBOLS, UPPER, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
BASE = 10


def line_features(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    for line in (data or b"").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        rows.append((
            np.log1p(n) / 8,
            (n - len(line.translate(None, SYMBOLS))) / n,
            (n - len(line.translate(None, UPPER))) / n,
            line.count(b"!") / n,
            (n - len(line.translate(None, DIGITS))) / n,
            1 - len(set(words)) / k,
            sum(map(bytes.__eq__, words, words[1:])) / k,
            n / k / 20,
            float(line in seen),
            float(words[-1][-1:] in (b".", b"!", b"?")),
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, float).reshape(-1, BASE), np.array(sizes, float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features beside those of the line before and after, whether there are such lines, and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edges = np.zeros((n, 3))
    if n:
        edges[0, 0] = edges[-1, 1] = 1
    edges[:, 2] = 1
    return np.hstack([own, before, after, edges])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _products(m: np.ndarray) -> np.ndarray:
    """Running log products of 2 x 2 log matrices along axis 1, in about log2(lines) passes."""
    m, step = m.copy(), 1
    while step < m.shape[1]:
        m[:, step:] = np.logaddexp(m[:, :-step, :, :1] + m[:, step:, :1, :], m[:, :-step, :, 1:] + m[:, step:, 1:, :])
        step *= 2
    return m


def forward_backward(unary: np.ndarray, length: np.ndarray, trans: np.ndarray, expect: bool = True, loop: int = 256):
    """(probability of good per line, expected transitions) of chains padded to one length.

    ``unary``: chains x lines, the log odds of good; labels are 0 bad, 1 good. Up to ``loop`` lines go one
    by one, longer chains by running products. Without ``expect`` the transitions are None.
    """
    chains, lines = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], axis=2)
    mask = np.arange(lines) < length[:, None]
    alpha, beta = np.zeros((chains, lines, 2)), np.zeros((chains, lines, 2))
    alpha[:, 0] = emit[:, 0]
    if lines > loop:
        # beyond a chain's end the identity
        m = np.where(mask[:, 1:, None, None], trans + emit[:, 1:, None, :], np.where(np.eye(2) > 0, 0, -1e30))
        alpha[:, 1:] = _logsumexp(alpha[:, :1, :, None] + _products(m), 2)
        beta[:, :-1] = _logsumexp(_products(m[:, ::-1].swapaxes(2, 3))[:, ::-1], 2)
    else:
        for t in range(1, lines):
            step = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where((t < length)[:, None], step, alpha[:, t - 1])
        for t in range(lines - 2, -1, -1):
            step = _logsumexp(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t + 1 < length)[:, None], step, 0)
    good = np.where(mask, 1 / (1 + np.exp(np.clip((alpha + beta)[:, :, 0] - (alpha + beta)[:, :, 1], -50, 50))), 0)
    if not expect:
        return good, None
    z = _logsumexp(alpha[:, -1], 1)
    if lines > 1:
        both = alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
    else:
        expected = np.zeros((2, 2))
    return good, expected


def document_gradient(theta: np.ndarray, pad: np.ndarray, length: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss of documents' labels under their length-weighted marginals, and its gradient.

    ``theta``: line weights, four transitions, and slope and intercept from a document's marginals to its log odds.
    The gradient of the weighted marginals q is a covariance under the field, which equals the change of the expected
    features when the lines' log odds move by their weights: two more passes, no matter how many parameters.
    """
    trans, (slope, shift) = theta[-6:-2].reshape(2, 2), theta[-2:]
    unary = pad @ theta[:-6]
    p, _ = forward_backward(unary, length, trans, expect=False)
    q = 4 * (p * weight).sum(axis=1) - 2
    z = np.clip(slope * q + shift, -30, 30)
    chance = 1 / (1 + np.exp(-z))
    loss = (np.logaddexp(0, z) - y * z).sum()
    push = ((chance - y) * 4 * slope)[:, None] * weight
    eps = 1e-3 / max(np.abs(push).max(), 1e-12)
    up, up_trans = forward_backward(unary + eps * push, length, trans)
    down, down_trans = forward_backward(unary - eps * push, length, trans)
    field = np.concatenate([np.einsum("ct,ctf->f", up - down, pad), (up_trans - down_trans).ravel()]) / (2 * eps)
    return loss, np.concatenate([field, [(chance - y) @ q, (chance - y).sum()]])


class LineCrf:
    def __init__(self):
        self.weights, self.trans = np.zeros(3 * BASE + 3), np.zeros((2, 2))
        self.mean, self.spread = np.zeros(BASE), np.ones(BASE)
        self.scale, self.shift, self.share, self.fitted = 1.0, 0.0, 0.5, False

    def _chains(self, own: list[np.ndarray]):
        """Chains grouped by length class, each group padded: (indexes, unary features, lengths)."""
        order = sorted(range(len(own)), key=lambda i: len(own[i]))
        groups: dict[int, list[int]] = {}
        for i in order:
            if len(own[i]):
                groups.setdefault(len(own[i]).bit_length(), []).append(i)
        for members in groups.values():
            yield np.array(members), np.array([len(own[i]) for i in members])

    def fit(self, own: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> None:
        """Adam on the documents' log loss; the lines' labels are latent."""
        stacked = np.vstack(own)
        self.mean, self.spread = stacked.mean(axis=0), stacked.std(axis=0) + 1e-6
        groups = []
        for members, length in self._chains(own):
            pad, weight = np.zeros((len(members), length.max(), 3 * BASE + 3)), np.zeros((len(members), length.max()))
            for row, i in enumerate(members):
                pad[row, : length[row]] = with_neighbours((own[i] - self.mean) / self.spread)
                weight[row, : length[row]] = sizes[i] / sizes[i].sum()
            groups.append((pad, length, weight, good[members]))
        theta = np.zeros(len(self.weights) + 6)
        theta[-2] = 2.0  # log odds from -4 to 4 to begin with
        held = np.concatenate([np.full(len(theta) - 2, decay), [0, 0]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            grad = held * theta + sum(document_gradient(theta, *g)[1] for g in groups) / len(own)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.trans, self.fitted = theta[:-6], theta[-6:-2].reshape(2, 2), True

    def quality(self, own: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good, nan without lines."""
        out = np.full(len(own), np.nan)
        for members, length in self._chains(own):
            # chains of a length class go in blocks of about a million lines
            step = max(1, 1_000_000 // length.max())
            for i in range(0, len(members), step):
                part, n = members[i : i + step], length[i : i + step]
                unary, weight = np.zeros((len(part), n.max())), np.zeros((len(part), n.max()))
                for row, k in enumerate(part):
                    unary[row, : n[row]] = with_neighbours((own[k] - self.mean) / self.spread) @ self.weights
                    weight[row, : n[row]] = sizes[k]
                p, _ = forward_backward(unary, n, self.trans, expect=False)
                out[part] = (p * weight).sum(axis=1) / weight.sum(axis=1)
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        lines = [line_features(t) for t in texts]
        q = self.quality([a for a, _ in lines], [b for _, b in lines])
        s = 1 / (1 + np.exp(-np.clip(self.scale * (4 * q - 2) + self.shift, -30, 30)))
        return np.where(np.isnan(q), self.share, s)


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, rows: int = 1200, max_chars: int = 20_000) -> LineCrf:
    """The field from at most ``rows`` labelled documents a class of up to ``max_chars`` characters."""
    sample = sorted((r["text"], r["y"]) for r in labelled_sample(docs, labels, "quality", rows, max_chars, learn_from).toLocalIterator())
    model = LineCrf()
    share = labelled_share(labels, "quality", learn_from)
    model.share = 0.5 if share is None else share
    lines = [(*line_features((t or "").encode()), y) for t, y in sample]
    lines = [x for x in lines if len(x[0])]
    y = np.array([x[2] for x in lines], float)
    if not len(y) or y.min() == y.max():
        return model
    model.fit([x[0] for x in lines], [x[1] for x in lines], y)
    q = model.quality([x[0] for x in lines], [x[1] for x in lines])
    # the sample has as many rows of both classes; weights bring back their shares
    weight = np.where(y == 1, model.share / y.mean(), (1 - model.share) / (1 - y.mean()))
    model.scale, model.shift = logistic_scale(4 * q - 2, y, weight)
    return model


def score(docs: DataFrame, labels: DataFrame, *keep: str, learn_from=None, **fitting) -> DataFrame:
    """``keep`` columns and score, a row per document."""
    model = fit(docs, labels, learn_from, **fitting)
    keep = keep or ("doc_id",)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                scores = pa.array(model.score([t.as_py() for t in b.column("_data")]), pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), scores], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_data")).mapInArrow(run, ddl + "score double")
