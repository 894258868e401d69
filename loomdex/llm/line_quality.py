"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank is a node with two labels, good and bad. A line is described by ``SHAPES``, measures of its bytes, words and copies cut
into bins; its score for "bad" is the sum of one weight for each of its own bins and for each bin of the line before and after it, and two
neighbours add a weight for their pair of labels. Forward and backward passes give each line's probability of being bad; a document's share of bad
text is their mean weighted by the lines' bytes, and its quality is a calibrated, falling function of that share.

Labels are known for documents only, so the field is fitted to what they say about lines: in a good document all lines are good, in a bad one not
all are. Both likelihoods, and their gradients, come exactly from the same two passes. Adam runs on the driver over a bounded sample: at most
``sample`` documents, drawn by hash among ids that have both label and text, half of each class where there are so many, of at most ``longest``
lines each (longer ones are only scored). Every text is scored whole on the executors, without a shuffle.

Defined cases: a text that is null, empty or blank has no line and gets the share of good labels; a doc_id with several labels takes their mean,
one with several texts the first of them; labels without a document, and null labels, are not used; with one class only every score is that class,
without any label it is 0.5; a null doc_id is not held out and takes no part in learning; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import blobs, crc_of_id, draw_ids, map_batches, slices

BINS = 16
SHAPES = ("bytes", "words", "letters", "upper", "digits", "points", "symbols", "spaces", "word", "repeated", "echoed", "first", "last", "copies")
LETTER, UPPER, DIGIT, POINT, SYMBOL, SPACE = range(6)
_KIND = np.full(256, SYMBOL, np.int64)
_KIND[[*range(97, 123), *range(128, 256)]] = LETTER
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[list(b".,;:!?'\"()-")] = POINT
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_SHARES = np.array([0.002, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.97])


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def shapes(lines: list[bytes]) -> np.ndarray:
    """The bins of each line of one text, a row of ``len(SHAPES)`` small numbers a line."""
    out = np.zeros((len(lines), len(SHAPES)), np.uint8)
    if not lines:
        return out
    size = np.array([len(x) for x in lines])
    kinds = _KIND[np.frombuffer(b"".join(lines), np.uint8)]
    at = np.repeat(np.arange(len(lines)) * 6, size)
    n = np.bincount(at + kinds, minlength=6 * len(lines)).reshape(-1, 6)
    ends = np.cumsum(size)
    split = [x.split() for x in lines]
    words = np.array([len(w) for w in split])
    distinct = np.array([len(set(w)) for w in split])
    echoes = np.array([sum(map(eq, w, w[1:])) for w in split])
    copies = Counter(lines)
    log2 = lambda x: np.minimum(np.log2(x + 1).astype(int), BINS - 1)
    share = lambda a, b: np.searchsorted(_SHARES, a / np.maximum(b, 1), side="right")
    columns = (
        log2(size), log2(words), share(n[:, LETTER] + n[:, UPPER], size), share(n[:, UPPER], n[:, LETTER] + n[:, UPPER]), share(n[:, DIGIT], size), share(n[:, POINT], size),
        share(n[:, SYMBOL], size), share(n[:, SPACE], size), np.minimum((size - n[:, SPACE]) // words, BINS - 1), share(words - distinct, words), share(echoes, words - 1),
        kinds[ends - size], kinds[ends - 1], log2(np.array([copies[x] for x in lines]) - 1),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass
class Chains:
    """Lines of many texts, one after another, in the order of falling length: then step t of all passes touches the first texts only."""

    codes: np.ndarray  # bins, a row a line
    count: np.ndarray  # lines of each text

    def __post_init__(self):
        self.start = np.cumsum(self.count) - self.count
        last = self.start + self.count - 1
        self.alive = [int(k) for k in np.searchsorted(-self.count, -np.arange(1, int(self.count.max(initial=0)) + 1), side="right")]
        width, n = len(SHAPES) * BINS, len(self.codes)
        own = self.codes + np.arange(len(SHAPES), dtype=np.int32) * BINS
        none = np.full((1, own.shape[1]), 3 * width, np.int32)  # the place of no neighbour
        before, after = np.concatenate([none, own[:-1] + width])[:n], np.concatenate([own[1:] + 2 * width, none])[:n]
        before[self.start], after[last] = 3 * width, 3 * width + 1
        self.features = np.concatenate([own, before, after], axis=1)

    #: One weight a bin of the line and of either neighbour, and one for having no line before, or none after.
    WIDTH = 3 * len(SHAPES) * BINS + 2


def passes(chains: Chains, bad: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of being bad, each text's expected pairs of labels (2 x 2), and each text's log of all labellings' sum.

    ``bad`` is each line's score for bad, ``pairs`` the scores of neighbours' labels, good first.
    """
    n, k = len(bad), len(chains.count)
    local = np.stack([1 / (1 + np.exp(np.clip(bad, -500, 500))), 1 / (1 + np.exp(-np.clip(bad, -500, 500)))], axis=1)
    step, start = np.exp(pairs), chains.start
    ahead, behind, scale = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
    for t, m in enumerate(chains.alive):
        at = start[:m] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ step) * local[at]
        scale[at] = c = a.sum(1)
        ahead[at] = a / c[:, None]
    expected = np.zeros((k, 2, 2))
    for t in range(len(chains.alive) - 1, 0, -1):
        m = chains.alive[t]
        at = start[:m] + t
        seen = local[at] * behind[at] / scale[at][:, None]
        expected[:m] += ahead[at - 1][:, :, None] * step * seen[:, None, :]
        behind[at - 1] = seen @ step.T
    total = np.log(scale) + np.logaddexp(0, bad)
    return (ahead * behind)[:, 1], expected, np.add.reduceat(total, start) if k else np.zeros(0)


class Field:
    """A fitted field with its calibration; ``weights`` is None where labels taught nothing and every text gets ``share``."""

    def __init__(self, share: float, weights: np.ndarray | None = None, pairs: np.ndarray | None = None, curve: tuple[float, float] = (0.0, 0.0)):
        self.share, self.weights, self.pairs, self.curve = share, weights, pairs, curve

    def line_marginals(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its lines' probabilities of being bad, and their bytes."""
        split = [lines_of(t) for t in texts]
        sizes = [np.array([len(x) for x in s], float) for s in split]
        order = sorted((i for i, s in enumerate(split) if s), key=lambda i: -len(split[i]))
        out = [(np.zeros(0), s) for s in sizes]
        if order:
            chains = Chains(np.concatenate([shapes(split[i]) for i in order]), np.array([len(split[i]) for i in order]))
            bad = passes(chains, self.weights[chains.features].sum(1), self.pairs)[0]
            for i, at, n in zip(order, chains.start.tolist(), chains.count.tolist(), strict=True):
                out[i] = (bad[at : at + n], sizes[i])
        return out

    def score(self, texts: list[bytes]) -> tuple[list[float], list[float]]:
        """Quality of each text, and its share of bad text (null-like texts: 0)."""
        if self.weights is None:
            return [self.share] * len(texts), [0.0] * len(texts)
        found = self.line_marginals(texts)
        bad = [float(p @ n / n.sum()) if len(p) else 0.0 for p, n in found]
        return [quality_of(b, self.curve) if len(p) else self.share for b, (p, _) in zip(bad, found, strict=True)], bad


def _logit(share):
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def quality_of(bad: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(curve[0] - curve[1] * _logit(bad), -60, 60))))


def calibrate(bad: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the logit of the bad share, by Newton steps; the slope never turns round."""
    x, w, theta = np.stack([np.ones(len(bad)), -_logit(bad)], axis=1), weight / weight.sum(), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        grad = x.T @ (w * (p - good)) + ridge * theta
        move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), grad)
        theta = theta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(max(theta[1], 0.0))


def gradient(chains: Chains, good: np.ndarray, weights: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the documents' labels and its gradients: all lines good, or not all good."""
    marginal, expected, total = passes(chains, weights[chains.features].sum(1), pairs)
    all_good = np.minimum((chains.count - 1) * pairs[0, 0] - total, -1e-9)  # log of its probability
    none = np.log(-np.expm1(all_good))
    pull = np.where(good, -1.0, np.exp(all_good - none))
    by_line = np.repeat(pull, chains.count) * marginal
    at = np.bincount(chains.features.ravel(), weights=np.repeat(by_line, chains.features.shape[1]), minlength=Chains.WIDTH)
    expected[:, 0, 0] -= chains.count - 1
    return float(np.where(good, all_good, none).sum()), at, (pull[:, None, None] * expected).sum(0)


def fit(codes: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray, share: float, steps: int = 240, rate: float = 0.05, ridge: float = 0.5) -> Field:
    """A field from the bins and sizes of each document's lines, the documents' labels, and the share of good ones among all labels.

    In the first half of the steps lines speak for themselves; then neighbours join, held back by a stronger ridge. Otherwise the blame for a bad
    line could as well fall on the one beside it, for the documents' labels don't tell them apart.
    """
    filled = np.array([len(c) > 0 for c in codes], bool)
    if not filled.any() or good[filled].all() or not good[filled].any():
        return Field(share)
    order = [i for i in sorted(range(len(codes)), key=lambda i: -len(codes[i])) if filled[i]]
    chains = Chains(np.concatenate([codes[i] for i in order]), np.array([len(codes[i]) for i in order]))
    good = good[order]
    theta = np.zeros(Chains.WIDTH + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    own = np.arange(len(theta)) < len(SHAPES) * BINS
    held = ridge * np.where(own, 1.0, 10.0)
    for t in range(1, steps + 1):
        _, at, pairs = gradient(chains, good, theta[:-4], theta[-4:].reshape(2, 2))
        grad = (np.concatenate([at, pairs.ravel()]) - held * theta) / len(order)
        if 2 * t <= steps:
            grad *= own
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    weights, pairs = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    marginal, _, _ = passes(chains, weights[chains.features].sum(1), pairs)
    size = np.concatenate([sizes[i] for i in order]).astype(float)
    bad = np.add.reduceat(marginal * size, chains.start) / np.add.reduceat(size, chains.start)
    back = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    return Field(share, weights, pairs, calibrate(bad, good.astype(float), back))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6_000, longest: int = 400, **options) -> Field:
    """A field from the quality labels of ids that are not held out."""
    own = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    picked, have = draw_ids(docs, own, sample)

    def run(batches):
        for b in slices(batches, "text"):
            split = [lines_of(t) for t in blobs(b.column("text"))]
            codes = [shapes(s).tobytes() if len(s) <= longest else None for s in split]
            sizes = [np.array([len(x) for x in s], np.int32).tobytes() for s in split]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(codes, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "y", "codes", "sizes"])

    got = map_batches(picked, run, "doc_id long, y int, codes binary, sizes binary").where("codes is not null").toArrow().sort_by("doc_id")
    if not (total := sum(have.values())):
        return Field(0.5)
    codes = [np.frombuffer(x, np.uint8).reshape(-1, len(SHAPES)) for x in got.column("codes").to_pylist()]
    sizes = [np.frombuffer(x, np.int32) for x in got.column("sizes").to_pylist()]
    return fit(codes, sizes, got.column("y").to_numpy() == 1, have.get(1, 0) / total, **options)


def score(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and bad_share (of its text) for every document."""

    def run(batches):
        for b in slices(batches, "text"):
            s, bad = field.score(blobs(b.column("text")))
            columns = [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array(bad, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "bad_share"])

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int, bad_share double")


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (its number from 0 among the text's lines that are not blank), bad_probability and good for every line of every document."""

    def run(batches):
        for b in slices(batches, "text"):
            found = field.line_marginals(blobs(b.column("text"))) if field.weights is not None else [(np.zeros(0), None)] * b.num_rows
            n = np.array([len(p) for p, _ in found])
            ids = b.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            p = np.concatenate([p for p, _ in found]) if len(found) else np.zeros(0)
            at = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(p, pa.float64()), pa.array(p < 0.5, pa.bool_())], ["doc_id", "line", "bad_probability", "good"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, line int, bad_probability double, good boolean")
