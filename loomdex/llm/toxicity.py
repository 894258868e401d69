"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings of 4 to 7 bytes (so inflected forms meet), hashed to ``2**BITS``. The
machine scores sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>): a term can count on its own, and a pair, such as an insult with the
mention of a group, can count for more or less than its two terms, which additive weights can't say. Presence counts, not frequency, so one
insult in a very long text weighs as much as in a short one.

Learning uses a bounded sample of labelled rows (``sample`` parameter; ids by hash, positives up to a third of it, weighted back to their
share; of rows that repeat an id the first text counts), keeps the ``features`` terms whose presence tells most about the label, and with them the terms
that tell nothing alone but much beside another term (``paired``), and trains on the driver. Every text is scored whole on the executors. The sampled ids are broadcast: at most about ``sample`` pairs of numbers.

Defined cases: null or empty text is scored by w0 alone; a doc_id with several labels takes their mean; labels without a document, and null
labels, are not used; without any usable label, or with only one class, every score is that class's share (0 without labels); a null doc_id is
not held out and takes no part in learning; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import blobs, crc_of_id, draw_ids, map_batches, slices

BITS, BEGINNINGS = 20, (4, 5, 6, 7)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CACHE_WORDS = 1 << 16


def _hashes(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (zlib.crc32(word) & mask, *(zlib.crc32(word[:k] + b"^") & mask for k in BEGINNINGS if len(word) > k))


def words(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.decode().lower().encode()))


def terms(text: bytes) -> set[int]:
    """Hashed terms of a text."""
    return {h for w in words(text) for h in _hashes(w)}


class Machine:
    """A trained machine: hashed terms by index, weights and factors."""

    def __init__(self, keys: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index = {int(k): i for i, k in enumerate(keys)}
        self.bias, self.weights, self.factors = bias, weights, factors
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _features(self, word: bytes) -> tuple[int, ...]:
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(self.index[h] for h in _hashes(word) if h in self.index)
        return found

    def score(self, text: bytes) -> float:
        on: set[int] = set()
        known = self.known
        for w in words(text):
            f = known.get(w)
            on.update(self._features(w) if f is None else f)
        raw = self.bias
        if on:
            at = np.array(sorted(on))
            v = self.factors[at]
            raw += self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -60, 60))))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _gain(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of terms that a of n1 and b of n0 rows have."""

    def ll(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (a + b) / max(n1 + n0, 1)
    return 2 * (ll(a, n1, a / max(n1, 1)) + ll(b, n0, b / max(n0, 1)) - ll(a, n1, both) - ll(b, n0, both))


def _count(rows: list[np.ndarray], pick: np.ndarray) -> np.ndarray:
    total = np.zeros(1 << BITS)
    for at in range(0, len(pick), 256):
        total += np.bincount(np.concatenate([rows[i] for i in pick[at : at + 256]]), minlength=len(total))
    return total


def informative(rows: list[np.ndarray], y: np.ndarray, most: int, least_rows: int = 3, least_gain: float = 10.0) -> np.ndarray:
    """The terms whose presence is most dependent on the label (log-likelihood ratio), at most ``most``."""
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = _count(rows, pos), _count(rows, neg)
    gain = _gain(a, b, len(pos), len(neg))
    gain[a + b < least_rows] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] >= least_gain]


def least_support(n1: int, n0: int, least_gain: float) -> int:
    """The fewest rows a term must have to tell ``least_gain`` of n1 and n0 rows: the gain is convex, so largest where all of its rows have one label."""
    n = np.arange(1, n1 + n0)
    a = np.minimum(n, n1), np.maximum(n - n0, 0)
    enough = np.maximum(*(_gain(x, n - x, n1, n0) for x in a)) >= least_gain
    return int(n[enough][0]) if enough.any() else n1 + n0


def paired(rows: list[np.ndarray], y: np.ndarray, alone: np.ndarray, most: int, conditions: int = 512, least_rows: int = 3, least_gain: float = 30.0) -> np.ndarray:
    """Terms outside ``alone`` that depend on the label among the rows of another term, and those other terms, at most ``most``.

    The other terms are a quarter of ``conditions`` from ``alone``, best first, and for the rest the most frequent terms that at most a fifth of the rows
    have. The least gain is that of one chance in 25 millions, about as many as there are tests.
    """
    support = _count(rows, np.arange(len(rows)))
    middle = np.flatnonzero((support >= 4 * least_rows) & (support <= max(len(rows) // 5, 4 * least_rows)))
    middle = middle[np.argsort(-support[middle], kind="stable")][: conditions - conditions // 4]
    given = list(dict.fromkeys([*alone[: conditions // 4].tolist(), *middle.tolist()]))
    kept = np.flatnonzero(support >= least_rows)
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    own = [p[p >= 0].astype(np.int32) for p in (number[r] for r in rows)]
    of: dict[int, list[int]] = {k: [] for k in number[given].tolist()}
    wanted = np.zeros(len(kept) + 1, bool)
    wanted[list(of)] = True
    for i, r in enumerate(own):
        for k in r[wanted[r]].tolist():
            of[k].append(i)
    best = np.zeros(len(kept))
    for s, at in of.items():
        toxic = int(y[at].sum())
        a, b = (np.bincount(np.concatenate([own[i] for i in at if y[i] == c] or [own[0][:0]]), minlength=len(kept)) for c in (1, 0))
        n = a + b
        may = np.flatnonzero((n >= max(least_rows, least_support(toxic, len(at) - toxic, least_gain))) & (n < len(at)))
        gain = _gain(a[may], b[may], toxic, len(at) - toxic)
        may, gain = may[gain >= least_gain], gain[gain >= least_gain]
        best[may] = np.maximum(best[may], gain)
        best[s] = max(best[s], gain.max(initial=0.0))
    best, at_place = np.zeros(1 << BITS), best
    best[kept] = at_place
    best[alone] = 0
    found = np.argsort(-best, kind="stable")[:most]
    return found[best[found] > 0]


class _Part:
    """Some rows' terms, ready for sums by row and by term."""

    def __init__(self, own: list[np.ndarray], width: int):
        self.row, self.col = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([*own, np.zeros(0, int)]).astype(int)
        self.order = np.argsort(self.col, kind="stable")
        self.starts, self.used = np.searchsorted(self.col[self.order], np.arange(width)), (np.bincount(self.col, minlength=width) > 0)[:, None]
        self.by_row, self.filled = np.searchsorted(self.row, np.arange(len(own))), (np.bincount(self.row, minlength=len(own)) > 0)[:, None]

    @staticmethod
    def sums(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.vstack([x, np.zeros((1, x.shape[1]))]), np.minimum(at, len(x)), axis=0) * n

    def gradient(self, theta: np.ndarray, bias: float, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        rank = theta.shape[1] - 1
        x = theta[self.col]
        total = self.sums(np.hstack([x, x[:, 1:] ** 2]), self.by_row, self.filled)
        z = bias + total[:, 0] + 0.5 * (total[:, 1 : rank + 1] ** 2 - total[:, rank + 1 :]).sum(1)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        e = err[self.row][:, None]
        return self.sums(np.hstack([e, e * (total[self.row, 1 : rank + 1] - x[:, 1:])])[self.order], self.starts, self.used), float(err.sum())


def fit(
    rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, features: int = 4096, rank: int = 4, steps: int = 320, rate: float = 0.05, l2: float = 1e-3, part_rows: int = 1000, seed: int = 7
) -> Machine:
    """Adam on the weighted logistic loss, a step a part of about ``part_rows`` of the shuffled rows; the rate falls to a tenth."""
    if not len(y) or y.min() == y.max():
        share = float(np.average(y, weights=weight)) if len(y) else 0.0
        return Machine(np.zeros(0, int), float(np.clip(np.log(max(share, 1e-26) / max(1 - share, 1e-26)), -60, 60)), np.zeros(0), np.zeros((0, rank)))
    keys = informative(rows, y, features)
    keys = np.concatenate([keys, paired(rows, y, keys, features // 8)])
    share = np.average(y, weights=weight)
    bias, weight = float(np.log(share / (1 - share))), weight / weight.mean()
    if not len(keys):
        return Machine(keys, bias, np.zeros(0), np.zeros((0, rank)))
    place = np.full(1 << BITS, -1)
    place[keys] = np.arange(len(keys))
    own = [p[p >= 0] for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((len(keys), 1)), rng.normal(0, 0.05, (len(keys), rank))], axis=1)
    parts = [(at, _Part([own[i] for i in at], len(keys))) for at in np.array_split(rng.permutation(len(own)), -(-len(own) // part_rows))]
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    mb = sb = 0.0
    for t in range(1, steps + 1):
        at, part = parts[t % len(parts)]
        grad, gb = part.gradient(theta, bias, y[at], weight[at] / len(at))
        grad = grad + l2 / len(keys) * theta
        m, s, mb, sb = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        c1, c2, now = 1 - 0.9**t, 1 - 0.999**t, rate * (1 - 0.9 * t / steps)
        theta = theta - now * (m / c1) / (np.sqrt(s / c2) + 1e-8)
        bias -= now * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return Machine(keys, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8_000, **options) -> Machine:
    """A machine from the labels of ids that are not held out."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    picked, have = draw_ids(docs, own, sample, 1 / 3)

    def run(batches):
        for b in slices(batches, "text"):
            found = [np.array(sorted(terms(t)), np.int32).tobytes() for t in blobs(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "terms"])

    got = map_batches(picked, run, "doc_id long, y int, terms binary").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return fit([np.frombuffer(t, np.int32) for t in got.column("terms").to_pylist()], y, np.array([have[int(c)] / drawn[int(c)] for c in y]), **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches):
        for b in slices(batches, "text"):
            s = [machine.score(t) for t in blobs(b.column("text"))]
            columns = [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score under the threshold; no shuffle."""
    schema = docs.schema

    def run(batches):
        for b in slices(batches, "text"):
            yield b.filter(pa.array([machine.score(t) < threshold for t in blobs(b.column("text"))], pa.bool_()))

    return map_batches(docs, run, schema)
