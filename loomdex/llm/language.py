"""Language identification in two levels: the family first, then one-versus-one linear support vector machines within it.

A text's features are the 2-, 3- and 4-grams of its lower-cased UTF-8 bytes, anything that is no letter being a space, hashed to
``BUCKETS`` counts; the square roots of their shares make a vector of length one. Machines with squared hinge loss are solved by Newton steps in
the dual. Between the languages of a family every pair has a machine; the language with the largest sum of clipped margins wins, ties to the name
that sorts first. Two families are a pair too; of more, each has a machine against the rest.

Learning uses a bounded sample (``sample`` texts over all languages, equal parts, ``most`` at most, ids by hash, of rows that repeat an id and a language the
first text); every text is predicted whole.

Defined cases: null text, and text without a letter, is ``und`` with score 0; a null doc_id is held out; rows whose lang is null are not learned
from; a single learned language is given to every other text with score 1; without any, all is ``und``; empty tables, repeated rows and other
columns are no special case.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import blobs, crc_of_id, map_batches, slices

BUCKETS = 1 << 13
CHUNK = 1 << 20
MANY, C = 64, 10.0
#: Languages by family, ISO 639 codes; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la ast",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu", "turkic": "tr az kk ky uz tt",
    "indic": "hi ur bn pa gu mr ne or", "iranian": "fa ku ps", "semitic": "ar he mt am", "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu", "malayic": "id ms jv su",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def vector(text: bytes) -> np.ndarray:
    """The text's features, a float32 vector of length one (zero for texts of under two bytes)."""
    data = _FOLD[np.frombuffer(text.decode().lower().encode(), np.uint8)].astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data) - 3), CHUNK):
        d = data[at : at + CHUNK + 3]
        two = d[:-1] << 8 | d[1:]
        three = two[:-1] << 8 | d[2:]
        four = three[:-1] << 8 | d[3:]
        last = at + CHUNK + 3 >= len(data)
        own = [x if last else x[:CHUNK] for x in (two * np.uint32(0x9E3779B1) + np.uint32(1 << 31), three * np.uint32(0x85EBCA6B), four * np.uint32(0xC2B2AE35))]
        counts += np.bincount(np.concatenate(own) >> np.uint32(19), minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total if total else counts).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, c: float = C, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge) for labels of 1 and -1."""
    gram = (x @ x.T).astype(np.float64) + 1
    inside, a = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(steps):
        at = np.flatnonzero(inside)
        a = np.zeros(len(y))
        a[at] = np.linalg.solve(gram[np.ix_(at, at)] + np.eye(len(at)) / (2 * c), y[at])
        now = y * (gram @ a) < 1
        if (now == inside).all():
            break
        inside = now
    return x.T @ a.astype(np.float32), float(a.sum())


class Duel:
    """One-versus-one machines over a few classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.classes = sorted(set(names.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights, self.bias = np.zeros((x.shape[1], len(self.pairs)), np.float32), np.zeros(len(self.pairs))
        for k, (i, j) in enumerate(self.pairs):
            own = np.flatnonzero(np.isin(names, [self.classes[i], self.classes[j]]))
            self.weights[:, k], self.bias[k] = machine(x[own], np.where(names[own] == self.classes[i], 1.0, -1.0))

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The winning class and how sure it is, from 0 to 1."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = np.clip(v @ self.weights + self.bias, -1, 1)
        points = np.zeros(len(self.classes))
        for (i, j), m in zip(self.pairs, margins.tolist(), strict=True):
            points[i] += m
            points[j] -= m
        best = int(points.argmax())
        least = min(m if i == best else -m for (i, j), m in zip(self.pairs, margins.tolist(), strict=True) if best in (i, j))
        return self.classes[best], 1 / (1 + float(np.exp(-4 * least)))


class Rest:
    """One machine for each class against all others: families may be as many as languages. Of two classes, this is one machine and its mirror.

    Of more than ``MANY`` classes all machines take the first Newton step only, in which every row counts: it is the same matrix for all of them.
    """

    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.classes = sorted(set(names.tolist()))
        if len(self.classes) > MANY:
            own = np.where(names[:, None] == np.array(self.classes, object)[None, :], 1.0, -1.0)
            a = np.linalg.solve((x @ x.T).astype(np.float64) + 1 + np.eye(len(x)) / (2 * C), own)
            self.weights, self.bias = x.T @ a.astype(np.float32), a.sum(0)
            return
        own = [machine(x, np.where(names == c, 1.0, -1.0)) for c in self.classes] if len(self.classes) > 1 else [(np.zeros(x.shape[1], np.float32), 0.0)]
        self.weights, self.bias = np.stack([w for w, _ in own], axis=1), np.array([b for _, b in own])

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        margins = v @ self.weights + self.bias
        best = int(margins.argmax())
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        second = float(np.partition(margins, -2)[-2])
        return self.classes[best], 1 / (1 + float(np.exp(-2 * (float(margins[best]) - second))))


class Identifier:
    """Families, then the languages of each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, object)
        families = np.array([family(s) for s in langs], object)
        self.top = Rest(x, families) if langs else None
        self.within = {f: Duel(x[families == f], names[families == f]) for f in sorted(set(families.tolist()))}

    def predict(self, text: bytes) -> tuple[str, float]:
        if self.top is None or not _LETTER.search(text.decode()):
            return "und", 0.0
        v = vector(text)
        f, sure = self.top.decide(v)
        lang, within = self.within[f].decide(v)
        return lang, sure * within


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(5)) == 0, F.lit(True))


def learn(docs: DataFrame, sample: int = 1_600, least: int = 20, most: int = 4_000) -> Identifier:
    """An identifier from the rows that are not held out: about ``sample`` texts in equal shares of the languages, ``least`` of each where it has so
    many ids, but ``most`` in all; of more languages than that, the ``most`` with the most ids are learned.

    Ids are drawn among those that a language has, exactly as many as its share, so none that has one goes without; ranks are cut before they are
    shuffled, so a language's ids don't gather in one task.
    """
    own = docs.where("lang is not null").where(~held_out())
    ids = own.select("doc_id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    have = [r.lang for r in sizes.collect()]
    if not have:
        return Identifier(np.zeros((0, BUCKETS), np.float32), [])
    if len(have) == most:
        ids = ids.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in have], "lang string")), "lang")
    share = max(1, min(max(sample // len(have), least), most // len(have)))
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id"))
    drawn = ids.withColumn("at", at).where(F.col("at") <= share).drop("at")

    def run(batches):
        for b in slices(batches, "text"):
            found = [vector(t).astype(np.float16).tobytes() for t in blobs(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(found, pa.binary())], ["doc_id", "lang", "v"])

    picked = own.join(F.broadcast(drawn), ["doc_id", "lang"]).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "lang").agg(F.min("text").alias("text"))
    got = map_batches(picked, run, "doc_id long, lang string, v binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return Identifier(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""

    def run(batches):
        for b in slices(batches, "text"):
            found = [identifier.predict(t) for t in blobs(b.column("text"))]
            columns = [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")
