"""Alignment of two tokenizers by bytes: which tokens of one stand for which of the other, and how often, over a corpus.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B, which adds that space itself). Offsets at
which tokens of both end cut the tokens into groups, and link the two tokens that end there. A link is one packed 64-bit key, B's id above A's.

Counting takes no join. Each text's keys are stored once, distinct and with their times, in the shared folder; each partition adds them up by
``np.unique`` and gives partial counts, which are sorted globally by ranges of keys and summed by runs. Tokens that end together are suffixes of one
another, so the vocabularies alone bound the number of keys (``most_pairs``: 274,882 for the two used here), whatever the corpus: the sorted counts,
cut into shards of ``SHARD_ROWS``, go to every executor as files of Spark's, are memory-mapped there, and looked up by ``searchsorted``. The count table
is checked against that bound before it is shared.

A's ids are those of the tokenizers library and its file. Texts of characters under U+0250, on which the rank-based library splits and merges alike (a test
goes through all of them), are encoded by that, which is faster; all others by the tokenizers library itself.

Defined cases: a text that is null or empty, or whose joined bytes of either tokenizer are not the text with its space (a literal U+2581 or an
unknown piece), has no tokens: zeros, and an empty string for the groups; repeated rows count as often as they come; a null doc_id is kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.byte_bpe import byte_characters
from loomdex.llm.common import blobs, map_batches, slices
from loomdex.runtime import shared_folder

HELD_KEYS, SHARD_ROWS = 1 << 21, 1 << 17
_OTHER = re.compile("[^\x00-ɏ]")
_LOW = np.int64((1 << 32) - 1)


def place(name: str) -> str:
    """A public tokenizer's file by its name, or a path as it is."""
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


class Pair:
    """Two tokenizers: their encoders and their tokens' bytes."""

    def __init__(self, a: str, b: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(place(a))
        self.library.encode_special_tokens = True
        back = {c: i for i, c in enumerate(byte_characters())}
        size = self.library.get_vocab_size()
        added = self.library.get_added_tokens_decoder()
        self.a = [b"" if i in added else bytes(map(back.__getitem__, self.library.id_to_token(i))) for i in range(size)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=place(b))
        written = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(written)]
        self.fast = None
        if ranks:
            with open(place(ranks), "rb") as f:
                of = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})
        self.sizes = np.array([len(x) for x in self.a]), np.array([len(x) for x in self.b])
        written = [str(i).encode() for i in range(max(size, len(self.b)))]
        #: What follows an id in the groups' spelling: "," within a tokenizer's part, "|" after A's, ";" after B's; one row each.
        self.spelled = [x + s for s in (b",", b"|", b";") for x in written]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of each text, with a space before it."""
        slow = [i for i, t in enumerate(texts) if self.fast is None or not t.isascii() and _OTHER.search(t)]
        out: list = [None] * len(texts)
        for i, e in zip(slow, self.library.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return [self.fast.encode_ordinary(" " + t) if x is None else x for t, x in zip(texts, out, strict=True)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def most_pairs(self) -> int:
        """How many pairs of ids can ever end together: those of which one's bytes end the other's."""
        known_a, known_b = set(self.a) - {b""}, set(self.b)
        return sum(x[k:] in known_b for x in self.a for k in range(len(x))) + sum(x[k:] in known_a for x in self.b for k in range(1, len(x)))


class Aligned:
    """One text's tokens and the offsets at which both tokenizers end."""

    def __init__(self, pair: Pair, a: list[int], b: list[int]):
        self.pair, self.a, self.b = pair, np.array(a, np.int64), np.array(b, np.int64)
        self.ends_a, self.ends_b = pair.sizes[0][self.a].cumsum(), pair.sizes[1][self.b].cumsum()
        self.cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        self.last_a, self.last_b = np.searchsorted(self.ends_a, self.cuts), np.searchsorted(self.ends_b, self.cuts)

    def keys(self) -> np.ndarray:
        return self.b[self.last_b] << 32 | self.a[self.last_a]

    def groups(self) -> bytes:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        many = len(self.pair.spelled) // 3
        out = np.empty(len(self.a) + len(self.b), np.int64)
        before_b, before_a = np.concatenate([[0], self.last_b + 1]), np.concatenate([self.last_a + 1, [len(self.a)]])
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.last_a], mark_b[self.last_b] = many, 2 * many
        out[np.arange(len(self.a)) + before_b[np.searchsorted(self.cuts, self.ends_a)]] = self.a + mark_a
        out[np.arange(len(self.b)) + before_a[np.searchsorted(self.cuts, self.ends_b)]] = self.b + mark_b
        return b"".join(map(self.pair.spelled.__getitem__, out.tolist()))[:-1]

    def spans(self) -> list[dict]:
        """Groups as records: ids of both, and the group's bytes within the text with its space."""
        out, i, j, at = [], 0, 0, 0
        for cut, la, lb in zip(self.cuts.tolist(), self.last_a.tolist(), self.last_b.tolist(), strict=True):
            out.append({"a": self.a[i : la + 1].tolist(), "b": self.b[j : lb + 1].tolist(), "start": at, "stop": cut})
            i, j, at = la + 1, lb + 1, cut
        return out


def align(pair: Pair, data: list[bytes]) -> list[Aligned | None]:
    """Each text's alignment; None where it has no tokens."""
    own = [(k, d) for k, d in enumerate(data) if d]
    texts = [d.decode() for _, d in own]
    out: list[Aligned | None] = [None] * len(data)
    for (k, d), a, b in zip(own, pair.encode_a(texts), pair.encode_b(texts), strict=True):
        whole = b" " + d
        if b"".join(map(pair.a.__getitem__, a)) == whole and b"".join(map(pair.b.__getitem__, b)) == whole:
            out[k] = Aligned(pair, a, b)
    return out


@lru_cache(maxsize=2)
def load(a: str, b: str, ranks: str | None = None) -> Pair:
    return Pair(a, b, ranks)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(flat, kind))


def links(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the text's distinct keys with their times."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]

    def run(batches):
        pair, none = load(a, b, ranks), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            found = align(pair, blobs(batch.column("text")))
            keys = [np.unique(x.keys(), return_counts=True) if x else (none, none) for x in found]
            n = np.array([(len(x.a), len(x.b), len(x.cuts), len(x.cuts)) if x else (0,) * 4 for x in found], np.int64).reshape(-1, 4)
            sha = [hashlib.sha256(x.groups()).hexdigest() if x else "" for x in found]
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(n[:, k]) for k in range(4)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, _lists([k for k, _ in keys], pa.int64()), _lists([t for _, t in keys], pa.int32())], names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def groups(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """doc_id and its groups in order: ids of A, ids of B, first and last byte (exclusive) in the text with its space."""
    kind = pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "start": pa.int64(), "stop": pa.int64()}))

    def run(batches):
        pair = load(a, b, ranks)
        for batch in slices(batches, "text"):
            found = [x.spans() if x else [] for x in align(pair, blobs(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind)], ["doc_id", "groups"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, groups array<struct<a array<int>, b array<int>, start long, stop long>>")


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts' sums."""
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    return own, total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def merged():
        return add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for b in batches:
        held.append((b.column("keys").flatten().to_numpy(), b.column("times").flatten().to_numpy()))
        n += len(held[-1][0])
        if n >= HELD_KEYS:
            held = [merged()]
            n = len(held[0][0])
            if 2 * n >= HELD_KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "count"])
                held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "count"])


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs of equal keys in sorted rows; the last run waits for the next batch."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        keys, counts = np.concatenate([keys, b.column("key").to_numpy()]), np.concatenate([counts, b.column("count").to_numpy()])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(counts[:-1])], ["key", "count"])
        keys, counts = keys[-1:], counts[-1:]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "count"])


def pair_counts(found: DataFrame, shards: int = 8) -> DataFrame:
    """key and count over all links of ``links``, sorted within and between the partitions."""
    partial = map_batches(found.select("keys", "times"), _partial, "key long, count long")
    return map_batches(partial.repartitionByRange(shards, "key").sortWithinPartitions("key"), _sum_runs, "key long, count long")


class Counts:
    """Sorted count shards by their files' names; each is memory-mapped when it is first asked."""

    def __init__(self, files: list[str], firsts: np.ndarray):
        self.files, self.firsts, self.maps = files, firsts, {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key its count, and the highest count of its B id; 0 where it is unknown."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, side="right") - 1
        for s in np.unique(shard[shard >= 0]).tolist():
            if s not in self.maps:
                self.maps[s] = np.load(SparkFiles.get(self.files[s]), mmap_mode="r")
            own, of = np.flatnonzero(shard == s), self.maps[s]
            at = np.minimum(np.searchsorted(of[0], keys[own]), of.shape[1] - 1)
            hit = of[0][at] == keys[own]
            count[own], best[own] = np.where(hit, of[1][at], 0), np.where(hit, of[2][at], 0)
        return count, best


def share_counts(counts: DataFrame, bound: int) -> Counts:
    """The count table as files on every executor. It has a row a pair of ids that end together, ``bound`` at most, which is checked."""
    got = counts.limit(bound + 1).toArrow()
    if got.num_rows > bound:
        raise ValueError(f"more than {bound} pairs of ids: the counts are not of these vocabularies")
    keys, n = got.column("key").to_numpy(), got.column("count").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    _, starts, at = np.unique(keys >> 32, return_index=True, return_inverse=True)
    table = np.stack([keys, n, np.maximum.reduceat(n, starts)[at] if len(n) else n])
    folder, files = tempfile.mkdtemp(prefix="counts-"), []  # the driver's own: Spark serves the files from here
    for s in range(0, table.shape[1], SHARD_ROWS):
        path = os.path.join(folder, f"counts-{uuid.uuid4().hex}.npy")
        np.save(path, table[:, s : s + SHARD_ROWS])
        counts.sparkSession.sparkContext.addFile(path)
        files.append(os.path.basename(path))
    return Counts(files, keys[::SHARD_ROWS].copy())


def score(found: DataFrame, counts: Counts) -> DataFrame:
    """n_best, the links whose count is the highest of their B id, and count_sum, the sum of the links' counts, beside the numbers of ``links``."""
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        for b in batches:
            keys, times, rows = b.column("keys").flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64), b.num_rows
            row = np.repeat(np.arange(rows), b.column("keys").value_lengths().to_numpy())
            count, best = counts(keys)
            n_best, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(n_best, row, np.where(count == best, times, 0))
            np.add.at(total, row, count * times)
            columns = [*(b.column(c) for c in kept), pa.array(n_best), pa.array(total), b.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum", "groups_sha256"])

    return map_batches(found, run, ", ".join(f"{c} long" for c in [*kept, "n_best", "count_sum"]) + ", groups_sha256 string")


def stored_links(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """``links``, written to the shared folder once and read back: both counting and scoring need them."""
    path = f"{shared_folder(docs.sparkSession)}/links-{uuid.uuid4().hex}"
    links(docs, a, b, ranks).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def align_corpus(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """Every document's alignment in numbers, with its links counted over the corpus."""
    found = stored_links(docs, a, b, ranks)
    return score(found, share_counts(pair_counts(found), load(a, b, ranks).most_pairs()))


def dictionary(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """a, b and count of every pair of ids that ends together somewhere, from the corpus alone."""
    counts = pair_counts(stored_links(docs, a, b, ranks))
    return counts.select(F.col("key").bitwiseAND(F.lit(int(_LOW))).cast("int").alias("a"), F.shiftright("key", 32).cast("int").alias("b"), "count")
