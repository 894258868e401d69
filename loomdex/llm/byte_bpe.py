"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A file of byte ranks becomes a BPE model over the usual byte-to-character mapping: printable bytes stand for themselves, the others for
characters from U+0100 on. Every pair of vocabulary entries that joins into an entry is a merge, ordered by that entry's rank, and a whole
piece that is an entry is taken at once, so ids equal those of a rank-based encoder. A text is split by the pattern; each match is encoded
separately, and a worker remembers the ids of pieces it has met until they take ``CACHE_BYTES`` (then it starts anew, so it holds no more than that and one
slice's own pieces).

Decoding reverses the byte table. A token may hold a part of a character: ``decode_bytes`` joins bytes before it reads characters, and
``spans`` gives each token's character span, in which a split character belongs to every token that has a byte of it.

Defined cases: null text is empty (no ids); texts may have any length; ids outside the vocabulary raise; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from array import array
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomdex.llm.common import blobs, map_batches, slices

CACHE_BYTES, PIECE_BYTES = 48 << 20, 240  # a piece's objects take so much beside its characters and ids
assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are packed as the machine packs them"


def byte_characters() -> list[str]:
    """The character for each byte: itself where printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBpe:
    """One vocabulary: pattern, library model and byte table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Tokenizer, models

        chars = byte_characters()
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        written = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [(written[t[:k]], written[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={written[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
        self.table = {ord(c): chars[b] for b, c in enumerate(map(chr, range(256)))}
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.held = 0
        self.newer: set[str] = set()  # pieces with characters younger than Python's Unicode tables
        self.ranks, self.pattern = ranks, pattern

    @cached_property
    def reference(self):
        """The rank-based encoder, for texts with characters on whose class two Unicode versions differ."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _learn(self, pieces: list[str]) -> None:
        self.newer.update(p for p in pieces if not p.isascii() and any(unicodedata.category(c) == "Cn" for c in p))
        for at in range(0, len(pieces), 4096):  # the library's records of a piece are large
            part = pieces[at : at + 4096]
            written = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in part]
            for p, e in zip(part, self.model.encode_batch_fast(written, add_special_tokens=False), strict=True):
                self.known[p] = array("I", e.ids).tobytes()
                self.held += PIECE_BYTES + len(p) + 4 * len(e.ids)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        split = [self.find(t) for t in texts]
        distinct = set().union(*split) if split else set()
        missing = [p for p in distinct if p not in self.known]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.newer.clear()
            self.held, missing = 0, list(distinct)
        if missing:
            self._learn(missing)
        ids = self.known.__getitem__
        if self.newer:
            return [array("I", self.reference.encode_ordinary(t)).tobytes() if not self.newer.isdisjoint(s) else b"".join(map(ids, s)) for t, s in zip(texts, split, strict=True)]
        return [b"".join(map(ids, s)) for s in split]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8, as where ids end inside a character, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def spans(self, ids: list[int]) -> list[tuple[int, int]]:
        """Character span of each token within the decoded text."""
        parts = [self.bytes_of[i] for i in ids]
        data = np.frombuffer(b"".join(parts), np.uint8)
        seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that began before each byte
        ends = list(accumulate(map(len, parts)))
        continued = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
        return [(int(seen[e - len(p)]) - bool(continued(e - len(p))), int(seen[e])) for p, e in zip(parts, ends, strict=True)]


@lru_cache(maxsize=4)
def load(name: str) -> ByteBpe:
    """The vocabulary of a rank file, by its name among the public tokenizers or its path."""
    import os

    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
    return ByteBpe(ranks, public_tokenizers.PATTERN)


def encode(docs: DataFrame, vocabulary: str, with_offsets: bool = True) -> DataFrame:
    """doc_id, ids, and for each token its character offsets."""
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets

    def run(batches):
        bpe = load(vocabulary)
        for b in slices(batches, "text"):
            ids = bpe.encode_batch([t.decode() for t in blobs(b.column("text"))])
            columns = [b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            if with_offsets:
                spans = [bpe.spans(x) for x in ids]
                columns += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    return map_batches(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from ids; null ids give an empty text."""

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256 (bytes)."""

    def run(batches):
        bpe = load(vocabulary)
        for b in slices(batches, "text"):
            n, ids_sha, back_sha = [], [], []
            for packed in bpe.encode_packed([t.decode() for t in blobs(b.column("text"))]):
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                back_sha.append(hashlib.sha256(bpe.decode_bytes(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            columns = [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
