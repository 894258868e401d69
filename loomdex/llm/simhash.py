"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, and connected components.

Two rules are offered. ``near_duplicates`` links 64-bit fingerprints of 4-word shingles that differ in at most 4 bits. ``keep_one`` judges
similarity: it takes 5-word shingles, a sketch of 1,024 SimHash bits, and links texts whose Jaccard similarity, as the sketches' differing bits
and the numbers of distinct shingles tell it, is at least 0.8 (standard error 0.03 at 0.8).

Both use one index. A fingerprint is a row of positional bytes, and its keys are sets of three positional bytes. For each pair that meets in a
posting list, the shared positional bytes are tallied, pairs under the least number of matches go, and the others are verified by their
differing bits. With 8 bytes and 4 bits, any two linked fingerprints share at least 4 bytes, and 20 sets (``TRIPLES``) are chosen so that any
four positions contain one: no link is lost. With 128 bytes, two texts of similarity 0.8 share a byte in 0.27 of all places, 34 on the average
with a deviation of 5; the least number is 14, four deviations below, and 128 sets (``SPREAD``) with no two places in common twice let 92 % of pairs at
0.8, 99 % at 0.86 and all but one in 10,000 at 0.9 meet. Keys of single bytes, on which such an index can also stand, meet N*N/64 pairs;
24-bit keys meet one pair in some millions.

Equal texts, and then equal fingerprints, are one entry before the index. A posting list gives a spanning forest of its links (never all
pairs): a search that compares each row reached only with rows not yet reached. A list longer than ``LIST_ROWS`` is cut into tiles that are
compared tile by tile in tasks of their own, so that no task holds an unbounded list and no link is lost. Components come from alternating
large-star and small-star steps over the forest's edges; every step is checkpointed into the shared folder. Joins on hot nodes are split by the
optimiser at run time.

Defined cases: null text is the empty text; a text without words has fingerprint zero and is linked like any other; a null doc_id takes part
with its fingerprint but is never the smallest id; a component without any id has none; unlike texts of one id are not linked by it; repeated rows
stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import blobs, checkpoint, map_batches, slices

MAX_BITS = 4
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
SKETCH_WORDS, LEAST_SHARED = 16, 14
LIST_ROWS, TILE_ROWS, SHORT_LIST, COMPARED = 16384, 8192, 24, 1 << 17
BROADCAST_ROWS = 1 << 20


def byte_sets() -> list[tuple[int, ...]]:
    """Sets of three of 8 positions such that any four positions contain one: all three in a group, or two in one and one in the next."""
    found = [c for g in GROUPS for c in combinations(g, 3)]
    for k, g in enumerate(GROUPS):
        found += [(*pair, x) for pair in combinations(g, 2) for x in GROUPS[(k + 1) % len(GROUPS)]]
    return found


TRIPLES = byte_sets()
#: Three places of 128 for each key; differences 1, 2 and 3 occur once each, so two keys share one place at most.
SPREAD = [(i, (i + 1) % (8 * SKETCH_WORDS), (i + 3) % (8 * SKETCH_WORDS)) for i in range(8 * SKETCH_WORDS)]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, A-Z lower-cased; of fewer words, of the whole sequence; none without words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit set."""
    counts = np.zeros(rows.shape[1] * 64, np.int64)
    for at in range(0, len(rows), 255):  # bytes can count so many
        bits = np.unpackbits(rows[at : at + 255].view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bits set in over half the hashes of the shingles; no words: zero."""
    h = shingle_hashes(text, width)
    return int(np.packbits(bit_counts(h.reshape(-1, 1)) * 2 > len(h), bitorder="little").view("<u8")[0])


_MORE = np.arange(1, SKETCH_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(text: bytes, width: int = 5) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and the fingerprint of ``SKETCH_WORDS`` words over them: a hash is continued by mixing it with each word's number."""
    h = np.unique(shingle_hashes(text, width))
    counts = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(h), 4080):
        z = h[at : at + 4080, None] + _MORE
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += bit_counts(z ^ (z >> np.uint64(31)))
    return len(h), np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def similarity(bits: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of n and m shingles whose sketches differ in so many bits."""
    both = np.cos(np.minimum(bits, 32 * SKETCH_WORDS) * (math.pi / (64 * SKETCH_WORDS))) * np.sqrt(n * m)
    return np.where((n == 0) | (m == 0), (n == m).astype(float), both / np.maximum(n + m - both, 1e-9))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its fingerprint as a signed 64-bit integer, and a digest of the exact text."""

    def run(batches):
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in blobs(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps), b.column("digest")], ["doc_id", "fp", "digest"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), run, "doc_id long, fp long, digest long")


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, digest of the text, its number of distinct shingles, its sketch, and a hash of both that stands for them."""

    def run(batches):
        for b in slices(batches, "text"):
            done = [sketch(t, width) for t in blobs(b.column("text"))]
            rows = [s.tobytes() for _, s in done]
            nodes = np.array([xxhash.xxh64_intdigest(s, n) for (n, _), s in zip(done, rows, strict=True)], np.uint64).view(np.int64)
            columns = [b.column("doc_id").cast(pa.int64()), b.column("digest"), pa.array(nodes), pa.array([n for n, _ in done], pa.int64()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "n", "sketch"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), run, "doc_id long, digest long, fp long, n long, sketch binary")


# ---------------------------------------------------------------- links


class Bits:
    """Rows are fingerprints of 64 bits; linked at ``MAX_BITS`` or fewer that differ."""

    def __init__(self, columns):
        self.words = columns[0].view(np.uint64)

    def linked(self, a, b) -> np.ndarray:
        """Places among the pairs (a, b) that are linked: the tally of shared positional bytes first, then the differing bits."""
        diff = self.words[a] ^ self.words[b]
        some = np.flatnonzero((diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - MAX_BITS)
        return some[np.bitwise_count(diff[some]) <= MAX_BITS]


class Sketches:
    """Rows are sketches with their numbers of shingles; linked from a similarity on."""

    def __init__(self, columns, least: float = 0.8):
        self.n, self.least = columns[1].astype(float), least
        self.words = np.frombuffer(b"".join(columns[2].tolist()), np.uint64).reshape(-1, SKETCH_WORDS)

    def linked(self, a, b) -> np.ndarray:
        out = []
        for at in range(0, len(a), COMPARED):
            x, y = a[at : at + COMPARED], b[at : at + COMPARED]
            diff = self.words[x] ^ self.words[y]
            some = np.flatnonzero((diff.view(np.uint8).reshape(len(x), -1) == 0).sum(1) >= LEAST_SHARED)
            bits = np.bitwise_count(diff[some]).sum(1, dtype=np.int64)
            out.append(some[similarity(bits, self.n[x[some]], self.n[y[some]]) >= self.least] + at)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _tree(rows, first: int, last: int) -> tuple[list, list]:
    """Edges that span each component of one list: rows reached are compared with rows not yet reached only."""
    rest, left, right = np.arange(first, last), [], []
    while len(rest) > 1:
        reached, rest = [rest[:1]], rest[1:]
        while reached and len(rest):
            front = reached.pop()
            step = max(1, COMPARED // len(rest))
            if len(front) > step:
                reached.append(front[step:])
                front = front[:step]
            a, b = np.repeat(front, len(rest)), np.tile(rest, len(front))
            hit = rows.linked(a, b)
            found, once = np.unique(b[hit], return_index=True)
            if len(found):
                left.append(a[hit][once])
                right.append(found)
                reached.append(found)
                rest = rest[~np.isin(rest, found)]
    return left, right


def _forest(key: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
    """First places and other places of the components among rows of equal key; rows are sorted by it."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    short = np.repeat(lengths <= SHORT_LIST, lengths)
    at, step = np.flatnonzero(short), 1
    while len(at):  # short lists: every pair, all lists at once
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        hit = rows.linked(at, at + step)
        left.append(at[hit])
        right.append(at[hit] + step)
        step += 1
    for first, n in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist(), strict=True):
        a, b = _tree(rows, first, first + n)
        left += a
        right += b
    label = np.arange(len(key))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:  # least places with pointer jumping until nothing changes
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    member = np.flatnonzero(label != np.arange(len(key)))
    return label[member], member


def _links(kind):
    """Edges of the posting lists in a partition that is sorted by key and fp; a list may go on in the next batch."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def edges():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            a, b = _forest(columns[0], kind(columns[1:]))
            node = columns[1]
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut or (held and held[-1][0][-1] != columns[0][0]):
                held.append([c[:cut] for c in columns])
                yield edges()
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield edges()

    return run


def _met(index: DataFrame) -> DataFrame:
    """part and the other columns of index rows (key, fp, ...) whose key others have too; part names a list, or a pair of a long list's tiles."""
    lists = index.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    tiles = F.when(F.col("many") > LIST_ROWS, F.ceil(F.col("many") / TILE_ROWS)).otherwise(F.lit(1)).cast("int")
    met = index.join(lists, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("part"), "fp")


def _edges(met: DataFrame, kind) -> DataFrame:
    """Edges a, b that span the components of all lists: of each list's component, its least row with each other.

    A row has one least row in each list it is in, so these are collected (no more than there are keys, and tiles of a long list), and the least of them
    stands for the row while the others are tied to it: lists of one group so leave about one edge a row.
    """
    found = map_batches(met.repartition("part").sortWithinPartitions("part", "fp"), _links(kind), "a long, b long")
    least = found.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("least"))
    own = least.select(F.col("least")[0].alias("a"), "b")
    return own.unionByName(least.select(F.col("least")[0].alias("a"), F.explode(F.slice("least", 2, F.greatest(F.size("least") - 1, F.lit(1)))).alias("b")).distinct())


def linked(distinct: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints (fp) that span every link of at most ``MAX_BITS`` bits."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [(F.lit(k) * (1 << 24) + byte(i) * (1 << 16) + byte(j) * (1 << 8) + byte(l)).cast("int") for k, (i, j, l) in enumerate(TRIPLES)]
    met = _met(distinct.select(F.explode(F.array(*keys)).alias("key"), "fp"))
    return _edges(met, Bits)


def alike(distinct: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges a, b between distinct sketches (fp, n, sketch) that span the links of at least that similarity whose pairs meet in the index."""

    def keys(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, 8 * SKETCH_WORDS).astype(np.int32)
            own = sum((x[:, [p[k] for p in SPREAD]] << (16 - 8 * k) for k in range(3)), np.arange(len(SPREAD), dtype=np.int32) << 24)
            flat = pa.array(own.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(SPREAD), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("fp"), lists], ["fp", "keys"])

    index = map_batches(distinct.select("fp", "sketch"), keys, "fp long, keys array<int>").select(F.explode("keys").alias("key"), "fp")
    met = _met(index).join(distinct.select("fp", "n", "sketch"), "fp").select("part", "fp", "n", "sketch")
    return _edges(met, lambda columns: Sketches(columns, least))


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that it reaches, for every node that has an edge in (a, b)."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    sign = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0))).first()
    before = sign(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpoint(lowest.select("hi", F.col("m").alias("lo")).union(small).distinct())
        if (now := sign(e)) == before:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _with_groups(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, grp and component_id of every row of (fp, least): its component's least fingerprint, and the smallest doc_id in it (null if it has none)."""
    found = components(edges)
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    found = found.unionByName(roots).select(F.col("node").alias("fp"), F.col("component").alias("grp"))
    lowest = distinct.join(found, "fp").groupBy("grp").agg(F.min("least").alias("lowest"))
    of = distinct.join(found.join(lowest, "grp"), "fp", "left")
    return of.select("fp", F.coalesce("grp", "fp").alias("grp"), F.when(F.col("grp").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"))


def grouped(fps: DataFrame) -> DataFrame:
    """fp, grp and component_id of every 64-bit fingerprint."""
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _with_groups(distinct, linked(distinct))


def similar(found: DataFrame, least: float = 0.8) -> DataFrame:
    """fp, grp and component_id of every sketch."""
    distinct = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))
    return _with_groups(distinct, alike(distinct, least))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that is reachable over links of at most 4 bits, itself included."""
    fps = checkpoint(fingerprints(docs))
    return fps.join(grouped(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Of each component of texts alike one row, all columns as they are: by the smallest doc_id, null last, then by the text's hash, then by the row's.

    Rows are told apart by id and text, so unlike texts of one id are judged each for itself. Only the keys of rows that go, and of the rows
    that stay out of several with one id and text, are joined with the documents; while these are ``BROADCAST_ROWS`` at most, no text is shuffled.
    """
    names = {c: f"__keep_{k}" for k, c in enumerate(docs.columns)}  # the documents' own columns may have any names
    own = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    doc_id, digest = F.col(names["doc_id"]), F.xxhash64(names["text"])
    found = checkpoint(sketches(docs, width))
    rows = found.join(similar(found, least), "fp").groupBy("grp", found.doc_id, "digest").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    first = rows.groupBy("grp").agg(F.min(key).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    keys = checkpoint(rows.join(first, "grp").withColumn("stays", key == F.col("first")).where("not stays or n > 1").select("doc_id", "digest", "stays"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = doc_id.eqNullSafe(F.col("doc_id")) & (digest == F.col("digest"))
    every = F.struct(*names.values())
    once = own.join(keys.where("stays"), same, "left_semi").groupBy(doc_id, digest).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("row")).select("row.*")
    return own.join(keys, same, "left_anti").unionByName(once).select(*[F.col(n).alias(c) for c, n in names.items()])
