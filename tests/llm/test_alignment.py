import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import alignment
from loomdex.llm.catalogue import ALIGNED


@pytest.fixture(scope="module")
def pair():
    return alignment.load(*ALIGNED)


def plainly(pair, text):
    """Ids, groups and links of a text, token by token."""
    if not text:
        return None
    whole, a = (" " + text).encode(), pair.library.encode(" " + text, add_special_tokens=False).ids
    b = pair.pieces.encode(text)
    if b"".join(pair.a[i] for i in a) != whole or b"".join(pair.b[i] for i in b) != whole:
        return None
    at = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ends_a, ends_b = at(a, pair.a), at(b, pair.b)
    cuts = sorted(set(ends_a) & set(ends_b))
    spell = lambda ids, ends, low, cut: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= cut)
    groups = ";".join(f"{spell(a, ends_a, low, cut)}|{spell(b, ends_b, low, cut)}" for low, cut in zip([0, *cuts], cuts, strict=False))
    return a, b, groups, [(i, j) for i, e in zip(a, ends_a, strict=True) for j, f in zip(b, ends_b, strict=True) if e == f]


TEXTS = ["Hello wörld, it's 1999!", "  two  spaces \n\n\tand tabs", "<|endoftext|> </s> <s> <unk> <0x41>", "日本語と😀 mixed", "literal ▁ piece", "", None, "x", " ", "\x00\x01 control \x85\xa0", "repeat repeat repeat", "é" * 300, "Ελληνικά кириллица"]


def test_one_text_equals_the_plain_version(pair):
    rng = random.Random(1)
    pools = ["abc the ing 123 '\"s't", "\x00\x1c\x1d\x85\xa0​　 \t\n\r\x0b", "中文字符日本語ñéü", "𝒜😀👍🏽①²½٣ℵªǅ", "'S'T'ſ'll"]
    texts = TEXTS + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for text, got in zip(texts, alignment.align(pair, [(t or "").encode() for t in texts]), strict=True):
        want = plainly(pair, text)
        assert (got is None) == (want is None), text
        if want:
            a, b, groups, links = want
            assert got.a.tolist() == a and got.b.tolist() == b and got.groups().decode() == groups
            assert Counter((int(k & alignment._LOW), int(k >> 32)) for k in got.keys()) == Counter(links)
            spans = got.spans()
            assert ";".join(f"{','.join(map(str, s['a']))}|{','.join(map(str, s['b']))}" for s in spans) == groups
            assert all(b"".join(pair.b[i] for i in s["b"]) == (" " + text).encode()[s["start"] : s["stop"]] for s in spans)


def test_both_encoders_of_a_agree_below_0250(pair):
    """Every character of the range that the faster encoder takes, in contexts of each class that the pattern tells apart."""
    texts = [f"{x}{c}{y}" for c in map(chr, range(0x250)) for x in ("", "a", " ", "1", ".", "'") for y in ("", "b", " ", "2", "!", "s")]
    texts += [c * 3 for c in map(chr, range(0x250))]
    rng = random.Random(2)
    texts += ["".join(chr(rng.randrange(0x250)) if rng.random() < 0.3 else rng.choice("the ing'st 12.\n ") for _ in range(40)) for _ in range(3000)]
    assert [pair.fast.encode_ordinary(" " + t) for t in texts] == [e.ids for e in pair.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def test_frames_against_brute_force(spark, docs_of, pair):
    rng = random.Random(3)
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice("the theory of everything anything something thing ing".split()) for _ in range(rng.randrange(1, 60))), "en", "s") for i in range(60)]
    rows += [(0, TEXTS[0], "en", "s"), (None, "no id", None, None), (9000, "long words and more " * 400, "en", "s")]
    found = [plainly(pair, t) for _, t, *_ in rows]
    count = Counter(x for f in found if f for x in f[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    want = Counter()
    for (i, *_), f in zip(rows, found, strict=True):
        if not f:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        a, b, groups, links = f
        want[(i, len(a), len(b), groups.count(";") + 1, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest())] += 1
    docs = docs_of(rows).repartition(5)
    got = alignment.align_corpus(docs, *ALIGNED).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert {(r.a, r.b): r["count"] for r in alignment.dictionary(docs, *ALIGNED).collect()} == dict(count)
    assert len(count) <= pair.most_pairs() == 274_882
    shown = {r.doc_id: r.groups for r in alignment.groups(docs, *ALIGNED).where("doc_id < 13").collect()}
    assert [len(shown[i]) for i in (4, 5, 6)] == [0, 0, 0] and shown[7][0].start == 0 and shown[7][-1].stop == 2


def test_no_tokens_at_all(spark, docs_of):
    assert alignment.align_corpus(docs_of([]), *ALIGNED).count() == 0
    got = alignment.align_corpus(docs_of([(1, None, None, None), (2, "", "en", "s")]), *ALIGNED).collect()
    assert {(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in got} == {(0, 0, 0, "")}


def test_sums_of_parts(monkeypatch):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 50, 4000)
    want = dict(zip(*np.unique(keys, return_counts=True), strict=True))
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())), pa.array([[1] * len(x)], pa.list_(pa.int32()))], ["keys", "times"])
    for held in (16, 200, 1 << 20):
        monkeypatch.setattr(alignment, "HELD_KEYS", held)
        parts = pa.Table.from_batches(list(alignment._partial(batch(x) for x in np.array_split(keys, 40)))).sort_by("key")
        runs = pa.Table.from_batches(list(alignment._sum_runs(iter(parts.to_batches(max_chunksize=7))))).to_pydict()
        assert dict(zip(runs["key"], runs["count"], strict=True)) == want and runs["key"] == sorted(want)


def test_shards_and_bound(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_ROWS", 3)
    rows = [((b << 32) | a, 10 * b + a) for b in range(4) for a in range(5)]
    counts = alignment.share_counts(spark.createDataFrame(rows, "key long, count long"), 20)
    assert len(counts.files) == 7
    n, best = counts(np.array([k for k, _ in rows] + [-5, 1 << 40, (1 << 32) | 77]))
    assert n.tolist() == [c for _, c in rows] + [0, 0, 0] and best.tolist()[:20] == [10 * b + 4 for b in range(4) for _ in range(5)]
    with pytest.raises(ValueError, match="more than 19"):
        alignment.share_counts(spark.createDataFrame(rows, "key long, count long"), 19)
