import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from loomdex.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(fps)), 2):
            if label[i] != label[j] and bin(fps[i] ^ fps[j]).count("1") <= 4:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_byte_sets_cover_any_four_positions():
    sets = simhash.byte_sets()
    assert len(sets) == len(set(map(frozenset, sets))) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    words = ["A", "b", "Ünï", "x y", "Ζ", "the", "\x1c", "Q"]
    for n in (0, 1, 2, 3, 4, 5, 9, 200):
        for _ in range(10):
            t = rng.choice(["", " ", "\x0b"]) + rng.choice([" ", "\n", "\t\f"]).join(rng.choice(words) for _ in range(n))
            assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_components_equal_brute_force(spark, docs_of):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(80)) for _ in range(25)]
    texts = [None, "", " ", "one", "One", "two words"]
    for t in base:
        w = t.split()
        texts += [t, t.upper()] + [" ".join(w[:k] + ["zz"] + w[k + 1 :]) for k in (0, 79, 40)]
    rows = [(1000 - i, t, "en", "s") for i, t in enumerate(texts)] + [(995, "one", "en", "s")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = brute_components(fps, [i for i, *_ in rows])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", c) for (i, *_), f, c in zip(rows, fps, want, strict=True))
    assert simhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("limit", [16384, 40])
def test_a_chain_and_a_crowded_list(spark, monkeypatch, limit):
    """A chain of small steps is one component; a list beyond the limit is compared in tiles and loses no link."""
    monkeypatch.setattr(simhash, "LIST_ROWS", limit)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = np.random.default_rng(4)
    chain, x = [], 0
    for b in range(0, 64, 4):
        chain.append(x)
        x |= 0b1111 << b
    crowd = [int(v) << 48 | 0xABCDEF for v in rng.choice(1 << 16, 150, replace=False)]
    others = [int(v) for v in rng.integers(0, 1 << 63, 100)]
    fps = list(dict.fromkeys(chain + crowd + others))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    found = {r.node: r.component for r in simhash.components(simhash.linked(df)).collect()}
    want = brute_components(fps, range(len(fps)))
    got = [found.get(f, f) for f in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_rows_without_id_link_and_a_shared_id_does_not(spark, docs_of, monkeypatch):
    """A - N - B is one component though only a row without id has N; texts C and D of one id stay two components."""
    fps = {"a": 0, "n": 0b1111, "b": 0b11111111, "c": 0x0F0F << 20, "d": 0x7777 << 40, "e": 0x1234567890ABCDEF}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: spark.createDataFrame([(r.doc_id, fps[r.text]) for r in docs.collect()], "doc_id long, fp long"))
    rows = [(7, "a"), (None, "n"), (3, "b"), (5, "c"), (5, "d"), (9, "d"), (None, "e")]
    got = simhash.near_duplicates(docs_of([(i, t, "en", "s") for i, t in rows])).collect()
    of = {f"{v:016x}": k for k, v in fps.items()}
    assert sorted((of[r.fingerprint], r.doc_id or 0, r.component_id) for r in got if r.component_id) == [("a", 7, 3), ("b", 3, 3), ("c", 5, 5), ("d", 5, 5), ("d", 9, 5), ("n", 0, 3)]
    grp = {r.fp: r.grp for r in simhash.grouped(simhash.fingerprints(docs_of([(i, t, "en", "s") for i, t in rows]))).collect()}
    assert grp[fps["a"]] == grp[fps["n"]] == grp[fps["b"]] and len(set(grp.values())) == 4


def jaccard(a, b):
    a, b = (re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in (a, b))
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def test_sketches_tell_the_similarity_and_the_index_meets_it():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    met, off = {0.8: [], 0.86: [], 0.9: []}, []
    for _ in range(1200):
        a = rng.choices(words, k=rng.choice((40, 90, 300)))
        b = list(a)
        for _ in range(rng.randrange(1, 12)):
            b[rng.randrange(len(b))] = rng.choice(words)
        j = jaccard(" ".join(a), " ".join(b))
        (n, x), (m, y) = (simhash.sketch(" ".join(w).encode()) for w in (a, b))
        off.append(simhash.similarity(np.array([np.bitwise_count(x ^ y).sum()]), np.array([n]), np.array([m]))[0] - j)
        same = x.view(np.uint8) == y.view(np.uint8)
        low = max((t for t in met if j >= t), default=None)
        if low:
            met[low].append(bool(any(same[list(p)].all() for p in simhash.SPREAD) and same.sum() >= simhash.LEAST_SHARED))
    assert np.abs(np.mean(off)) < 0.02 and np.std(off) < 0.04
    assert min(map(len, met.values())) > 50 and np.mean(met[0.8]) > 0.9 and np.mean(met[0.86]) > 0.97 and np.mean(met[0.9]) > 0.99
    assert len({frozenset(p) for p in simhash.SPREAD}) == 128 and all(len(set(p) & set(q)) <= 1 for p, q in combinations(simhash.SPREAD, 2))


def alike_by_brute_force(texts):
    done = [simhash.sketch((t or "").encode()) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        (n, x), (m, y) = done[i], done[j]
        if label[i] != label[j] and simhash.similarity(np.array([np.bitwise_count(x ^ y).sum()]), np.array([n]), np.array([m]))[0] >= 0.8:
            a, b = sorted((label[i], label[j]))
            label = [a if c == b else c for c in label]
    return label


@pytest.mark.parametrize("limit", [16384, 20])
def test_groups_of_similar_texts_equal_brute_force(spark, docs_of, monkeypatch, limit):
    """Chains, one large group of copies with a word changed, short and empty texts; lists beyond the limit are compared in tiles."""
    monkeypatch.setattr(simhash, "LIST_ROWS", limit)
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", " ", "one", "One", "two words", "a b c d e f g", "a b c d e f h"] + [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    for base in (rng.choices(words, k=120), rng.choices(words, k=60)):
        for _ in range(60):  # unlike each other, and like their base
            w = list(base)
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        texts.append(" ".join(base))
    w = rng.choices(words, k=200)
    for _ in range(12):  # a chain whose ends are unlike
        w = [*w[15:], *rng.choices(words, k=8)]
        texts.append(" ".join(w))
    rng.shuffle(texts)
    want = alike_by_brute_force(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    found = simhash.sketches(docs_of(rows))
    got = {r.doc_id: r.component_id for r in found.join(simhash.similar(found), "fp").select("doc_id", "component_id").collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.keep_one(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()) == sorted(set(want))


def test_keep_one_takes_any_columns(spark, docs_of):
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = docs_of([(1, text, "en", "a"), (2, text, "en", "b"), (1, text, "en", "c"), (3, None, None, None), (None, text, "en", "d")])
    named = {c: F.lit(7) for c in ("gone_id", "gone_digest", "digest", "grp", "n", "stays", "first", "all", "row", "least", "__keep_0")}
    docs = docs.withColumns(named | {"kind": F.create_map(F.lit("a"), F.col("source")), "parts": F.array(F.struct("lang")), "raw": F.lit(b"x")})
    kept = simhash.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3] and {r.kind["a"] for r in rows if r.doc_id == 1} <= {"a", "c"}
