import random
import zlib
from itertools import product

import numpy as np
import pytest

from loomdex.llm import line_quality as lq

LABELS = "doc_id long, quality int, toxic int"


def some_text(rng, bad=False):
    prose = lambda: " ".join(rng.choice("the of and river walked home under a bright sky while others slept".split()) for _ in range(rng.randrange(4, 30))).capitalize() + "."
    junk = lambda: rng.choice([" | ".join(rng.choice(["menu", "login", "cart", "home"]) for _ in range(12)), " ".join(["buy"] * 30), "CLICK HERE!! NOW!! $$$ ###"])
    lines = [prose() for _ in range(rng.randrange(1, 8))]
    if bad:
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = [junk() for _ in range(rng.randrange(2, 6))]
    return "\n".join(lines)


def random_chains(rng, counts):
    return lq.Chains(rng.integers(0, lq.BINS, (sum(counts), len(lq.SHAPES))).astype(np.uint8), np.array(counts))


def enumerated(bad, pairs):
    """Marginals of bad, expected pairs and log-sum of one chain, by all labellings."""
    n, total, marginal, expected = len(bad), 0.0, np.zeros(len(bad)), np.zeros((2, 2))
    for y in product((0, 1), repeat=n):
        p = np.exp(sum(b for b, v in zip(bad, y, strict=True) if v) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        marginal += p * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            expected[a, b] += p
    return marginal / total, expected / total, np.log(total)


def test_passes_equal_all_labellings():
    rng = np.random.default_rng(1)
    for counts in ([1], [6], [5, 3, 3, 1, 1]):
        chains, pairs = random_chains(rng, counts), rng.normal(size=(2, 2))
        bad = rng.normal(scale=3, size=sum(counts))
        marginal, expected, total = lq.passes(chains, bad, pairs)
        for k, (at, n) in enumerate(zip(chains.start, counts, strict=True)):
            m, e, z = enumerated(bad[at : at + n], pairs)
            assert np.allclose(marginal[at : at + n], m) and np.allclose(expected[k], e) and np.isclose(total[k], z)
    far = lq.passes(random_chains(rng, [3]), np.array([900.0, -900.0, 40.0]), np.zeros((2, 2)))
    assert np.allclose(far[0], [1, 0, 1]) and np.isfinite(far[2]).all()


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    chains, good = random_chains(rng, [5, 4, 2, 2, 1]), np.array([True, False, False, True, False])
    weights, pairs = rng.normal(scale=0.3, size=lq.Chains.WIDTH), rng.normal(scale=0.3, size=(2, 2))
    _, at, by_pair = lq.gradient(chains, good, weights, pairs)
    value = lambda w, p: lq.gradient(chains, good, w, p)[0]
    for f in rng.permutation(np.unique(chains.features))[:40]:
        step = np.zeros_like(weights)
        step[f] = 1e-5
        assert np.isclose(at[f], (value(weights + step, pairs) - value(weights - step, pairs)) / 2e-5, atol=1e-6)
    for i, j in product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert np.isclose(by_pair[i, j], (value(weights, pairs + step) - value(weights, pairs - step)) / 2e-5, atol=1e-6)


def test_neighbours_stay_within_a_text():
    chains = random_chains(np.random.default_rng(3), [3, 2, 1])
    k, width = len(lq.SHAPES), lq.Chains.WIDTH
    assert (chains.features[[0, 3, 5], k : 2 * k] == width - 2).all() and (chains.features[[2, 4, 5], 2 * k :] == width - 1).all()
    assert (chains.features[1, k : 2 * k] - chains.features[0, :k] == k * lq.BINS).all() and (chains.features[0, 2 * k :] - chains.features[1, :k] == 2 * k * lq.BINS).all()


def test_shapes_by_hand():
    rows = lq.shapes([b"The end of it all.", b"AB ab AB AB", b"x", b"x", "é1 #".encode()])
    col = {name: rows[:, i].tolist() for i, name in enumerate(lq.SHAPES)}
    assert col["words"] == [2, 2, 1, 1, 1] and col["bytes"] == [4, 3, 1, 1, 2] and col["copies"] == [0, 0, 1, 1, 0]
    assert col["first"] == [lq.UPPER, lq.UPPER, lq.LETTER, lq.LETTER, lq.LETTER] and col["last"] == [lq.POINT, lq.UPPER, lq.LETTER, lq.LETTER, lq.SYMBOL]
    assert col["echoed"][0] == 0 and col["echoed"][1] > 0 and col["repeated"][1] > col["repeated"][0] == 0
    assert lq.lines_of(b"a\n\n \t\n b\r\n") == [b"a", b" b\r"] and lq.shapes([]).shape == (0, len(lq.SHAPES))


def test_held_out_accuracy_and_lines(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, some_text(rng, i % 4 == 0), "en", "s") for i in range(900)]
    extra = [(None, "Home\nHome", "en", "s"), (9001, None, None, None), (9002, "", "en", "s"), (9003, " \n\n\t", "en", "s"), (9004, "The river.\n" * 3000, "en", "s"), (9005, "buy " * 60000, "en", "s"), (0, rows[0][1], "en", "s")]
    docs = docs_of(rows + extra)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(900)] + [(i, 1, 0) for i in range(50_000, 80_000)] + [(9001, 1, 0), (None, 0, 0), (5, None, 0), (9005, 0, 0)], LABELS)
    field = lq.learn(docs, labels, sample=400)
    got = lq.score(docs, field).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score == by[9003].score == pytest.approx(field.share) and by[9005].predicted == 0
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    lines = lq.label_lines(docs, field).where("doc_id < 900").collect()
    text = {i: lq.lines_of(t.encode()) for i, t, *_ in rows}
    bad = [text[r.doc_id][r.line].startswith((b"menu", b"login", b"cart", b"home", b"buy", b"CLICK")) for r in lines]
    assert len(lines) >= sum(map(len, text.values())) and np.mean([r.good != b for r, b in zip(lines, bad, strict=True)]) > 0.97


def test_one_class_or_no_label(spark, docs_of):
    docs = docs_of([(i, "Some words\nhere", "en", "s") for i in range(9)])
    one = lq.learn(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], LABELS))
    assert {r.score for r in lq.score(docs, one).collect()} == {1.0}
    none = lq.learn(docs, spark.createDataFrame([(70, 1, 0)], LABELS))
    assert {(r.score, r.predicted) for r in lq.score(docs, none).collect()} == {(0.5, 1)} and lq.label_lines(docs, none).count() == 0
    empty = docs_of([])
    assert lq.score(empty, lq.learn(empty, spark.createDataFrame([], LABELS))).count() == 0
    blank = docs_of([(i, " ", "en", "s") for i in range(20)])
    assert lq.learn(blank, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)).weights is None


def test_batches_do_not_matter():
    rng = random.Random(5)
    texts = [some_text(rng, k % 2 == 0).encode() for k in range(40)]
    codes = [lq.shapes(lq.lines_of(t)) for t in texts]
    sizes = [np.array([len(x) for x in lq.lines_of(t)]) for t in texts]
    field = lq.fit(codes, sizes, np.array([k % 2 == 1 for k in range(40)]), 0.5, steps=40)
    assert np.allclose(field.score(texts)[0], [field.score([t])[0][0] for t in texts], atol=1e-12)
