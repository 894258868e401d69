import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rows int"


def brute(rows, k=5, every=50):
    ok = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i in {i for i, _ in ok if i % every == 0}:
        for q in [v for j, v in ok if j == i]:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block", [1 << 25, 8 * 24 * 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK_BYTES", block)
    rng = random.Random(8)
    hot = [rng.uniform(-1, 1) for _ in range(24)]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(24)]) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 24), (351, [None] * 24), (352, [float("inf")] * 24), (None, hot), (400, []), (7, rows[7][1]), (450, [0.5] * 10)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 50, 256 * 512), (0, 2, 3, -65536), (50, 1, 0, 131072), (50, 2, 3, -131072)}
    assert top_k.top_k(df.limit(0), F.lit(True)).count() == 0
    assert top_k.top_k(df.limit(1), F.lit(True)).count() == 0


def test_pruning_keeps_ties_and_wide_sums():
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, (4000, 64)) * np.linspace(40, 1, 64).round()  # most mass comes first
    ids = np.arange(4000)
    got = top_k.search(ids[:40], rows[:40], ids, rows, 5)
    full = rows[:40] @ rows.T
    for i in range(40):
        want = sorted((-full[i, j], j) for j in range(4000) if j != i)[:5]
        assert [(j, s) for q, j, s in got if q == i] == [(j, -s) for s, j in want]
    big = np.array([[2.0**40, 3.0], [2.0**40, 1.0], [-(2.0**40), 5.0]])
    assert top_k.search(np.array([0]), big[:1], np.arange(3), big, 2) == [(0, 1, (1 << 63) - 1), (0, 2, -(1 << 63))]


def test_finite_components_that_overflow_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((1e306, -1e307, 1.5e300, 7.0, -0.3, 1e-310)) * rng.random() for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    floor = lambda x: math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256
    want = set()
    for i, q in rows:
        if i % 50 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(floor(a) * floor(b) for a, b in zip(q, v, strict=True)))), j) for j, v in rows if j != i)[:5]
            want |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(scores)}
    assert got == want


def test_bounds_prune_vectors_without_any_order():
    """Even where mass is spread evenly, as in the driver's vectors, under half of all products are made."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert top_k.multiplications(v, np.arange(4000) % 50 == 0) < 0.5
