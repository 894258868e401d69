import random
import re
from fractions import Fraction

from loomdex.llm import mixing


def test_targets_stop_at_twice_the_size_and_reshare():
    t = mixing.capped_targets([10, 100, 1000], [3, 1, 2], Fraction(3, 2), 2)
    assert t[0] == 20 and t[1] == 200 and sum(t) == Fraction(3, 2) * 1110
    assert mixing.capped_targets([], [], Fraction(3, 2), 2) == []
    assert mixing.capped_targets([0, 5], [3, 1], Fraction(3, 2), 2) == [0, Fraction(15, 2)]


def test_sainte_lague_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        t = [Fraction(rng.randrange(0, 60)) for _ in range(rng.randrange(1, 7))]
        most = [rng.randrange(0, 30) for _ in t]
        seats = rng.randrange(0, 40)
        q = [0] * len(t)
        for _ in range(seats):
            open_ = [i for i in range(len(t)) if q[i] < most[i] and t[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (t[i] / (2 * q[i] + 1), -i))
            q[best] += 1
        got = mixing.sainte_lague(t, seats, most)
        assert sum(got) == sum(q)
        if all(m >= 30 for m in most):
            assert got == q
        low = min((t[i] / (2 * got[i] - 1) for i in range(len(t)) if got[i]), default=None)
        high = max((t[i] / (2 * got[i] + 1) for i in range(len(t)) if got[i] < most[i]), default=None)
        if low is not None and high is not None:
            assert low >= high  # no seat should move


def test_mix_keeps_targets_and_bounds(spark, docs_of):
    rows = [(i, "w " * (i % 40), "en", ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(400)] + [(900, None, None, None), (901, "", "en", "empty"), (5, "w w w", "en", "b"), (902, "x y z \x1cq", "en", "b")]
    df = docs_of(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len(word.findall(t or ""))) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r["size"]
        x[1] += r.taken
    assert all(s == size and abs(k - t) <= 16 for s, k, t, size in by.values())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.capped_targets([by[s][0] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], Fraction(3, 2), 2)
    assert [round(float(t), 6) for t in want] == [round(by[s][2], 6) for s in names]
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_empty_and_applied_mix(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    df = docs_of([(i, "a b c d", "en", "s%d" % (i % 2)) for i in range(50)] + [(None, "x y", "en", "s0"), (77, None, "en", "s0")])
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: n for i, n in copies_by_brute_force(df).items() if n}


def copies_by_brute_force(df, **options):
    """doc_id: copies, by walking each shard's rows in order from the run's beginning."""
    shards = {}
    for r in mixing.lay(df, **mixing.DEFAULTS | options).rows.where("size > 0").collect():
        shards.setdefault((r.source_no, r.part, r.shard), []).append(r)
    out = {}
    for rows in shards.values():
        rows.sort(key=lambda r: r.start)
        want = sum(r.extra for r in rows)
        at = next((k for k, r in enumerate(rows) if r.start >= r.begins), 0)
        words = 0
        for r in rows[at:] + rows[:at]:
            more = abs(words + r["size"] - want) <= abs(words - want)
            words += r["size"] if more else 10**12
            assert r.doc_id not in out
            out[r.doc_id] = r.times + more
    return out


def test_applied_mix_follows_brute_force_in_many_shards_and_groups(spark, docs_of, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 3, 20, 200))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = docs_of(rows)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    want = {i: n for i, n in copies_by_brute_force(df, shard_tokens=3000).items() if n}
    laid = mixing.mix(df, shard_tokens=3000).collect()
    assert len({(r.source, r.part) for r in laid}) > 8 and max(r.shard for r in laid) == 3
    for most in (1 << 20, 0):  # with the places broadcast, and joined as the optimiser likes
        monkeypatch.setattr(mixing, "BROADCAST_SHARDS", most)
        out = mixing.apply_mix(df, shard_tokens=3000)
        got = {}
        for r in out.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert out.dtypes == df.dtypes and got == want
    size = {i: len(t.split()) for i, t, *_ in rows}
    for source in "abc":
        own = [i for i, _, _, s in rows if s == source]
        target = next(r.target for r in laid if r.source == source)
        assert abs(sum(got.get(i, 0) * size[i] for i in own) - target) <= 0.03 * target + 200
        shards = len({(r.part, r.shard) for r in laid if r.source == source})
        assert abs(sum(r.taken for r in laid if r.source == source) - target) <= 16 + 8 * shards  # of a source that comes twice, half a block a shard is missed twice


def test_rows_without_id_are_spread_over_shards(spark, docs_of):
    df = docs_of([(None, f"t{k} b c d", "en", "s") for k in range(400)])
    rows = mixing.mix(df, shard_tokens=100).collect()
    assert len({r.shard for r in rows}) > 8 and abs(sum(r.taken for r in rows) - 2400) <= 16 + 4 * 16
    assert abs(mixing.apply_mix(df, shard_tokens=100).count() - 600) < 40
