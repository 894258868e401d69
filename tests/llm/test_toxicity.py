import random
import zlib

import numpy as np

from loomdex.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=1200, seed=3):
    """Toxic: a text with an insult word of its own, or with a group's name together with a harsh word, either of which alone is clean."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        kind = rng.randrange(10)
        toxic = kind in (0, 1, 2)
        w += {0: ["grumblik" + rng.choice(["", "en", "os"])], 1: ["zorgs", "vile"], 2: ["zorgs", "vile"], 3: ["zorgs"], 4: ["vile"], 5: ["zorgs"], 6: ["vile"]}.get(kind, [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_interactions(spark, docs_of):
    rows = corpus()
    docs = docs_of([(i, t, "en", "s") for i, t, _ in rows] + [(5000, None, "en", "s"), (5001, "", None, None), (5002, "word " * 60000 + "grumblik", "en", "s"), (None, "no id", "en", "s")])
    labels = spark.createDataFrame([(i, 0, y, "clash") for i, _, y in rows] + [(1, 0, rows[1][2], "x"), (99999, 0, 1, "x"), (3, 0, None, "x"), (None, 0, 1, "x")], LABELS)
    machine = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    assert len(got) == len(rows) + 4
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7) for i, *_ in rows)
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert got[5002].predicted == 1 and got[5000].predicted == got[5001].predicted == got[None].predicted == 0 and not got[None].held_out
    one, other, both = (machine.score(t) for t in (b"zorgs abc", b"vile abc", b"zorgs vile abc"))
    assert max(one, other) < 0.5 < both  # no sum of weights alone could say so with this bias
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())
    again = toxicity.learn(docs.repartition(7), labels)
    assert (again.weights == machine.weights).all()


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    rows = corpus(300)
    docs = docs_of([(i, t, "en", "s") for i, t, _ in rows])
    flipped = [(i, 0, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y, "") for i, _, y in rows]
    a = toxicity.learn(docs, spark.createDataFrame([(i, 0, y, "") for i, _, y in rows], LABELS))
    b = toxicity.learn(docs, spark.createDataFrame(flipped, LABELS))
    assert a.index == b.index and (a.weights == b.weights).all() and a.bias == b.bias


def test_without_labels_or_documents(spark, docs_of):
    docs, labels = docs_of([(1, "x", "en", "s")]), spark.createDataFrame([], LABELS)
    assert toxicity.score(docs, toxicity.learn(docs, labels)).first().score < 1e-6
    ones = spark.createDataFrame([(i, 0, 1, "") for i in range(20)], LABELS)
    all_toxic = docs_of([(i, "x", "en", "s") for i in range(20)])
    assert toxicity.score(all_toxic, toxicity.learn(all_toxic, ones)).first().score > 0.99
    assert toxicity.score(docs_of([]), toxicity.learn(docs_of([]), ones)).count() == 0


def test_two_terms_that_tell_nothing_alone(spark, docs_of):
    """Each of two terms is as frequent in toxic as in clean texts; only both together are toxic."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = []
    for i in range(4000):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        kind = rng.random()  # both 1.2 %, an insult 6.8 %, one of the two each 13.8 %: 8 % toxic overall and among the rows of either
        w += ["zorgs", "quent"] if kind < 0.012 else ["grumblik"] if kind < 0.08 else ["zorgs"] if kind < 0.218 else ["quent"] if kind < 0.356 else []
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(kind < 0.08)))
    have = {t: [y for _, x, y in rows if t in x.split()] for t in ("zorgs", "quent")}
    assert all(abs(np.mean(v) - np.mean([y for *_, y in rows])) < 0.03 for v in have.values())
    labels = spark.createDataFrame([(i, 0, y, "") for i, _, y in rows], LABELS)
    docs = docs_of([(i, t, "en", "s") for i, t, _ in rows])
    machine = toxicity.learn(docs, labels)
    one, other, both, insult = (machine.score(t) for t in (b"zorgs abc", b"quent abc", b"zorgs quent abc", b"grumblik abc"))
    assert max(one, other) < 0.5 < min(both, insult)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(machine.score(t.encode()) >= 0.7) == y for t, y in held]) > 0.97


def test_scores_equal_the_sum_over_pairs(spark, docs_of):
    rows = corpus(500)
    machine = toxicity.learn(docs_of([(i, t, "en", "s") for i, t, _ in rows]), spark.createDataFrame([(i, 0, y, "") for i, _, y in rows], LABELS))
    for _, text, _ in [*rows[:60], (0, "", 0), (0, "\u00dcn\u00efcode \u212a", 0)]:
        on = sorted(machine.index[h] for h in toxicity.terms(text.encode()) if h in machine.index)
        z = machine.bias + sum(machine.weights[i] for i in on) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(on) for j in on[:k])
        assert abs(machine.score(text.encode()) - 1 / (1 + np.exp(-z))) < 1e-9


def test_labels_mostly_without_documents(spark, docs_of):
    rows = corpus(600)
    docs = docs_of([(i, t, "en", "s") for i, t, _ in rows])
    own = spark.createDataFrame([(i, 0, y, "") for i, _, y in rows], LABELS)
    many = own.unionByName(spark.range(1_000, 1_001_000).selectExpr("id as doc_id", "0 as quality", "cast(id % 2 as int) as toxic", "'' as text"))
    a, b = toxicity.learn(docs, own), toxicity.learn(docs, many)
    assert a.index == b.index and (a.weights == b.weights).all() and len(a.index)


def test_least_support_loses_no_term():
    for n1, n0 in ((5, 40), (30, 30), (400, 90)):
        least = toxicity.least_support(n1, n0, 30.0)
        for n in range(1, n1 + n0):
            a = np.arange(max(0, n - n0), min(n, n1) + 1)
            assert n >= least or (toxicity._gain(a, n - a, n1, n0) < 30.0).all()
