import random
import zlib

import numpy as np

from loomdex.llm import language

WORDS = {
    "en": "the and of to in that with from which have this was are been water would there house should through",
    "de": "der die und das nicht mit von auf ist eine werden haben wasser würde dort haus sollte durch über schön",
    "fr": "le la les et des dans que pour avec être eau serait maison devrait à travers très où été ça",
    "es": "el la los y de en que por con agua sería allí casa debería través muy donde sido eso también",
}


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang, "s"))
    return out


def test_held_out_accuracy(spark, docs_of):
    rows = corpus()
    extra = [(7001, None, "en", None), (7002, "", "en", "s"), (7003, "123 !!! 🙂", "fr", "s"), (7004, "the water and the house", None, "s"), (None, "the water and the house", "de", "s"), (7005, "wasser und haus " * 20000, "de", "s"), (7004, "the water and the house", None, "s")]
    docs = docs_of(rows + extra)
    got = language.identify(docs, language.learn(docs)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows) and by[None].held_out
    held = [(i, lang) for i, _, lang, _ in rows if by[i].held_out]
    assert np.mean([by[i].lang_pred == lang for i, lang in held]) > 0.97
    assert [by[i].lang_pred for i in (7001, 7002, 7003, 7004, 7005, None)] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got)


def test_families_decide_first(spark, docs_of):
    model = language.learn(docs_of(corpus()))
    assert model.top.classes == ["germanic", "romance"] and {f: d.classes for f, d in model.within.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert language.family("pt-BR") == "romance" and language.family("tlh") == "tlh"


def test_three_families(spark, docs_of):
    rng = random.Random(6)
    extra = [(9000 + i, " ".join(rng.choice("ja nein ez egy hogy nem volt csak már vagy mint ha is még akkor víz ház".split()) for _ in range(20)), "hu", "s") for i in range(150)]
    docs = docs_of(corpus() + extra)
    model = language.learn(docs)
    assert model.top.classes == ["germanic", "romance", "uralic"] and isinstance(model.top, language.Rest)
    got = {r.doc_id: r for r in language.identify(docs, model).collect() if r.held_out}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in corpus() + extra if i in got]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_one_language_or_none(spark, docs_of):
    one = docs_of([(i, "hello there", "en", "s") for i in range(20)])
    assert {(r.lang_pred, r.score) for r in language.identify(one, language.learn(one)).collect()} == {("en", 1.0)}
    none = docs_of([(1, "hello", None, "s")])
    assert language.identify(none, language.learn(none)).first().lang_pred == "und"
    assert language.identify(docs_of([]), language.learn(docs_of([]))).count() == 0


def test_long_texts_count_every_gram_once(monkeypatch):
    text = bytes(random.Random(1).choices(b"abcdefg hij", k=5000))
    whole = language.vector(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert np.allclose(language.vector(text), whole, atol=1e-6)
    assert not language.vector(b"").any() and abs(np.linalg.norm(language.vector(b"ab")) - 1) < 1e-6


def test_machines_equal_a_plain_solver():
    """The dual solution is the minimum of the primal, which plain gradient steps reach too."""
    rng = np.random.default_rng(3)
    for n, d in ((30, 6), (60, 12)):
        x = rng.standard_normal((n, d)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = np.where(x[:, 0] + 0.4 * rng.standard_normal(n) > 0, 1.0, -1.0)
        w, bias = language.machine(x, y, c=1.0)
        loss = lambda v, z: 0.5 * (v @ v + z * z) + (np.maximum(0, 1 - y * (x @ v + z)) ** 2).sum()
        v, z = np.zeros(d), 0.0
        for _ in range(20000):
            slack = np.maximum(0, 1 - y * (x @ v + z))
            v, z = v - 0.005 * (v - 2 * x.T @ (y * slack)), z - 0.005 * (z - 2 * (y * slack).sum())
        assert abs(loss(w.astype(float), bias) - loss(v, z)) < 1e-3 and np.abs(w - v).max() < 1e-2 and abs(bias - z) < 1e-2


def test_many_languages_each_get_a_share(spark, docs_of):
    rng = random.Random(2)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(8)] for k in range(30)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % 30}"], k=20)), f"l{i % 30}", "s") for i in range(1500)]
    docs = docs_of(rows)
    model = language.learn(docs, sample=10)
    got = language.identify(docs, model).where("held_out").collect()
    assert len({r.lang_pred for r in got}) == 30 and np.mean([r.lang_pred == f"l{r.doc_id % 30}" for r in got]) > 0.95
    one = language.learn(docs_of([(i, "the same words", "en", "s") for i in range(20)]))
    assert one.predict(b"the words") == ("en", 1.0)


def test_a_hot_id_and_very_many_languages(spark, docs_of, monkeypatch):
    for i in range(1, 6):
        rows = [(k, f"the water and the house {k}", "en", "s") for k in range(1000, 1200)] + [(i, f"wasser und haus und dort {k}", "de", "s") for k in range(400)]
        model = language.learn(docs_of(rows).coalesce(2))
        held = {i for i in range(1, 6) if zlib.crc32(str(i).encode()) % 5 == 0}
        assert model.predict(b"the house") == ("en", 1.0) if i in held else model.predict("und dort das wasser".encode())[0] == "de"
    rng = random.Random(8)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for k in range(150)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % 150}"], k=20)), f"l{i % 150}", "s") for i in range(1500)]
    docs = docs_of(rows)
    model = language.learn(docs, most=300)
    assert len(model.top.classes) == 150 and model.top.weights.shape == (language.BUCKETS, 150)
    got = language.identify(docs, model).where("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 150}" for r in got]) > 0.95
    assert len(language.learn(docs, most=100).top.classes) == 100
