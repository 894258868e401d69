import hashlib
import random

import numpy as np
import pytest

from loomdex.llm import byte_bpe

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(VOCABULARY)


def test_ids_equal_the_rank_based_encoder(bpe):
    rng = random.Random(1)
    pools = ["abc the ing 123 '\"s't", "\x00\x1c\x1d\x85\xa0​　 \t\n\r\x0b", "中文字符日本語ñéü", "𝒜😀👍🏽①²½٣ℵªǅ", "'S'T'ſ'll"]
    texts = ["", " ", "the " * 50, "a" * 5000] + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    texts += ["x\U00010944y", "࢏ z"]  # of younger Unicode versions
    got = bpe.encode_batch(texts)
    assert got == [bpe.reference.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x) for x in got] == texts


def test_split_characters(bpe):
    ids = bpe.encode_batch(["日本😀"])[0]
    spans = bpe.spans(ids)
    assert spans[0][0] == 0 and spans[-1][1] == 3 and all(a < b for a, b in spans)
    whole = bpe.decode_bytes(ids)
    assert bpe.decode(ids[:-1]).startswith("日本") and whole.decode() == "日本😀"


def test_cache_that_begins_anew(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 300)
    texts = ["alpha beta gamma delta", "beta epsilon zeta", "alpha zeta"]
    for _ in range(3):
        assert [bpe.decode(x) for x in bpe.encode_batch(texts)] == texts


def test_frames(spark, docs_of, bpe):
    rows = [(1, "Hello wörld", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (1, "Hello wörld", "en", "a"), (4, "z" * 20000 + " end", "en", "b"), (None, "no id", "en", "b")]
    df = docs_of(rows)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(df, VOCABULARY).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = bpe.reference.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    encoded = byte_bpe.encode(df, VOCABULARY)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in encoded.collect())
    assert sorted((r.doc_id or 0, r.text) for r in byte_bpe.decode(encoded, VOCABULARY).collect()) == sorted((i or 0, t or "") for i, t, *_ in rows)
    assert byte_bpe.digests(docs_of([]), VOCABULARY).count() == 0
