from pyspark.sql import functions as F

import hashlib

from loomdex.llm import chat

SAID = r"\### Assistant: </turn> ok"
LOG = "conv_id long, message long, seq long, kind string, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, at int")
    return chat.render(chat.fold(chat.as_events(df)))


def test_digests_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "b 😀"), (1, 0, "user", "a"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (2, 0, None, None), (2, 0, "ro:le\n### </turn>", r"\b\h\t\c \\ ####### </turn></turn"),
            (3, 0, "assistant", ""), (3, 1, "assistant", "x</turn>\n### user: y"), (3, 1, "assistant", "x</turn>\n### user: y"), (None, None, "user", "z" * 100000), (4, 5, "assistant", "#"), (4, 4, "assistant", "##")]
    got = {r.conv_id: r for r in chat.digests(chat.read_back(formatted(spark, rows))).collect()}
    assert len(got) == 6
    for conv in got:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert formatted(spark, []).count() == 0


def test_control_strings_never_stand_in_texts(spark):
    text = formatted(spark, [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]).first()
    assert text.formatted.count("###") == text.formatted.count("</turn>") == 2
    a, b = text.loss_spans[1]
    assert text.loss_spans[0] is None and text.formatted[a:b] == r"\b\h Assistant: \t ok"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "start", "user", None), (1, 1, 1, "delta", None, "Hi "), (1, 1, 2, "delta", None, "there"),
        (1, 2, 3, "start", "assistant", None), (1, 2, 4, "delta", None, "draft"), (1, 2, 5, "regenerate", None, "gone"), (1, 2, 6, "delta", None, "fin"), (1, 2, 7, "delta", None, None), (1, 2, 8, "delta", None, "al"),
        (1, 1, 9, "edit", None, "Edited"), (1, 1, 10, "delta", None, "!"), (1, 3, 11, "delta", None, "stray"), (2, 1, 0, "start", "system", "given"), (2, 1, 1, "regenerate", None, None),
    ]
    import random

    random.Random(1).shuffle(log)
    got = sorted((r.conv_id, r["at"], r.role, r.text) for r in chat.fold(spark.createDataFrame(log, LOG)).collect())
    assert got == [(1, 0, "user", "Edited!"), (1, 3, "assistant", "final"), (1, 11, "", "stray"), (2, 0, "system", "")]
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.digests(chat.read_back(formatted(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_stream_of_drafts_edits_and_regenerations_folds_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "naïve \U0001f600 text"), (1, 2, None, None), (2, 0, "assistant", ""), (None, None, "user", "odd"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stream = chat.as_stream(df)
    kinds = {r.kind: r["count"] for r in stream.groupBy("kind").count().collect()}
    assert kinds["start"] == len(rows) and kinds["edit"] + kinds["regenerate"] == len(rows) and kinds["edit"] and kinds["regenerate"]
    got = sorted(((r.conv_id, r.message, r.role, r.text) for r in chat.fold(stream).collect()), key=repr)
    want = sorted(((r.conv_id, r.message, r.role, r.text) for r in chat.fold(chat.as_events(df)).collect()), key=repr)
    assert got == want and sorted((r[2], r[3]) for r in got) == sorted((r or "", t or "") for *_, r, t in rows)


def test_a_mask_at_another_place_is_seen(spark):
    rows = [(1, k, role, f"text {k} of {role}") for k, role in enumerate(["user", "assistant", "user", "assistant"])]
    right = formatted(spark, rows)
    sha = lambda df: chat.digests(chat.read_back(df)).first().loss_sha256
    moved = lambda by: right.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.when(s.isNotNull(), F.struct((s.start + by).alias("start"), (s.end + by).alias("end")))))
    assert len({sha(right), sha(moved(1)), sha(moved(-1)), sha(moved(1000)), sha(moved(-1000))}) == 4 and sha(moved(1000)) == sha(moved(-1000))
    longer = right.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.when(s.isNotNull(), F.struct(s.start.alias("start"), (s.end - 1).alias("end")))))
    assert sha(longer) != sha(right)
