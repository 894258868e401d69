"""The jobs: their queries against SQL, growing input, broken-off and repeated runs, edge cases."""

import hashlib
import json
import re
import shutil
from collections import Counter

import pytest

from jobs import catalogue, common, module_report, word_index
from tests.test_catalogue import FOLDER, duck, plain, pytestmark  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, extra string"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def add(spark, folder, rows):
    spark.createDataFrame([(*r, "x") for r in rows], DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def expected(rows):
    """The index's rows of the last text of each path."""
    last = {"/".join(x for x in (s, lang, f"{i}.txt") if x is not None): t or "" for i, t, lang, s in rows}
    out = set()
    for path, t in last.items():
        words = Counter(re.findall("[a-z0-9_]{3,}", "".join(c.lower() if c.isascii() else c for c in t)))
        out |= {(path, hashlib.sha256(t.encode()).hexdigest(), w, n) for w, n in words.items()} or {(path, hashlib.sha256(t.encode()).hexdigest(), None, None)}
    return out


def state(df):
    rows = [(r.path, r.hash, r.word, r.n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def folders(out, name):
    return sorted(p.name for p in (out / name).iterdir() if p.is_dir())


FIRST = [(1, "The cat and THE dog_1", "en", "a"), (2, None, "en", "a"), (3, "zu ab", None, "b"), (4, "épée über naïve", "fr", None)]


def test_word_index_takes_only_what_is_new(spark, tmp_path):
    data, out = tmp_path / "in", tmp_path / "out"
    add(spark, data, FIRST)
    config = common.settings("word_index") | {"files_per_batch": 1}
    assert state(word_index.run(spark, str(data), str(out), config)) == expected(FIRST)
    runs, stamps = folders(out, "files"), {p: p.stat().st_mtime_ns for p in out.rglob("*.parquet")}
    assert state(word_index.run(spark, str(data), str(out), config)) == expected(FIRST) and folders(out, "files") == runs
    more = [(1, "another text now, cat", "en", "a"), (2, None, "en", "a"), (9, "fresh words words", "en", "a")]
    add(spark, data, more)
    add(spark, data, [(None, "nameless words", "en", "a")])
    assert state(word_index.run(spark, str(data), str(out), config)) == expected(FIRST + more)
    assert len(folders(out, "files")) == len(runs) + 2 and all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    files = {r.path: r for r in word_index.files(spark, str(out)).collect()}
    assert (files["a/en/1.txt"].words, files["a/en/2.txt"].words, files["a/en/2.txt"].size) == (4, 0, 0) and files["a/en/2.txt"].run == 0
    assert [tuple(r) for r in word_index.lookup(spark, str(out), "Words", config["buckets"]).collect()] == [("a/en/9.txt", 2)]
    assert [r.path for r in word_index.lookup(spark, str(out), "cat", config["buckets"]).collect()] == ["a/en/1.txt"] and word_index.lookup(spark, str(out), "dog_1", config["buckets"]).count() == 0


def test_word_index_mends_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    """Postings are written and the files are not; the stream then delivers the batch again."""
    data, out = tmp_path / "in", tmp_path / "out"
    add(spark, data, FIRST)
    word_index.run(spark, str(data), str(out))
    more = [(1, "changed", "en", "a"), (7, "seven seven", "en", "a")]
    add(spark, data, more)
    whole = word_index.take

    def broken(batch, number, *rest):
        whole(batch, number, *rest)
        shutil.rmtree(out / f"files/run={number}")
        raise RuntimeError("lost")

    monkeypatch.setattr(word_index, "take", broken)
    with pytest.raises(Exception, match="lost"):
        word_index.run(spark, str(data), str(out))
    assert state(word_index.postings(spark, str(out))) == expected(FIRST) and folders(out, "postings") == ["run=0", "run=1"]
    monkeypatch.setattr(word_index, "take", whole)
    assert state(word_index.run(spark, str(data), str(out))) == expected(FIRST + more) and folders(out, "postings") == ["run=0", "run=1"]


def test_word_index_of_a_single_file_and_of_nothing(spark, tmp_path):
    add(spark, tmp_path / "in", FIRST)
    one = next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "one.parquet")
    assert state(word_index.run(spark, str(one), str(tmp_path / "out"))) == expected(FIRST)
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert word_index.run(spark, str(tmp_path / "none"), str(tmp_path / "empty")).count() == 0


def test_lookup_reads_one_bucket(spark, tmp_path):
    add(spark, tmp_path / "in", FIRST)
    word_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    plan = word_index.lookup(spark, str(tmp_path / "out"), "cat", 16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(word,cat)" in plan


def test_module_report_runs_again(spark, tmp_path):
    from tests.test_operators import symbols

    own = symbols(spark, [("p/a.py", "p.a.main", "", "", ""), ("p/a.py", "p.a.help", "", "", ""), ("q/b.py", "q.b.run", "", "", ""), ("top.py", "top.go", "", "", "")])
    raw = spark.createDataFrame([("p/a.py", "p.a.main", "help", 1), ("p/a.py", "p.a.main", "run", 2), ("p/a.py", "p.a.main", "run", 3), ("q/b.py", "q.b.run", "nothing", 1), ("top.py", "top.go", "help", 1), ("x", "gone.f", "help", 1)], "file string, src_qname string, callee_raw string, line int")
    refs = spark.createDataFrame([], "src_file string, dst_file string, symbol string, count long")
    calls = module_report.module_calls(own, raw, refs)
    assert {(r.module, r.src, r.dst, r.dst_module, r.n) for r in calls.collect()} == {
        ("p", "p.a.main", "p.a.help", "p", 1), ("p", "p.a.main", "q.b.run", "q", 2), ("q", "q.b.run", None, None, 1), ("(root)", "top.go", "p.a.help", "p", 1), ("(none)", "gone.f", None, None, 1),
    }
    assert {tuple(r) for r in module_report.dependencies(calls).collect()} == {("p", "p", 1, 1, 1), ("p", "q", 2, 1, 1), ("(root)", "p", 1, 1, 1)}
    assert {(r.module, r.symbol, r.callers, r["rank"]) for r in module_report.hottest(calls, 1).collect()} == {("p", "p.a.help", 2, 1), ("q", "q.b.run", 1, 1)}
    assert {(r.module, r.calls, r.resolved, r.rate) for r in module_report.rates(calls).collect()} == {("p", 3, 3, 1.0), ("q", 1, 0, 0.0), ("(root)", 1, 1, 1.0), ("(none)", 1, 0, 0.0)}
    once = module_report.run(spark, FOLDER, str(tmp_path / "out"), {"hottest": 3})
    first = {n: plain(t.toPandas()) for n, t in once.items()}
    (tmp_path / "out/rates/module=left-over").mkdir()
    again = module_report.run(spark, FOLDER, str(tmp_path / "out"), {"hottest": 3})
    assert {n: plain(t.toPandas()) for n, t in again.items()} == first and not (tmp_path / "out/rates/module=left-over").exists()
    assert any(p.name.startswith("module=") for p in (tmp_path / "out/hottest").iterdir())


def test_settings(tmp_path):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"buckets": 4}))
    assert common.settings("word_index", str(path)) == common.settings("word_index") | {"buckets": 4}
    path.write_text(json.dumps({"bucket": 4}))
    with pytest.raises(ValueError, match="unknown settings bucket"):
        common.settings("word_index", str(path))


def test_jobs_import_nothing_of_the_subpackage():
    from pathlib import Path

    assert not [p for p in Path(common.__file__).parent.glob("*.py") if "llm" in p.read_text("utf-8") or "corpus_pipeline" in p.read_text("utf-8")]


def test_word_index_shuffles_texts_only_of_paths_that_come_again(spark, tmp_path):
    rows = [(1, "b b a", "en", "a"), (1, "a b", "en", "a"), (2, "x", "en", "a"), (5, "one", None, "a/en"), (5, "one two", "en", "a")]
    frame = lambda r: spark.createDataFrame([(*x, "x") for x in r], DOCS)
    once, again = word_index.texts(frame(rows[1:3]))
    assert not again and "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    both, again = word_index.texts(frame(rows))
    assert again and sorted(map(tuple, both.collect()), key=repr) == [("a/en/1.txt", "en", "a b"), ("a/en/2.txt", "en", "x"), ("a/en/5.txt", "en", "one two"), ("a/en/5.txt", None, "one")]
    words = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), (["z"],)], "w array<string>")
    assert [[tuple(x) for x in r[0]] for r in words.select(word_index.tally(words.w)).collect()] == [[("a", 2), ("b", 3), ("c", 1)], [("z", 1)]]
    word_index.take(frame(rows), 0, str(tmp_path / "out"), common.settings("word_index"))
    wrote = word_index._written(spark, str(tmp_path / "out/postings"), word_index.POSTINGS)
    assert sorted((r.path, r.word, r.n) for r in wrote.collect()) == [("a/en/5.txt", "one", 2), ("a/en/5.txt", "two", 1)]


def test_module_report_resolves_calls_that_read_alike_once(spark, monkeypatch):
    from tests.test_operators import symbols

    own, seen, real = symbols(spark, [("p/a.py", "p.a.main", "", "", ""), ("p/a.py", "p.a.help", "", "", "")]), [], module_report.resolve.resolve_calls
    raw = spark.createDataFrame([("p/a.py", "p.a.main", "help", k) for k in range(9)], "file string, src_qname string, callee_raw string, line int")
    refs = spark.createDataFrame([], "src_file string, dst_file string, symbol string, count long")
    monkeypatch.setattr(module_report.resolve, "resolve_calls", lambda calls, *rest: seen.append(calls.count()) or real(calls, *rest))
    assert [tuple(r) for r in module_report.module_calls(own, raw, refs).collect()] == [("p", "p.a.main", "p", "p.a.help", 9)] and seen == [1]


def test_module_report_resolves_a_text_once_a_file(spark, monkeypatch):
    from tests.test_operators import symbols

    own, seen, real = symbols(spark, [("p/a.py", f"p.a.{f}", "", "", "") for f in ("help", "main", "more")] + [("q/b.py", "q.b.C.one", "", "", ""), ("q/b.py", "q.b.D.one", "", "", "")]), [], module_report.resolve.resolve_calls
    raw = spark.createDataFrame([("p/a.py", f"p.a.{f}", "help", k) for k, f in enumerate(("help", "main", "more", "more"))] + [("q/b.py", "q.b.C.one", "self.one", 1), ("q/b.py", "q.b.D.one", "self.two", 1), ("x", "gone.f", "help", 1)], "file string, src_qname string, callee_raw string, line int")
    refs = spark.createDataFrame([], "src_file string, dst_file string, symbol string, count long")
    monkeypatch.setattr(module_report.resolve, "resolve_calls", lambda calls, *rest: seen.append(calls.count()) or real(calls, *rest))
    got = {tuple(r) for r in module_report.module_calls(own, raw, refs).select("module", "src", "dst_module", "dst", "n").collect()}
    assert seen == [3]  # not one a caller
    assert got == {("p", "p.a.help", None, None, 1), ("p", "p.a.main", "p", "p.a.help", 1), ("p", "p.a.more", "p", "p.a.help", 2), ("q", "q.b.C.one", None, None, 1), ("q", "q.b.D.one", None, None, 1), ("(none)", "gone.f", None, None, 1)}


def test_calls_are_shuffled_without_what_they_do_not_have(spark):
    from loomdex import bindings

    plan = bindings.raw_calls(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(Window|Project|RepartitionByExpression)[^\n]*(l_suppkey|l_extendedprice)", plan)
