from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import catalogue, surrogates, toxicity

from test_mixing import copies_by_brute_force
from test_simhash import alike_by_brute_force


def test_stages_follow_a_brute_force_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    machine = toxicity.learn(docs, labels)
    rows = [r for r in docs.collect() if machine.score((r.text or "").encode()) < 0.7]
    label = [rows[k].doc_id for k in alike_by_brute_force([r.text for r in rows])]
    rows = [r for r, x in zip(rows, label, strict=True) if r.doc_id == x]
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, out, sf)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
    want = {r.doc_id: surrogates.replace(r.text)[0] for r in rows}
    assert {r.doc_id: r.text for r in out.collect()} == want
    times = {i: n for i, n in copies_by_brute_force(out).items() if n}
    mixed = corpus_pipeline.STAGES[3][1](spark, out, sf)
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == times
    assert corpus_pipeline.run(spark, sf).count() == sum(times.values())


def test_every_query_runs_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = {name: q(spark, sf).count() for name, q in catalogue.QUERIES.items()}
    assert sorted(int(n[2:].split("_")[0]) for n in rows) == list(range(1, 13))
    by = {int(n[2:].split("_")[0]): k for n, k in rows.items()}
    assert all(by[n] == docs for n in (1, 4, 5, 7, 8, 9, 10, 11, 12)) and by[2] == 50 and by[3] == 50


def test_near_duplicates_are_removed_by_rows(spark, docs_of):
    a, b, c, d, e = (" ".join(f"{x}{k * k}" for k in range(30)) for x in "abcde")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c), (None, c), (None, d), (None, d), (8, e), (None, None), (None, "")]
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(3, a), (5, b), (7, c), (None, d), (8, e), (None, "")], key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs_of([]), "").count() == 0


def test_every_stage_takes_odd_tables(spark, docs_of, sf):
    """Nulls in every column, no ids, repeated rows, long and empty texts, an empty table, and columns whose names operators use themselves."""
    long = " ".join(f"word{k}" for k in range(30000))
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", None, "a"), (None, "some text without an id", "en", None), (3, long, "en", "b"), (4, "mail bob@example.org", "de", "b"), (4, "mail bob@example.org", "de", "b"), (4, "other words of the same id", "de", "c")]
    for table in (docs_of(rows), docs_of([])):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.dtypes == table.dtypes, name
            out = spark.createDataFrame(out.collect(), out.schema)
        done = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        assert done.count() == out.count() and (out.count() > 0) == (table.count() > 0)
        assert {r.doc_id for r in out.collect()} <= {None, 3, 4}
