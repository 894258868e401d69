from pyspark.sql import functions as F

from loomdex.streaming import changes

SCHEMA = "run_id long, seq int, ts timestamp, symbol string, change_type string"


def rows(spark, data):
    return spark.createDataFrame(data, "run_id long, seq int, ts string, symbol string, change_type string").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows_and_once(spark, tmp_path):
    log = str(tmp_path / "log")
    first = rows(spark, [(1, 1, "2024-01-01 00:10:00", "a", "added"), (1, 2, "2024-01-01 00:20:00", "b", "added"), (1, 3, "2024-01-01 05:00:00", "c", "removed")])
    first.write.parquet(log)
    first.limit(2).write.mode("append").parquet(log)  # delivered again
    stream = changes.read(spark, log, SCHEMA)
    assert drain(changes.once(stream, ["run_id", "seq"]), "once").count() == 3
    counted = drain(changes.counts(changes.read(spark, log, SCHEMA)), "counted").collect()
    assert [(r.change_type, r.n) for r in counted] == [("added", 4)]
    assert drain(changes.counts(changes.read(spark, log, SCHEMA), "2 hours", "1 hour"), "sliding", "complete").count() == 4


def test_latest_state_is_exactly_once(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows(spark, [(1, 1, "2024-01-01 00:10:00", "a", "added"), (1, 2, "2024-01-01 00:20:00", "b", "added")]).write.parquet(log)
    for _ in range(2):
        changes.keep_latest(changes.read(spark, log, SCHEMA), out, ["symbol"], ["run_id", "seq"], mark).awaitTermination()
    rows(spark, [(2, 1, "2024-01-02 00:10:00", "a", "removed")]).write.mode("append").parquet(log)
    changes.keep_latest(changes.read(spark, log, SCHEMA), out, ["symbol"], ["run_id", "seq"], mark).awaitTermination()
    assert {(r.symbol, r.change_type) for r in changes.latest(spark, out).collect()} == {("a", "removed"), ("b", "added")}
