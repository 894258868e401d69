"""Keeps a word index of a growing collection of text files: which words stand in which file, and how often.

The input is a folder (or one file) of Parquet with ``doc_id, text, lang, source``, to which new files are added; a document is the text file
``source/lang/doc_id.txt`` of the collection. Each run takes the files that came since the last one, as a file stream that ends when it has seen
all (``availableNow``), in batches of ``files_per_batch``. A batch compares its documents' digests with those that the index has and writes
what is new or changed:

* ``postings/run=<n>/bucket=<b>``: word, path, n, sorted by word, ``b`` by the word's hash: a lookup reads one bucket and few row groups of it;
* ``files/run=<n>/language=<l>``: path, hash, size, words, action (``new`` or ``changed``).

A file's last run counts; older postings stay on disk and are left out by the reader. Postings come before files, so a run that broke off shows
nothing, and a batch that is delivered again overwrites its own folders with the same rows: it looks at earlier runs only. The stream's checkpoint
lies in ``checkpoint`` beside them and belongs to them: move or delete all three together.

Defined cases: rows without doc_id are no file; null text is empty; of several texts of one path in a batch the least
counts; a text without words has a file row and no postings; an empty language is null. A document that vanishes from the input stays in the index.

    python -m jobs.word_index --data DIR_OR_FILE --out DIR [--config FILE]
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, settings
from loomdex.functions import text
from loomdex.operators import changes

DOCUMENTS = "doc_id long, text string, lang string, source string"
FILES = "path string, hash string, size long, words long, action string, run long, language string"
#: So many paths that come several times in a batch are sent to every task.
BROADCAST_ROWS = 1 << 16
POSTINGS = "word string, path string, n long, run long, bucket int"


def bucket_of(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all runs; none before the first."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The state of each file as of its last run, or its last run before one."""
    rows = _written(spark, f"{out}/files", FILES)
    rows = rows if before is None else rows.where(F.col("run") < before)
    return changes.last_per_key(rows, ["path"], ["run"]).select("path", "language", "hash", "size", "words", "run")


def postings(spark: SparkSession, out: str) -> DataFrame:
    """path, language, hash, size, word, n of the index as it stands; word and n are null for a file without words."""
    rows = _written(spark, f"{out}/postings", POSTINGS).select("path", "run", "word", "n")
    return files(spark, out).join(rows, ["path", "run"], "left").select("path", "language", "hash", "size", "word", "n")


def lookup(spark: SparkSession, out: str, word: str, buckets: int) -> DataFrame:
    """path and n of the files that have a word, most often first; reads the word's bucket only."""
    low = word.translate(str.maketrans(text.UPPER, text.LOWER))
    rows = _written(spark, f"{out}/postings", POSTINGS).where((F.col("bucket") == bucket_of(F.lit(low), buckets)) & (F.col("word") == low))
    last = _written(spark, f"{out}/files", FILES).groupBy("path").agg(F.max("run").alias("run"))
    return rows.join(last, ["path", "run"], "left_semi").select("path", "n").orderBy(F.desc("n"), "path")


def texts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """path, language, text: each path of a batch once; and whether any came several times. Only the texts of those are shuffled, if they are few."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    said = rows.where("doc_id is not null").select(path.alias("path"), F.nullif("lang", F.lit("")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    least = lambda df: df.groupBy("path", "language").agg(F.min("text").alias("text"))
    again = said.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    n = again.limit(BROADCAST_ROWS + 1).count()
    if not n or n > BROADCAST_ROWS:
        return (least(said), True) if n else (said, False)
    few = F.broadcast(again)
    return said.join(few, "path", "left_anti").unionByName(least(said.join(few, "path", "left_semi"))), True


def tally(words):
    """word, n of an array that isn't empty: counted within the row, as runs of the sorted words."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
    run = lambda s, at: lambda k, i: F.struct(F.get(s, k).alias("word"), (F.coalesce(F.get(at, i + 1), F.size(s)) - k).cast("long").alias("n"))
    runs = lambda s: F.get(F.transform(F.array(starts(s)), lambda at: F.transform(at, run(s, at))), 0)
    return F.get(F.transform(F.array(F.sort_array(words)), runs), 0)


def take(batch: DataFrame, number: int, out: str, config: dict[str, Any]) -> None:
    """Write one batch's new and changed files and their postings as run ``number``."""
    spark = batch.sparkSession
    own, again = texts(batch)
    own, known = own.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)), files(spark, out, number).select("path", F.col("hash").alias("_known"))
    if known.limit(1).count():
        own = own.join(known, "path", "left").where("_known is null or _known <> hash")
    else:
        own = own.withColumn("_known", F.lit(None).cast("string"))
    words = F.regexp_extract_all(text.fold_ascii(F.col("text")), F.lit(config["word"]), 0)
    counted = own.select("path", words.alias("words")).where("size(words) > 0").select("path", F.inline(tally(F.col("words")))).select("word", "path", "n")
    if again:  # a path may have a text in two languages
        counted = counted.groupBy("word", "path").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("bucket", bucket_of("word", config["buckets"]))
    ordered = counted.repartitionByRange("bucket", "word", "path").sortWithinPartitions("bucket", "word", "path")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings/run={number}")
    action = F.when(F.col("_known").isNull(), "new").otherwise("changed")
    state = own.select("path", "language", "hash", F.octet_length("text").cast("long").alias("size"), F.size(words).cast("long").alias("words"), action.alias("action"))
    state.write.mode("overwrite").partitionBy("language").parquet(f"{out}/files/run={number}")
    done = {r.action: r.n for r in _written(spark, f"{out}/files", FILES).where(F.col("run") == number).groupBy("action").agg(F.count("*").alias("n")).collect()}
    wrote = _written(spark, f"{out}/postings", POSTINGS).where(F.col("run") == number).count()
    log.info("word_index run %d: read %d rows, wrote %d new and %d changed files, %d postings", number, batch.count(), done.get("new", 0), done.get("changed", 0), wrote)


def run(spark: SparkSession, data: str, out: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Take what is new in ``data`` into the index at ``out``, wait for the stream's end, and return the index as it stands."""
    config, data = config or settings("word_index"), data.rstrip("/")
    pattern = f"{data[:-1]}[{data[-1]}]"  # a file stream takes a single file only by a pattern; a folder's files match it too
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern)
    each = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, out, config))
    query = each.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("word_index: %d batches of %s", len([p for p in query.recentProgress if p["numInputRows"]]), data)
    return postings(spark, out)


if __name__ == "__main__":
    command_line("word_index", __doc__.splitlines()[0], run)
