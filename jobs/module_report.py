"""Which modules of a code base call which, which of their symbols are called most, and how many of their calls can be told at all.

Reads the driver's tables as an index's symbols, imports and calls (``loomdex.bindings``), resolves every call, and writes

* ``calls/module=<m>``: src, dst (null where a call can't be resolved), dst_module, n: the resolved calls of a module's symbols, once;
* ``dependencies/module=<m>``: dst_module, calls, callers, callees (distinct symbols);
* ``hottest/module=<m>``: symbol, callers, calls, rank: its ``hottest`` most called symbols, by distinct callers, then name;
* ``rates/module=<m>``: calls, resolved, rate;
* ``alike``: src_qname, callee_raw, home, owner, n: the calls of one symbol that read alike, from which the four are made.

A module is a file's first folder. Every run writes all tables anew, so a second one over the same input gives the same rows, and one that
broke off is mended by running it again.

Callers are aggregated before they meet their modules; the hottest are ranked after a partial limit (Spark's own for ranks), so no module's symbols
gather in one task. Files are cut by ranges of module and symbol, so a large module has as many as its size asks for.

    python -m jobs.module_report --data DIR --out DIR [--config FILE]
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, log, settings
from loomdex import bindings
from loomdex.functions import text
from loomdex.operators import resolve
from loomdex.runtime import hinted, join_hint

#: Calls whose caller is no symbol of the index belong to no module.
NOWHERE = "(none)"


def alike(symbols: DataFrame, raw_calls: DataFrame, by: str | None = None) -> DataFrame:
    """src_qname, callee_raw, home, owner, n: the calls of one symbol that read alike, its file, and, of calls of a sibling, beside what."""
    homes = symbols.groupBy(F.col("qualified_name").alias("src_qname")).agg(F.min("file").alias("home"))
    counted = raw_calls.groupBy("src_qname", "callee_raw").agg(F.count("*").alias("n"))
    beside = F.when(F.col("callee_raw").rlike(r"^(self|cls)\."), F.regexp_replace("src_qname", r"\.[^.]*$", "")).otherwise("")
    return counted.join(hinted(homes, by), "src_qname", "left").select("src_qname", "callee_raw", "home", beside.alias("owner"), "n")


def resolved(asked: DataFrame, symbols: DataFrame, refs: DataFrame, by: str | None = None) -> DataFrame:
    """module, src, dst_module, dst, n of what ``alike`` gives, not yet summed: what a text means in a file is resolved once, for one of its callers.
    ``by`` is the joins' hint.
    """
    question = ["home", "owner", "callee_raw"]
    once = asked.where("home is not null").groupBy(*question).agg(F.min("src_qname").alias("src_qname"))
    answers = resolve.resolve_calls(once, symbols, refs, by, True).where("dst_qname is not null")
    homes = symbols.groupBy(F.col("qualified_name").alias("dst_qname")).agg(text.top_module(F.min("file")).alias("dst_home"))
    answers = answers.join(hinted(homes, by), "dst_qname").select(*question, "dst_qname", "dst_home")
    both = asked.join(hinted(answers, by), question, "left")
    other = F.col("dst_qname") != F.col("src_qname")
    module = F.when(F.col("home").isNull(), NOWHERE).otherwise(text.top_module(F.col("home")))
    return both.select(module.alias("module"), F.col("src_qname").alias("src"), F.when(other, F.col("dst_home")).alias("dst_module"), F.when(other, F.col("dst_qname")).alias("dst"), "n")


def summed(calls: DataFrame) -> DataFrame:
    return calls.groupBy("module", "src", "dst_module", "dst").agg(F.sum("n").alias("n"))


def module_calls(symbols: DataFrame, raw_calls: DataFrame, refs: DataFrame) -> DataFrame:
    """module, src, dst_module, dst, n of all calls, by caller and callee; calls of one caller that read alike are resolved once."""
    return summed(resolved(alike(symbols, raw_calls), symbols, refs))


def dependencies(calls: DataFrame) -> DataFrame:
    known = calls.where("dst is not null").groupBy("module", "dst_module")
    return known.agg(F.sum("n").alias("calls"), F.countDistinct("src").alias("callers"), F.countDistinct("dst").alias("callees"))


def hottest(calls: DataFrame, most: int) -> DataFrame:
    called = calls.where("dst is not null").groupBy(F.col("dst_module").alias("module"), F.col("dst").alias("symbol")).agg(F.count("*").alias("callers"), F.sum("n").alias("calls"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("callers"), "symbol"))
    return called.withColumn("rank", rank).where(F.col("rank") <= most)


def rates(calls: DataFrame) -> DataFrame:
    sums = calls.groupBy("module").agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(F.col("dst").isNotNull(), F.col("n"))), F.lit(0)).alias("resolved"))
    return sums.withColumn("rate", F.round(F.col("resolved") / F.col("calls"), 4))


def _read_back(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    log.info("module_report: wrote %d rows to %s", n := back.count(), path)
    return back, n


def _write(rows: DataFrame, path: str, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write a table by module and read it back; ``whole`` is done to rows that were dealt by all columns but n, where they lie."""
    columns = [c for c in rows.columns if c != "module"]
    keys = [c for c in columns if c != "n"] if whole else columns
    dealt = rows.select(*columns, "module").repartitionByRange("module", *keys)
    dealt = whole(dealt).select(*columns, "module") if whole else dealt
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("module").parquet(path)
    return _read_back(dealt, path)[0]


def run(spark: SparkSession, data: str, out: str, config: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Write the report on the tables in ``data`` to ``out``; returns its tables, read back."""
    config, symbols, by = config or settings("module_report"), bindings.symbols(spark, data), bindings.symbol_joins(spark, data)
    texts = alike(symbols, bindings.raw_calls(spark, data), by)
    texts.write.mode("overwrite").parquet(f"{out}/alike")
    asked, many = _read_back(texts, f"{out}/alike")
    calls = _write(resolved(asked, symbols, bindings.import_refs(spark, data), by or join_hint(many)), f"{out}/calls", summed)
    log.info("module_report: read %d calls from %s", calls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], data)
    reports = {"dependencies": dependencies(calls), "hottest": hottest(calls, config["hottest"]), "rates": rates(calls)}
    return {"calls": calls} | {name: _write(rows, f"{out}/{name}") for name, rows in reports.items()}


if __name__ == "__main__":
    command_line("module_report", __doc__.splitlines()[0], run)
