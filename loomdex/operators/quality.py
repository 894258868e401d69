"""Checks of an index's integrity: each gives rows, and a healthy index gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import postings


def orphans(problem: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """problem, key for each key of ``left`` that ``right`` lacks."""
    return left.join(right, "key", "left_anti").select(F.lit(problem).alias("problem"), "key")


def problems(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with an unknown end, and which: source, target or both."""
    mark = lambda df, c, name: df.select(c).distinct().withColumn(name, F.lit(True))
    seen = edges.join(mark(sources, src, "_s"), src, "left").join(mark(targets, dst, "_t"), dst, "left")
    kind = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both").when(F.col("_t").isNull(), "target").when(F.col("_s").isNull(), "source")
    return seen.withColumn("kind", kind).where("kind is not null").drop("_s", "_t")


def unresolved(refs: DataFrame, known: DataFrame, ref: str, name: str, separators: tuple[str, ...] = (".", "/")) -> DataFrame:
    """References that are neither a known name nor its end after a separator: known names are spelled out by their ends, so the join is equal."""
    cut = "[" + "".join(separators) + "]"
    whole = known.select(F.col(name).alias("_n")).distinct()
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.length("_n")), lambda k: F.rlike(F.substr(F.col("_n"), k, F.lit(1)), F.lit(cut))), lambda k: F.substr(F.col("_n"), k + 1))
    ends = whole.select(F.explode(F.concat(F.array("_n"), starts)).alias(ref)).distinct()
    return refs.join(ends, ref, "left_anti").select(*refs.columns)


def low_resolution(rate: DataFrame, least: float = 0.30) -> DataFrame:
    """A problem row if there are calls and too few are resolved."""
    return rate.where((F.col("total") > 0) & (F.col("rate") < least)).select(F.lit("call resolution is low").alias("problem"), F.col("rate").cast("string").alias("key"))


def undocumented(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """A problem row if there are changes and no history document (``documents`` has a name each)."""
    none = documents.limit(1).groupBy().agg(F.count("*").alias("n"))
    return changes.limit(1).select(F.lit("changes without a history document").alias("problem"), F.lit("history").alias("key")).join(F.broadcast(none.where("n = 0")), how="left_semi")


def doctor(t: dict[str, DataFrame], disk: DataFrame, rate: DataFrame, total: int, documents: DataFrame | None = None) -> DataFrame:
    """problem, key of the whole index; ``t`` are its tables by name, ``disk`` the paths there are now, ``documents`` the history documents where these are kept."""
    key = lambda df, c: df.select(F.col(c).cast("string").alias("key")).distinct()
    on_disk, known = key(disk, "path"), key(t["files"], "path")
    names = key(t["symbols"], "qualified_name").union(known)
    ws = key(t["working_set"], "page_id")
    tokens = t["working_set"].groupBy("session_id", "plan_id", "batch_id").agg(F.sum("tokens").alias("n")).where(F.col("n") > total)
    return problems(
        orphans("symbols of a file that is gone", key(t["symbols"], "file"), on_disk), orphans("reference from an unknown file", key(t["refs"], "src_file"), known), orphans("reference to an unknown file", key(t["refs"], "dst_file"), known),
        orphans("calls of an unknown file", key(t["raw_calls"], "file"), known), orphans("working set entry without page", ws, names), low_resolution(rate),
        tokens.select(F.lit("working set over budget").alias("problem"), F.concat_ws("/", "session_id", "plan_id", "batch_id").alias("key")),
        *([postings.stale(t["symbols"], t["sizes"])] if "sizes" in t else []), *([] if documents is None else [undocumented(t["changes"], documents)]),
    )
