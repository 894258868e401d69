"""What a change touches in the open plans: named references, symbols a few calls away, and references that merely look alike."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators import changes, graph
from loomdex.runtime import checkpoint

OPEN = ("approved", "executing", "blocked")


def token_overlap(planned: DataFrame, changed: DataFrame, planned_key: str, planned_ref: str, changed_key: str, changed_ref: str) -> DataFrame:
    """For each planned reference the first changed one that shares a word, and the shared words.

    The first that shares a word is the least of its words' least keys, so only that pair is spelled out: rows stay linear in the words, however
    common one is.
    """
    words = lambda df, key, ref: df.select(key, F.explode(text.lexical_tokens(F.col(ref))).alias("word")).distinct()
    own, other = words(planned, planned_key, planned_ref), words(changed, changed_key, changed_ref)
    least = other.groupBy("word").agg(F.min(changed_key).alias(changed_key))
    first = own.join(least, "word").groupBy(planned_key).agg(F.min(changed_key).alias(changed_key))
    shared = own.join(first, planned_key).join(other, [changed_key, "word"], "left_semi")
    return shared.groupBy(planned_key, changed_key).agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("overlap"))


def basename_match(changed: DataFrame, planned: DataFrame, path: str, ref: str, keys: list[str]) -> DataFrame:
    """For each changed file the first planned file of the same name in another folder: the least of its name, or the next where that is itself."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    own = planned.select(name(ref).alias("_name"), F.col(ref).alias("_ref")).distinct()
    first = own.groupBy("_name").agg(F.min("_ref").alias("_first"))
    second = own.join(first, "_name").where("_ref > _first").groupBy("_name").agg(F.min("_ref").alias("_second"))
    both = first.join(second, "_name", "left")
    met = changed.withColumn("_name", name(F.col(path))).join(both, "_name")
    other = F.when(F.col("_first") != F.col(path), F.col("_first")).otherwise(F.col("_second"))
    return met.select(*keys, path, other.alias(ref)).where(F.col(ref).isNotNull()).distinct()


def planned_refs(tasks: DataFrame, plans: DataFrame, column: str) -> DataFrame:
    """plan_id, batch, ref, task: references of tasks (the first task of a batch), then those of the plan itself as batch ``unassigned``.

    ``column`` is ``files`` or ``symbols``; a symbol that a task names is not given again for the plan.
    """
    batch = F.when(F.trim(F.coalesce("batch", F.lit(""))) == "", "unassigned").otherwise(F.trim("batch"))
    own = tasks.select("plan_id", batch.alias("batch"), "number", F.explode(column).alias("ref"))
    first = own.groupBy("plan_id", "batch", "ref").agg(F.min("number").alias("task"))
    loose = plans.select("plan_id", F.explode(column).alias("ref")).where(F.trim("ref") != "").distinct()
    if column == "symbols":
        loose = loose.join(own.select("plan_id", "ref").distinct(), ["plan_id", "ref"], "left_anti")
    loose = loose.join(first.where("batch = 'unassigned'").select("plan_id", "ref"), ["plan_id", "ref"], "left_anti")
    return first.select("plan_id", "batch", "ref", "task").unionByName(loose.select("plan_id", F.lit("unassigned").alias("batch"), "ref", F.lit(None).cast("int").alias("task")))


SHAPE = ("plan_id", "level", "batch", "kind", "ref", "task", "confidence", "changed_ref", "reason", "direction", "graph_depth")
#: The order in which a plan's rows are cut, and that of its possible ones of one confidence.
ORDER, LIKELIER = ("level", "batch", "kind", "ref", "changed_ref"), ("batch", "ref", "changed_ref")


def _rows(df: DataFrame, level: str, kind: str | None = None, **given) -> DataFrame:
    """``df`` in the common shape; columns that are not given are null."""
    text_ = lambda: F.lit(None).cast("string")
    base = {"changed_ref": text_(), "reason": text_(), "direction": text_(), "graph_depth": F.lit(None).cast("int")} | given
    return df.select("plan_id", F.lit(level).alias("level"), "batch", (F.lit(kind) if kind else F.col("kind")).alias("kind"), "ref", "task", *[base[c].alias(c) for c in SHAPE[6:]])


def _direct(tasks: DataFrame, changed: DataFrame) -> DataFrame:
    batch = F.when(F.trim(F.coalesce("batch", F.lit(""))) == "", "unassigned").otherwise(F.trim("batch")).alias("batch")
    of = lambda kind, column: tasks.select("plan_id", batch, "number", F.lit(kind).alias("kind"), F.explode(column).alias("ref"))
    named = of("file", "files").unionByName(of("symbol", "symbols"))
    return named.join(changed, ["kind", "ref"]).groupBy("plan_id", "batch", "kind", "ref").agg(F.min("number").alias("task"))


def _indirect(planned: DataFrame, changed: DataFrame, index: DataFrame, edges: DataFrame, depth: int, nodes: int | None, parts: int | None) -> tuple[DataFrame, bool]:
    of_files = index.join(changed.where("kind = 'file'").select(F.col("ref").alias("file")), "file", "left_semi").select("qualified_name")
    roots = changed.where("kind = 'symbol'").select(F.col("ref").alias("node")).union(of_files)
    hits, cut = graph.search(edges, roots, planned.select(F.col("ref").alias("node")).distinct(), depth, nodes, parts)
    own = planned.groupBy("plan_id", "ref").agg(F.max(F.struct("batch", "task")).alias("at")).select("plan_id", "ref", "at.batch", "at.task")
    return own.join(hits, F.col("ref") == F.col("node")), cut


def _alike(planned: DataFrame, direct: DataFrame, changed: DataFrame) -> DataFrame:
    """Planned symbols, not named directly, that share a word with a changed one."""
    loose = planned.join(direct.select("plan_id", "ref").distinct(), ["plan_id", "ref"], "left_anti").withColumn("key", F.concat_ws("\x1f", "plan_id", "batch", "ref"))
    names = changed.where("kind = 'symbol'").select(F.col("ref").alias("changed_ref")).withColumn("_c", F.col("changed_ref"))
    met = loose.join(token_overlap(loose, names, "key", "ref", "changed_ref", "_c"), "key")
    return met.select("plan_id", "batch", "ref", "task", "changed_ref", F.concat(F.lit("lexical overlap: "), "overlap").alias("reason"), F.lit("symbol").alias("kind"), F.lit(0.55).alias("confidence"))


def _same_name(planned: DataFrame, changed: DataFrame) -> DataFrame:
    """Planned files of a changed file's name in another folder: of each plan and changed file the first."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    moved = changed.where("kind = 'file'").select(F.col("ref").alias("path"), name("ref").alias("_name"))
    met = planned.withColumn("_name", name("ref")).join(moved, "_name").where("ref <> path")
    same = met.groupBy("plan_id", "path").agg(F.min(F.struct("ref", "batch", "task")).alias("at")).select("plan_id", "path", "at.*")
    reason = F.lit("same file basename in a different path").alias("reason")
    return same.select("plan_id", "batch", "ref", "task", F.col("path").alias("changed_ref"), reason, F.lit("file").alias("kind"), F.lit(0.5).alias("confidence"))


class Touched(NamedTuple):
    """Every row of an impact, and whether the search behind the indirect ones met its bound."""

    rows: DataFrame
    cut: bool


def everything(
    plans: DataFrame, tasks: DataFrame, files: list[str] | DataFrame, symbols: list[str] | None, index: DataFrame | None, edges: DataFrame | None, depth: int = 2, nodes: int | None = None, parts: int | None = None
) -> Touched:
    """All that a change touches in open plans, in the shape of ``SHAPE``.

    ``direct``: a task names it. ``indirect``: a planned symbol within ``depth`` calls of a changed one, by a search of at most ``nodes`` nodes (None:
    the whole search). ``possible``: a shared word, or a file of the same name. What changed is given as two lists, or as one table (kind, ref) of any
    size. ``index`` are symbols, ``edges`` calls, which the search deals to ``parts`` tasks.
    """
    spark = plans.sparkSession
    plans = plans.where(F.col("status").isin(*OPEN))
    tasks = tasks.join(plans.select("plan_id"), "plan_id", "left_semi")
    lists = lambda: [("file", x) for x in sorted(set(files))] + [("symbol", x) for x in sorted(set(symbols))]
    changed = files if isinstance(files, DataFrame) else spark.createDataFrame(lists(), "kind string, ref string")
    direct, cut = _direct(tasks, changed), False
    found = _rows(direct, "direct", confidence=F.lit(1.0))
    planned_symbols, planned_files = planned_refs(tasks, plans, "symbols"), planned_refs(tasks, plans, "files")
    if index is not None and edges is not None and depth > 0:
        indirect, cut = _indirect(planned_symbols, changed, index, edges, depth, nodes, parts)
        how = {"confidence": text.impact_confidence(F.col("depth")), "changed_ref": F.col("via"), "direction": F.col("direction"), "graph_depth": F.col("depth")}
        found = found.unionByName(_rows(indirect, "indirect", "symbol", **how))
    maybe = _alike(planned_symbols, direct, changed).unionByName(_same_name(planned_files, changed))
    return Touched(found.unionByName(_rows(maybe, "possible", confidence=F.col("confidence"), changed_ref=F.col("changed_ref"), reason=F.col("reason"))), cut)


def bounded(rows: DataFrame, possible: int = 12, most: int = 200) -> DataFrame:
    """At most ``most`` rows of each plan, of them at most ``possible`` possible ones, and beside each row how many its plan has without these bounds:
    ``plan_rows`` in all and ``plan_possible`` possible ones. Rows are cut by level, batch, kind and reference; possible ones by confidence first.
    """
    rows = checkpoint(rows)
    maybe = changes.top_per_key(rows.where("level = 'possible'"), ["plan_id"], [F.desc("confidence"), *LIKELIER], possible, "plan_possible")
    counts = rows.groupBy("plan_id").agg(F.count("*").alias("plan_rows"), F.count_if(F.col("level") == "possible").alias("plan_possible"))
    kept = rows.where("level <> 'possible'").unionByName(maybe.drop("plan_possible"))
    return changes.top_per_key(kept, ["plan_id"], list(ORDER), most).drop("of").join(counts, "plan_id")


def impact(plans: DataFrame, tasks: DataFrame, files: list[str] | DataFrame, symbols: list[str] | None, index: DataFrame | None, edges: DataFrame | None, depth: int = 2, nodes: int | None = None, possible: int = 12, most: int = 200, parts: int | None = None) -> DataFrame:
    """``everything``, ``bounded``, with ``search_cut``: whether a search of at most ``nodes`` nodes left some unseen."""
    found = everything(plans, tasks, files, symbols, index, edges, depth, nodes, parts)
    return bounded(found.rows, possible, most).withColumn("search_cut", F.lit(found.cut))


def source_paths(refs: DataFrame, overrides: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, source_path: the file that an override (ref, path) says, else the index's, else empty."""
    known = symbols.groupBy(F.col("qualified_name").alias("ref")).agg(F.min("file").alias("_indexed"))
    said = overrides.groupBy("ref").agg(F.min("path").alias("_said"))
    return refs.select("ref").distinct().join(said, "ref", "left").join(known, "ref", "left").select("ref", F.coalesce("_said", "_indexed", F.lit("")).alias("source_path"))
