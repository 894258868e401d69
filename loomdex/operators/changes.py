"""Change detection between two states of an index, rename pairing, and questions to the append-only change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.functions.udf import body_difference
from loomdex.runtime import checkpoint


def file_actions(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """path, action for each path of either side: ``deleted``, ``new``, ``same`` (size equal, times within a microsecond), ``touch`` (hash equal), ``changed``."""
    s, n = stored.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"), F.col("hash").alias("s_hash"), F.lit(1).alias("s")), seen.select("path", "size", "mtime", "hash", F.lit(1).alias("n"))
    both = s.join(n, "path", "full_outer")
    action = (
        F.when(F.col("n").isNull(), "deleted").when(F.col("s").isNull(), "new")
        .when((F.col("s_size") == F.col("size")) & (F.abs(F.col("s_mtime") - F.col("mtime")) < 1e-6), "same")
        .when(F.col("s_hash") == F.col("hash"), "touch").otherwise("changed")
    )
    return both.select("path", action.alias("action"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str], body: str | None = None) -> DataFrame:
    """Keys of rows that differ, with change_type: removed, added, signature_changed (any of ``compared``), signature_stable (only ``body``).

    One full outer join on the keys; both sides keep their columns as ``old_*`` and ``new_*``.
    """
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(differs, "signature_changed")
    if body:
        a, b = F.col(f"old_{body}"), F.col(f"new_{body}")
        kind = kind.when(text.body_comparable(a, b) & ~a.eqNullSafe(b), "signature_stable")
    return both.withColumn("change_type", kind).where("change_type is not null").drop("_old", "_new")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, symbol, name, change_type, old_value, new_value, detail, at: changes of symbols within their file, removals first."""
    columns = ["file", "qualified_name", "name", "signature", "params", "returns", "body", "seq"]
    diff = snapshot_diff(old.select(columns), new.select(columns), ["file", "qualified_name"], ["signature", "params", "returns"], "body")
    detail = F.when(F.col("change_type") == "signature_stable", body_difference(F.col("old_body"), F.col("new_body"))).otherwise("")
    at = F.struct((F.col("change_type") != "removed").alias("later"), F.coalesce("new_seq", "old_seq").alias("seq"))
    return diff.select("file", F.col("qualified_name").alias("symbol"), F.coalesce("new_name", "old_name").alias("name"), "change_type", F.col("old_signature").alias("old_value"), F.col("new_signature").alias("new_value"), detail.alias("detail"), at.alias("at"))


def pair_renames(changes: DataFrame) -> DataFrame:
    """The i-th removal and the i-th addition of one file and signature shape become one ``renamed`` row (old name, new name).

    ``changes`` has file, symbol, name, change_type, old_value, new_value, detail, at; ``at`` orders the rows of a file.
    """
    side = F.when((F.col("change_type") == "removed") & (F.col("old_value") != ""), "r").when((F.col("change_type") == "added") & (F.col("new_value") != ""), "a")
    shape = text.signature_shape(F.coalesce("new_value", "old_value"), text.last_segment(F.col("symbol")))
    marked = changes.withColumn("side", side).withColumn("shape", F.when(side.isNotNull(), shape))
    order = Window.partitionBy("file", "shape", "side").orderBy("at", "symbol")
    marked = marked.withColumn("n", F.when(F.col("side").isNotNull(), F.row_number().over(order)))
    pair = Window.partitionBy("file", "shape", "n")
    marked = marked.withColumn("was", F.max(F.when(F.col("side") == "r", F.col("symbol"))).over(pair)).withColumn("now", F.max(F.when(F.col("side") == "a", F.col("symbol"))).over(pair))
    paired = F.col("side").isNotNull() & F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))
    renamed = F.coalesce(paired, F.lit(False)) & (F.col("side") == "a")
    out = marked.where(~(F.coalesce(paired, F.lit(False)) & (F.coalesce("side", F.lit("")) == "r")))
    pick = lambda c, other: F.when(renamed, other).otherwise(F.col(c))
    return out.select("file", "symbol", "name", pick("change_type", F.lit("renamed")).alias("change_type"), pick("old_value", F.col("was")).alias("old_value"), pick("new_value", F.col("now")).alias("new_value"), "detail", "at")


def rename_pairs(removed: DataFrame, added: DataFrame, group: list[str], symbol: str, order: list[str]) -> DataFrame:
    """The i-th removed and the i-th added symbol of each group, as old and new."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    r = removed.select(*group, F.col(symbol).alias("old_symbol"), number.alias("n"))
    a = added.select(*group, F.col(symbol).alias("new_symbol"), number.alias("n"))
    return r.join(a, [*group, "n"]).where("old_symbol <> new_symbol").drop("n")


def history(log: DataFrame, symbol: str, limit: int = 200) -> DataFrame:
    """A symbol's changes, oldest first: a dotted name exactly, a bare name wherever it ends a name. No character is a wildcard."""
    own = F.col("symbol") == symbol if "." in symbol else text.fold_ascii(F.col("symbol")).endswith("." + symbol.lower()) | (F.col("symbol") == symbol)
    return log.where(own).orderBy("ts", "run_id", "seq").limit(limit)


def renames(log: DataFrame) -> DataFrame:
    """id, symbol, old, before: every rename, and the last one before it that gave the name it started from; null where there is none.

    ``id`` is (ts, run_id, seq), the log's order, so a name that was used twice leads to the right one, and no chain comes back to itself. Renames to
    and from a name are put side by side in that order; a name's renames are sorted in one task, which spills.
    """
    own = log.where((F.col("change_type") == "renamed") & F.col("old_value").isNotNull() & (F.col("old_value") != F.col("symbol")))
    own = own.select(F.struct("ts", "run_id", "seq").alias("id"), "symbol", F.col("old_value").alias("old"))
    ends = F.array(F.struct(F.col("old").alias("name"), F.lit(True).alias("starts")), F.struct(F.col("symbol").alias("name"), F.lit(False).alias("starts")))
    given = F.last(F.when(~F.col("starts"), F.col("id")), ignorenulls=True).over(Window.partitionBy("name").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return own.select("id", "symbol", "old", F.inline(ends)).withColumn("before", given).where("starts").select("id", "symbol", "old", "before")


def chains(steps: DataFrame) -> DataFrame:
    """id, symbol, old, root, origin, renames: of every rename the first of its chain, the name that it started from, and how many lead from there.

    By pointer jumping: in each round a rename's reach doubles, so there are as many rounds as the longest chain has binary digits.
    """
    up = checkpoint(steps.select("id", F.col("before").alias("up"), F.col("id").alias("root"), F.col("old").alias("origin"), F.lit(1).cast("long").alias("n")))
    while up.where("up is not null").limit(1).count():
        ahead = up.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("origin").alias("_origin"), F.col("n").alias("_n"))
        met = up.join(ahead, "up", "left")
        up = checkpoint(met.select("id", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), F.coalesce("_origin", "origin").alias("origin"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
    return steps.join(up.select("id", "root", "origin", F.col("n").alias("renames")), "id").select("id", "symbol", "old", "before", "root", "origin", "renames")


def lineages(log: DataFrame) -> DataFrame:
    """symbol, origin, renames: of every symbol that was ever renamed to, its first name and how many renames lead from there."""
    last = F.max_by(F.struct("origin", "renames"), "id").alias("last")
    return chains(checkpoint(renames(log))).groupBy("symbol").agg(last).select("symbol", "last.*")


def lineage(log: DataFrame, symbol: str) -> list[str]:
    """A symbol's name and its former names, newest first, however many: the renames of its own chain come to the driver in one step."""
    every = checkpoint(chains(checkpoint(renames(log))))
    last = every.where(F.col("symbol") == symbol).orderBy(F.desc("id")).first()
    if last is None:
        return [symbol]
    same = [F.col(f"root.{c}").eqNullSafe(F.lit(last.root[c])) for c in ("ts", "run_id", "seq")]
    own = {r.id: r for r in every.where(same[0] & same[1] & same[2]).select("id", "old", "before").collect()}
    names, at = [symbol], last.id
    while at is not None:
        names.append(own[at].old)
        at = own[at].before
    return list(dict.fromkeys(names))


def last_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregates meet, so no key's rows gather in one task."""
    rest = [c for c in log.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("top")
    return log.groupBy(*keys).agg(top).select(*keys, "top.*")


def top_per_key(df: DataFrame, keys: list[str], order: list, most: int, number: str = "of") -> DataFrame:
    """At most ``most`` rows of each key, by ``order``, and beside each the exact number that its key has.

    Ranks are cut in every task before the shuffle, and the number is a plain count, so no key's rows gather; ``df`` is read twice.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n").join(df.groupBy(*keys).agg(F.count("*").alias(number)), keys)


def change_counts(log: DataFrame, suffix: str) -> DataFrame:
    """symbol, n of symbols that end in ``.suffix`` (ASCII case folded)."""
    return log.where(text.fold_ascii(F.col("symbol")).endswith("." + suffix.lower())).groupBy("symbol").agg(F.count("*").alias("n"))


def gaps(log: DataFrame, keys: list[str], ts: str, minutes: int = 30) -> DataFrame:
    """Rows that come ``minutes`` or more after the row before them of their key, with that gap in seconds."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    seconds = F.timestamp_diff("SECOND", before, F.col(ts))
    return log.withColumn("gap_seconds", seconds).where(F.col("gap_seconds") >= minutes * 60)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``: what a merge into a plain table is."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return last_per_key(df, keys, order).select(*df.columns)
