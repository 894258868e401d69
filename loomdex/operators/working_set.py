"""The working set of context pages: scope, scores, eviction, budgets, rendering order, and how fresh pages are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.runtime import checkpoint

SCOPE = ("session_id", "plan_id", "batch_id")
TOTAL, RESIDENT, PAGES = 8000, 6000, 50


def in_scope(ws: DataFrame, session_id: str = "", plan_id: str = "", batch_id: str = "") -> DataFrame:
    """Entries of a scope: without any part the global ones; otherwise every given part must be equal."""
    parts = dict(zip(SCOPE, (session_id, plan_id, batch_id), strict=True))
    given = {k: v for k, v in parts.items() if v}
    for k in given or parts:
        ws = ws.where(F.col(k) == parts[k])
    return ws


def running(value: str, keys: list[str], order: list[Column], inclusive: bool) -> Column:
    """Sum of ``value`` over the rows before (and, inclusive, with) each row of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def evictions(scored: DataFrame, need: Column, keys: list[str] = [*SCOPE], order: tuple[str, ...] = ("page_id",)) -> DataFrame:  # noqa: B006
    """The coldest entries that are not pinned, as many as it takes to free ``need`` tokens in their scope, with what those before them free."""
    loose = scored.where(~F.col("pinned"))
    return loose.withColumn("freed_before", running("tokens", keys, [F.col("score"), *map(F.col, order)], False)).where(F.col("freed_before") < need)


def running_wide(rows: DataFrame, value: str, need: DataFrame, keys: list[str], order: list[str], name: str = "before") -> DataFrame:
    """``rows`` whose running sum before them (``name``) is under their key's ``need`` (keys, need), where one key may hold most rows.

    Rows are dealt by ranges of key and order and kept so. Each range's sums by key are a small table, whose own running sums say where a range
    begins; ranges that begin at or beyond the need go before anything is summed, and the others are summed each for itself. ``order`` decides ties.
    """
    dealt = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    begins = sums.withColumn("_begin", running("_sum", keys, [F.col("_part")], False)).join(need.withColumnRenamed("need", "_need"), keys).where("_begin < _need")
    near = dealt.join(begins.select(*keys, "_part", "_begin", "_need"), [*keys, "_part"])
    summed = near.withColumn(name, F.col("_begin") + running(value, [*keys, "_part"], [F.col(c) for c in order], False))
    return summed.where(F.col(name) < F.col("_need")).select(*rows.columns, name)


def evictions_wide(scored: DataFrame, need: DataFrame, keys: list[str] = [*SCOPE], order: tuple[str, ...] = ("page_id",)) -> DataFrame:  # noqa: B006
    """``evictions`` for scopes of any size, one of which may hold most entries; ``need`` has each scope's tokens (keys, need)."""
    return running_wide(scored.where(~F.col("pinned")), "tokens", need, keys, ["score", *order], "freed_before")


def enforce(scored: DataFrame, resident: int = RESIDENT, pages: int = PAGES, keys: list[str] = [*SCOPE]) -> DataFrame:  # noqa: B006
    """page ids to evict, with reason: first for tokens beyond ``resident``, then for pages beyond ``pages``; pinned pages stay."""
    used = Window.partitionBy(*keys)
    sized = scored.withColumn("over", F.sum("tokens").over(used) - resident).withColumn("n", F.count("*").over(used))
    gone = evictions(sized, F.col("over"), keys).withColumn("reason", F.lit("tokens"))
    left = sized.join(gone.select(*keys, "page_id"), [*keys, "page_id"], "left_anti")
    left = left.withColumn("extra", F.count("*").over(used) - pages).where(~F.col("pinned"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", "page_id"))
    crowded = left.withColumn("rank", rank).where(F.col("rank") <= F.col("extra")).withColumn("reason", F.lit("pages"))
    return gone.select(*keys, "page_id", "tokens", "reason").unionByName(crowded.select(*keys, "page_id", "tokens", "reason"))


def rendered(ws: DataFrame, total: Column, keys: list[str] = [*SCOPE], order: tuple[Column, ...] | None = None) -> DataFrame:  # noqa: B006
    """The latest entries whose tokens together stay within ``total``; the first is always there."""
    by = list(order or (F.desc("last_access_at"), F.col("page_id")))
    ranked = ws.withColumn("used", running("tokens", keys, by, True)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.where((F.col("used") <= total) | (F.col("rank") == 1))


def excerpt(sources: DataFrame, most: int = 800) -> DataFrame:
    """page_id, excerpt: the leading lines of a source whose tokens (and one a line) stay within ``most``; the first line is always there."""
    lines = sources.select("page_id", F.posexplode(F.split("source", "\n")).alias("at", "row"))
    cost = lines.withColumn("cost", text.estimate_tokens(F.col("row")) + 1)
    used = cost.withColumn("used", running("cost", ["page_id"], [F.col("at")], True)).where((F.col("used") <= most) | (F.col("at") == 0))
    return used.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), "\n").alias("excerpt"))


def greedy(rows: DataFrame, room: int, keys: list[str], order: list[str], cost: str = "cost", name: str = "name") -> DataFrame:
    """name of the rows that a walk in order keeps, skipping each that no longer fits: a fold, for later rows may fit where earlier did not."""
    step = F.struct(*order, F.col(cost).cast("long").alias("_c"), F.col(name).alias("_n"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(step)), F.struct(F.lit(room).cast("long").alias("room"), F.array().cast("array<string>").alias("kept")),
        lambda a, r: F.when(r["_c"] <= a["room"], F.struct((a["room"] - r["_c"]).alias("room"), F.concat(a["kept"], F.array(r["_n"].cast("string"))).alias("kept"))).otherwise(a),
    )
    return rows.groupBy(*keys).agg(folded.alias("f")).select(*keys, F.explode("f.kept").alias(name))


def greedy_walk(rows: DataFrame, room: int, order: list[str], cost: str = "cost", name: str = "name", chunk: int = 10_000) -> list:
    """``greedy`` over one list of any length: names in order, kept on the driver, for ``room`` bounds how many there can be.

    Each round takes the next ``chunk`` rows that could still fit; the first of them always does, so rounds are few. ``order`` must be unique.
    """
    kept: list = []
    after = None
    while True:
        left = rows.where(F.col(cost) <= room)
        if after is not None:
            left = left.where(F.struct(*order) > F.struct(*[F.lit(after[c]).cast(rows.schema[c].dataType).alias(c) for c in order]))
        part = left.orderBy(*order).limit(chunk).select(*{*order, cost, name}).collect()
        if not part:
            return kept
        for r in part:
            if r[cost] <= room:
                room -= r[cost]
                kept.append(r[name])
        after = part[-1]


def usage(ws: DataFrame, total: int = TOTAL, pages: int = PAGES, keys: list[str] = [*SCOPE]) -> DataFrame:  # noqa: B006
    """Tokens and pages of each scope and what they are over the budget."""
    used = ws.groupBy(*keys).agg(F.sum("tokens").alias("usage"), F.count("*").alias("pages"))
    over = used.withColumn("over_tokens", F.greatest(F.lit(0), F.col("usage") - total)).withColumn("over_pages", F.greatest(F.lit(0), F.col("pages") - pages))
    return over.withColumn("ok", (F.col("over_tokens") == 0) & (F.col("over_pages") == 0)).withColumn("percent", F.round(F.col("usage") * 100 / total, 1))


def status(ws: DataFrame, symbols: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Each entry as fresh, stale (its file's hash is another than at loading) or gone (its symbol or file is)."""
    own = symbols.groupBy(F.col("qualified_name").alias("page_id")).agg(F.min("file").alias("symbol_file"))
    hashes = files.select(F.col("path").alias("of_file"), "hash")
    at_load = pages.select("page_id", "version")
    joined = ws.join(own, "page_id", "left").withColumn("of_file", F.when(text.is_file_page(F.col("page_id")), F.col("page_id")).otherwise(F.col("symbol_file")))
    joined = joined.join(hashes, "of_file", "left").join(at_load, "page_id", "left")
    state = F.when(F.col("hash").isNull(), "gone").when(~F.coalesce(F.col("version"), F.lit("")).eqNullSafe(F.col("hash")), "stale").otherwise("fresh")
    return joined.withColumn("state", state).select(*ws.columns, "state")


def stale_count(pages: DataFrame, files: DataFrame) -> DataFrame:
    """n: pages whose file has another hash than at loading; pages without file are not counted."""
    return pages.join(files.select(F.col("path").alias("file"), "hash"), "file").where("version <> hash").agg(F.count("*").alias("n"))


def load(pages: DataFrame, loads: DataFrame) -> DataFrame:
    """The pages table after loads (page_id, file, version, granularity, loaded_at, index_version): counts add up, the last load's values stay."""
    every = pages.unionByName(loads.withColumn("load_count", F.lit(1).cast("long")))
    last = F.max_by(F.struct("file", "version", "granularity", "loaded_at", "index_version"), F.struct("loaded_at", "index_version")).alias("last")
    return every.groupBy("page_id").agg(F.sum("load_count").alias("load_count"), last).select("page_id", "last.file", "last.version", "last.granularity", "last.loaded_at", "load_count", "last.index_version")


def touch(ws: DataFrame, entries: DataFrame) -> DataFrame:
    """The working set after entries come in: a pin stays, a real load upgrades a prefetched entry, the first loading time stays."""
    every = ws.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    keys = ["page_id", *SCOPE]
    return every.groupBy(*keys).agg(
        F.min("loaded_at").alias("loaded_at"), F.max("last_access_at").alias("last_access_at"), F.bool_or("pinned").alias("pinned"),
        F.max_by("tokens", "_new").alias("tokens"), F.when(F.bool_or(F.col("origin") == "load"), "load").otherwise("prefetch").alias("origin"),
    ).select(*ws.columns)


def with_pin(ws: DataFrame, pages: DataFrame, pinned: bool = True) -> DataFrame:
    """The working set with the entries that ``pages`` (page_id and scope) names pinned, or loose."""
    keys = ["page_id", *SCOPE]
    hit = pages.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return ws.join(hit, keys, "left").withColumn("pinned", F.when(F.col("_hit"), F.lit(pinned)).otherwise(F.col("pinned"))).select(*ws.columns)


def emptied(ws: DataFrame, force: bool = False) -> DataFrame:
    """What stays when a scope is emptied: the pinned entries, or none where ``force`` takes them too."""
    return ws.where(F.col("pinned") & F.lit(not force))


def eviction_share(gone: DataFrame, pages: int = PAGES, keys: list[str] = [*SCOPE], most: float = 0.4) -> DataFrame:  # noqa: B006
    """keys, evicted, many: whether more than a share of the greatest number of pages went at once."""
    return gone.groupBy(*keys).agg(F.count("*").alias("evicted")).withColumn("many", F.col("evicted") > most * pages)


def resolved(names: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """name, state, page_id, file, n of every wanted ``name``: a file of the index, an exact qualified name, or the only symbol of a bare name.

    A bare name of several symbols is ``ambiguous``, with their number; what is none of these is ``unknown``.
    """
    wanted = names.select("name").distinct()
    paths = files.select(F.col("path").alias("name"), F.col("path").alias("_path")).distinct()
    exact = symbols.groupBy(F.col("qualified_name").alias("name")).agg(F.min("file").alias("_exact"))
    bare = symbols.groupBy("name").agg(F.countDistinct("qualified_name").alias("_n"), F.min(F.struct("qualified_name", "file")).alias("_one"))
    got = wanted.join(paths, "name", "left").join(exact, "name", "left").join(bare, "name", "left")
    as_file, only = text.is_file_page(F.col("name")), F.col("_n") == 1
    state = F.when(as_file, F.when(F.col("_path").isNotNull(), "file").otherwise("unknown")).when(F.col("_exact").isNotNull(), "symbol").when(only, "symbol").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    page = F.when(F.col("state") == "file", F.col("name")).when(F.col("state") == "symbol", F.when(F.col("_exact").isNotNull(), F.col("name")).otherwise(F.col("_one.qualified_name")))
    file = F.when(F.col("state") == "file", F.col("name")).when(F.col("state") == "symbol", F.coalesce("_exact", "_one.file"))
    return got.withColumn("state", state).select("name", "state", page.alias("page_id"), file.alias("file"), F.when(F.col("state") == "ambiguous", F.col("_n")).alias("n"))
