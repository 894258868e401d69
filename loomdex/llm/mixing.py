"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are words (``[^\\x20\\x09-\\x0D]+``). Each source has a target; the mix is cut into blocks of ``block_tokens`` words, which go to the
sources by highest quotients (target / 1, 3, 5, ...). A source's blocks go in the same way to its groups of shards, and a group's to its shards,
so every shard has an integer quota. In a shard, rows are laid out in a seeded order as one stream of blocks; every block is taken
``quota // blocks`` times and a run of ``quota % blocks`` blocks, from a seeded start around the ring, once more. A row's share is the overlap of
its words with the taken blocks.

A shard holds about ``shard_tokens`` words and a group at most ``GROUP_SHARDS`` shards, so the number of shards follows the data. The driver sees
one row a group (about 4 * 10**9 words); quotas of shards are dealt by a task per group.

``apply_mix`` gives whole rows: a shard's taken blocks are a base count and one run around the ring, so two places in its order say which rows
come once more. Only this table of places, one row a shard, meets the documents; texts are not shuffled while it has ``BROADCAST_SHARDS`` rows
at most, and beyond that the join is left to the optimiser.

Defined cases: null text has size 0 and takes nothing; a null source is a source, last in order; an empty table gives an empty result; rows
with the same doc_id count separately, and equal rows (id and text) come equally often; other columns of the input are ignored, or kept as they
are by ``apply_mix``.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import checkpoint, ship

WORD = r"[^\x20\x09-\x0D]+"
GROUP_SHARDS, BROADCAST_SHARDS = 4096, 1 << 22
PLACE = ["source_no", "part", "shard"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def capped_targets(sizes: list[int], weights: list[int], share: Fraction, limit: int) -> list[Fraction]:
    """``share`` of all sizes, dealt by weight; what is above ``limit`` times a source's size is dealt again until none is above."""
    rest, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] > total * limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(limit * sizes[i])
            rest -= out[i]
            open_.discard(i)
    return out


def sainte_lague(targets: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Integer quotas by highest quotients target / (2q + 1), ties to the earlier entry; no quota exceeds ``most``.

    Rounding by the divisor that the targets suggest is the highest-quotient result for its own number of seats; from there, seats are added
    or taken back one by one by quotient.
    """
    total = sum(targets)
    if not total or seats <= 0:
        return [0] * len(targets)
    quotas = [min(m, int(t * seats / total + Fraction(1, 2))) for t, m in zip(targets, most, strict=True)]
    missing = seats - sum(quotas)
    if missing > 0:
        heap = [(-t / (2 * q + 1), i) for i, (t, q, m) in enumerate(zip(targets, quotas, most, strict=True)) if t and q < m]
        heapq.heapify(heap)
        while missing > 0 and heap:
            i = heapq.heappop(heap)[1]
            quotas[i] += 1
            missing -= 1
            if quotas[i] < most[i]:
                heapq.heappush(heap, (-targets[i] / (2 * quotas[i] + 1), i))
    elif missing < 0:
        heap = [(t / (2 * q - 1), -i) for i, (t, q) in enumerate(zip(targets, quotas, strict=True)) if q]
        heapq.heapify(heap)
        while missing < 0 and heap:
            i = -heapq.heappop(heap)[1]
            quotas[i] -= 1
            missing += 1
            if quotas[i]:
                heapq.heappush(heap, (targets[i] / (2 * quotas[i] - 1), -i))
    return quotas


def _order(seed: int) -> Column:
    """Where a row stands in its shard: by id and text, so that rows without an id are spread too."""
    return F.xxhash64(F.lit(seed), "doc_id", F.col("text"))


def _place(plan: DataFrame, rows: DataFrame, seed: int, source: Column) -> DataFrame:
    """``rows`` with source_no, part and shard: the source's number, its group of shards, and the shard there. ``plan`` has a row a source."""
    at = lambda k, n: F.pmod(F.xxhash64(F.lit(seed + k), "__mix_order"), F.col(n)).cast("int")
    return rows.join(F.broadcast(plan), source.eqNullSafe(plan["plan_source"])).withColumn("part", at(1, "parts")).withColumn("shard", at(3, "shards"))


def _quotas(cells: DataFrame, parts: DataFrame, block_tokens: int, limit: int) -> DataFrame:
    """Each shard's blocks, from its group's: one task a group, which has at most ``GROUP_SHARDS`` rows."""

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        sizes = rows.column("shard_size").to_pylist()
        dealt = sainte_lague([Fraction(n) for n in sizes], rows.column("part_quota")[0].as_py(), [limit * -(-n // block_tokens) for n in sizes])
        return rows.select([*PLACE, "shard_size"]).append_column("quota", pa.array(dealt, pa.int64()))

    own = cells.join(F.broadcast(parts), PLACE[:2])
    return own.groupBy(*PLACE[:2]).applyInArrow(deal, "source_no int, part int, shard int, shard_size long, quota long")


class Laid(NamedTuple):
    """The mix of a table: the plan of its sources, and a narrow row for every document."""

    plan: DataFrame
    rows: DataFrame


def lay(docs: DataFrame, weights: tuple[int, ...], share: Fraction, limit: int, block_tokens: int, shard_tokens: int, seed: int) -> Laid:
    spark = docs.sparkSession
    ship(spark)
    sized = checkpoint(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _order(seed).alias("__mix_order")))
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, limit)
    plan_rows = []
    for i, (r, t) in enumerate(zip(totals, targets, strict=True)):
        shards = -(-r.n // shard_tokens) or 1
        parts = -(-shards // GROUP_SHARDS)
        plan_rows.append((r.source, i, r.n, float(t), parts, -(-shards // parts)))
    plan = spark.createDataFrame(plan_rows, "plan_source string, source_no int, source_size long, target double, parts int, shards int")
    dealt = _place(plan, sized, seed, F.col("source"))
    cells = checkpoint(dealt.groupBy(*PLACE).agg(F.sum("size").alias("shard_size")))
    blocks = lambda n: -(-n // block_tokens)
    per_source = sainte_lague(targets, round(sum(targets) / block_tokens), [limit * blocks(n) for n in sizes])
    of_source: dict[int, list] = {}
    for r in sorted(cells.groupBy(*PLACE[:2]).agg(F.sum("shard_size").alias("n"), F.sum(F.ceil(F.col("shard_size") / block_tokens)).alias("blocks")).collect()):
        of_source.setdefault(r.source_no, []).append(r)
    part_quotas = []
    for i, own in of_source.items():
        dealt_out = sainte_lague([Fraction(r.n) for r in own], per_source[i], [limit * r.blocks for r in own])
        part_quotas += [(i, r.part, q) for r, q in zip(own, dealt_out, strict=True)]
    quota = _quotas(cells, spark.createDataFrame(part_quotas, "source_no int, part int, part_quota long"), block_tokens, limit)
    stream = Window.partitionBy(*PLACE).orderBy("__mix_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.join(quota, PLACE).withColumn("end", F.sum("size").over(stream)).withColumn("start", F.expr("end - size"))
    laid = laid.withColumn("blocks", F.ceil(F.col("shard_size") / block_tokens)).withColumn("times", F.expr("case when blocks > 0 then quota div blocks else 0 end"))
    laid = laid.withColumn("run", F.expr("quota - times * blocks")).withColumn("first", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), *PLACE), F.col("blocks"))).otherwise(0))
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("start"), a))
    stop = (F.col("first") + F.col("run")) * block_tokens
    extra = overlap(F.col("first") * block_tokens, stop) + overlap(F.lit(0), stop - F.col("blocks") * block_tokens)
    return Laid(plan, laid.withColumn("extra", extra.cast("long")).withColumn("begins", F.col("first") * block_tokens))


DEFAULTS = {"weights": (3, 1, 2), "share": Fraction(3, 2), "limit": 2, "block_tokens": 8, "shard_tokens": 1 << 20, "seed": 17}


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target (of its source), taken, part, shard, quota (blocks of its shard).

    Options and their defaults: ``DEFAULTS``.
    """
    taken = F.expr("times * size + extra").cast("long").alias("taken")
    return lay(docs, **DEFAULTS | options).rows.select("doc_id", "size", "source", "source_size", "target", taken, "part", "shard", "quota")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix has them, all columns and whole texts: each row its shard's base count of times, and those in the shard's run once more.

    The run begins with the first row that begins in it, and ends with the row that brings the shard's words nearest to those of its blocks, so a
    shard's whole rows miss its quota by half a document at most. Rows without words are in no block and don't come.
    """
    options = DEFAULTS | options
    plan, rows = lay(docs, **options)
    rows = rows.where("size > 0").withColumn("key", F.struct("__mix_order", "doc_id", "size"))
    shard = Window.partitionBy(*PLACE)
    rows = rows.withColumn("origin", F.coalesce(F.min(F.when(F.col("start") >= F.col("begins"), F.col("start"))).over(shard), F.lit(0)))
    rows = rows.withColumn("want", F.sum("extra").over(shard)).withColumn("rel", F.pmod(F.col("start") - F.col("origin"), F.col("shard_size")))
    more = F.col("rel") * 2 + F.col("size") <= F.col("want") * 2
    ends = lambda wraps: [f(F.when(more & (F.col("start") < F.col("origin")).eqNullSafe(wraps), F.col("key"))) for f in (F.min, F.max)]
    cuts = checkpoint(rows.groupBy(*PLACE).agg(F.first("times").alias("times"), *[c.alias(n) for c, n in zip([*ends(False), *ends(True)], ("a", "b", "c", "d"), strict=True)]))
    if cuts.count() <= BROADCAST_SHARDS:
        cuts = F.broadcast(cuts)
    names = {c: f"__mix_{k}" for k, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(c).alias(n) for c, n in names.items()], "doc_id", F.col("source").cast("string").alias("__mix_source"), word_count(F.col("text")).alias("size"), _order(options["seed"]).alias("__mix_order"))
    kept = _place(plan, kept, options["seed"], F.col("__mix_source")).join(cuts, PLACE)
    key = F.struct("__mix_order", "doc_id", "size")
    within = lambda a, b: F.coalesce((key >= F.col(a)) & (key <= F.col(b)), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("times") + (within("a", "b") | within("c", "d")).cast("int")).otherwise(0).cast("int")
    return kept.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(True), copies))).select(*[F.col(n).alias(c) for c, n in names.items()])
