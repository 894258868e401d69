"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers, floor(scale * x). Candidates lie in blocks by a hash of their id, queries in blocks likewise; each pair of blocks is
one group, so no task holds more than two blocks (of ``BLOCK_BYTES`` each) and nothing is broadcast. In a group the candidates stand dimension by
dimension (vertical layout). A query takes its dimensions by its own mass, greatest first, and scores accumulate one block of dimensions at a time.
When ``PROBE_AFTER`` of the query's mass is done, the candidates that lead are scored in full; the k-th best score is a threshold, which later chunks of candidates carry
on and raise. After each block, a candidate's final score is at most its partial score plus the product of the remaining masses (norms over the dimensions to come) of
query and candidate, and candidates whose bound is under the threshold are compacted away. Each group gives at most k rows a query; the
k best of them over all groups are the result. ``multiplications`` says what share of all products a search took.

Sums stay exact: below 2**52 in doubles. Beyond that, scores in doubles with a bound of their error leave those that can be among the k best, and
these are compared in Python integers, limited to the range of a long: scores beyond it tie.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part; a shorter vector is
continued with zeros; fewer candidates than k give all of them; ties go to the smaller id; a query never meets rows of its own id, and repeated
rows (same id and vector) count once; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import ship

BLOCK_BYTES, LEAST_ROWS, SPREAD = 1 << 25, 2048, 32
DIMENSIONS, CHUNK_ROWS, PROBE_AFTER, PROBED, FEW = 8, 8192, 0.6, 4, 16
_SCHEMA = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, continued with zeros up to ``width``."""
    flat = column.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without exact repeats, ordered by id."""
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1)
    return ids[fresh], rows[fresh]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, scale: float = 1.0, count: list | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best among rows; ids ascend. ``count`` gets the products made and those of all pairs."""
    width = rows.shape[1]
    with np.errstate(over="ignore"):
        whole, asked = np.floor(scale * rows), np.floor(scale * queries)
        peak = (float(np.abs(asked).max()) if asked.size else 0.0) * (float(np.abs(whole).max()) if whole.size else 0.0) * width
    if not peak < 2**52:
        return _search_wide(query_ids, queries, ids, rows, k, scale)
    vertical, norms = np.ascontiguousarray(whole.T), (whole**2).sum(1)
    found, made = [], 0
    for own, q in zip(query_ids.tolist(), asked, strict=True):
        order = np.argsort(-np.abs(q), kind="stable")
        to_come = np.r_[np.cumsum((q[order] ** 2)[::-1])[::-1], 0.0]
        best_ids, best, least = ids[:0], np.zeros(0), -np.inf
        for at in range(0, len(ids), CHUNK_ROWS):
            alive = at + np.flatnonzero(ids[at : at + CHUNK_ROWS] != own)
            partial, rest, probed = np.zeros(len(alive)), norms[alive], False
            for c in range(0, width, DIMENSIONS):
                few = len(alive) <= FEW * k  # not worth more bounds
                d = order[c:] if few else order[c : c + DIMENSIONS]
                block = vertical[np.ix_(d, alive)]
                partial += q[d] @ block
                made += block.size
                if few:
                    break
                rest -= np.einsum("ij,ij->j", block, block)
                left = to_come[min(c + DIMENSIONS, width)]
                if not probed and len(alive) > PROBED * k and left <= (1 - PROBE_AFTER) * to_come[0]:
                    lead = alive[np.argpartition(partial, -PROBED * k)[-PROBED * k :]]
                    full = q @ vertical[:, lead]
                    made += width * len(lead)
                    least, probed = max(least, np.partition(full, -k)[-k]), True
                stay = partial + np.sqrt(np.maximum(rest, 0.0) * left) * (1 + 1e-9) + 1e-6 >= least
                if not stay.all():  # compact the survivors
                    alive, partial, rest = alive[stay], partial[stay], rest[stay]
            best_ids, best = _best(np.r_[best_ids, ids[alive]], np.r_[best, partial], k)
            if len(best) == k:
                least = max(least, best[-1])
        found += [(own, i, int(x)) for i, x in zip(best_ids.tolist(), best.tolist(), strict=True)]
    if count is not None:
        count += [made, sum(int((ids != own).sum()) for own in query_ids.tolist()) * width]
    return found


def _search_wide(query_ids, queries, ids, rows, k, scale):
    """The same for components whose sums doubles can't hold: bounds in doubles, and integers for those that the bounds leave."""
    exact = lambda x: math.floor(Fraction(float(x)) * Fraction(scale))
    top_row, top_query = max(float(np.abs(rows).max()), 1.0), max(float(np.abs(queries).max()), 1.0)
    near, found = rows / top_row, []
    for own, q in zip(query_ids.tolist(), queries, strict=True):
        alive = np.flatnonzero(ids != own)
        if not len(alive):
            continue
        about = near[alive] @ (q / top_query)
        # rounding of the division, products and sums, and the floors of both factors
        slack = rows.shape[1] * 2.0**-50 + rows.shape[1] * (1 / abs(scale) * (1 / top_row + 1 / top_query) + 1 / scale**2 / top_row / top_query)
        if len(alive) > k:
            least, full = np.partition(about, len(alive) - k)[len(alive) - k] - slack, 2.0**63 / scale**2 / top_row / top_query
            if least > -full:  # what is beyond a long's range ties, and stays
                alive = alive[about + slack >= min(least, full)]
        whole = [exact(x) for x in q]
        score = lambda r: max(-(1 << 63), min((1 << 63) - 1, sum(a * exact(b) for a, b in zip(whole, r, strict=True))))
        found += [(own, i, -s) for s, i in sorted((-score(rows[i]), int(ids[i])) for i in alive.tolist())[:k]]
    return found


def multiplications(vectors: np.ndarray, asks: np.ndarray, k: int = 5, scale: float = 256.0) -> float:
    """Share of the products of all queries and rows that a search in one group makes."""
    ids, count = np.arange(len(vectors)), []
    search(ids[asks], vectors[asks].astype(np.float64), ids, vectors.astype(np.float64), k, scale, count)
    return count[0] / max(count[1], 1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over all other rows."""
    ship(vectors.sparkSession)
    usable = F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(usable).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asking, width = own.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block_rows = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    rows_in = max(-(-total // block_rows), min(SPREAD, -(-total // LEAST_ROWS)), 1)
    queries_in = max(-(-asking // block_rows), 1)
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own.select("id", "v", block(rows_in, 1).alias("rows"), each(queries_in).alias("queries"))
    asked = own.where("asks").select("id", "v", each(rows_in).alias("rows"), block(queries_in, 2).alias("queries"))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, m = _distinct(left.column("id").to_numpy(), _matrix(left.column("v"), width))
        query_ids, q = _distinct(right.column("id").to_numpy(), _matrix(right.column("v"), width))
        found = search(query_ids, q, ids, m, k, scale) if len(ids) and len(query_ids) else []
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    best = rows.groupBy("rows", "queries").cogroup(asked.groupBy("rows", "queries")).applyInArrow(group, _SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
