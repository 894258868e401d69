"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.runtime import checkpoint, ship, table

__all__ = ["blobs", "checkpoint", "crc_of_id", "draw_ids", "map_batches", "ship", "slices", "table"]

#: Rows that Python functions see at once; long texts make a slice end sooner.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 20


def crc_of_id(col: str | Column) -> Column:
    """crc32 of an id written as text, unsigned; null for a null id."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def blobs(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null becomes empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has few rows and, but for single long texts, few bytes of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def draw_ids(docs: DataFrame, own: DataFrame, sample: int, ones: float = 0.5) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y and the first text of at most ``sample`` ids of ``own`` (doc_id, y of 0 or 1, an id once) that have a document, and how many ids each y has.

    Ids come in the order of a hash, up to the share ``ones`` of the sample from those of y 1 and the rest from those of y 0. Only they, at most
    ``sample`` rows of two numbers, are broadcast.
    """
    known = checkpoint(own.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi"))
    have = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = {1: min(have.get(1, 0), int(sample * ones))}
    most[0] = min(have.get(0, 0), sample - most[1])
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most[y])
    some = docs.select("doc_id", "text").join(F.broadcast(first(0).unionByName(first(1))), "doc_id")
    return some.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "y").agg(F.min("text").alias("text")), have
