"""A kept search index: which files have which trigrams, and how much text each file's symbols have.

``grams`` (gram, file) has a row for each distinct trigram of the searched columns of a file's symbols, ``sizes`` (file, symbols, length) the file's
number of symbols and of trigrams. Both are made from the symbols of some files alone, so an update replaces the rows of touched files. A search
takes the files that have all trigrams of one of its phrases, reads the symbols of these only, and scores those that have all phrases: the number of
symbols that have a phrase is exact, for they are in such files, and the means come from ``sizes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.operators import search


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a lower-cased text; a look-ahead at each place, so the text is read once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)(?=(...))"), 1))


def grams(symbols: DataFrame, columns: tuple[str, ...] = search.SEARCHED) -> DataFrame:
    """gram, file: each trigram of a file once; distinct within a symbol before the shuffle."""
    every = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))
    return symbols.select("file", F.explode(every).alias("gram")).select("gram", "file").distinct()


def sizes(symbols: DataFrame, columns: tuple[str, ...] = search.SEARCHED) -> DataFrame:
    """file, symbols, length (in trigrams, repeats counted)."""
    return symbols.groupBy("file").agg(F.count("*").alias("symbols"), F.sum(search.length(columns)).cast("long").alias("length"))


def candidates(grams_: DataFrame, phrases: list[str]) -> DataFrame:
    """file: the files that have every trigram of some phrase. Trigrams are literals of the filter, so the scan skips what lies between them."""
    each = [sorted({p.lower()[k : k + 3] for k in range(len(p.lower()) - 2)}) for p in phrases]
    have = grams_.where(F.col("gram").isin(sorted(set().union(*each)))).groupBy("file")
    counts = have.agg(*[F.count_if(F.col("gram").isin(g)).alias(f"_{k}") for k, g in enumerate(each)])
    return counts.where(" or ".join(f"_{k} = {len(g)}" for k, g in enumerate(each))).select("file")


def bm25(symbols: DataFrame, sizes_: DataFrame, query: str) -> DataFrame:
    """``search.bm25`` over all symbols of the index, from the symbols of a search's candidate files and the kept sizes."""
    totals = sizes_.agg(F.sum("symbols").alias("_N"), (F.sum("length") / F.sum("symbols")).alias("_avg"))
    return search.bm25(symbols, query, totals=totals)


def find(symbols: DataFrame, grams_: DataFrame, sizes_: DataFrame, query: str, most: int = 20) -> DataFrame:
    """``search.search`` from the kept index; a query that is none for BM25 goes through the symbols."""
    if not search.searchable(query):
        return search.search(symbols, query, most)
    near = symbols.join(candidates(grams_, search.phrases(query)), "file", "left_semi").select(*symbols.columns)
    return search.ranked(bm25(near, sizes_, query), most)


def stale(symbols: DataFrame, sizes_: DataFrame) -> DataFrame:
    """problem, key of each file whose kept size isn't that of its symbols."""
    now = sizes(symbols).select("file", F.struct("symbols", "length").alias("_now"))
    kept = sizes_.select("file", F.struct("symbols", "length").alias("_kept"))
    differ = now.join(kept, "file", "full_outer").where(~F.col("_now").eqNullSafe(F.col("_kept")))
    return differ.select(F.lit("search index out of date").alias("problem"), F.col("file").alias("key"))
