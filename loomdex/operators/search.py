"""Ranked search over symbols: literal matches, BM25 over phrases, and the evidence that a request's words bring together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators.graph import ranked_neighbours

SEARCHED = ("qualified_name", "name", "signature", "description", "file")
K1, B = 1.2, 0.75


def like_rank(symbols: DataFrame, term: str, most: int = 20, id_column: str = "qualified_name") -> DataFrame:
    """Symbols with ``term`` in name or description, ASCII case folded: the equal name first, then names that begin with it, descriptions, others."""
    low, name, said = F.lit(term.translate(str.maketrans(text.UPPER, text.LOWER))), text.fold_ascii(F.col(id_column)), text.fold_ascii(F.coalesce("description", F.lit("")))
    bare = text.fold_ascii(F.col("name"))
    rank = F.when(F.col("name") == term, 0).when(bare.startswith(low), 1).when(F.contains(said, low), 2).otherwise(3)
    return symbols.where(F.contains(name, low) | F.contains(said, low)).withColumn("rank", rank).orderBy("rank", id_column).limit(most)


def phrases(query: str) -> list[str]:
    """The phrases of a query that a trigram index can find: those of three or more characters."""
    return [p for p in query.split() if len(p) >= 3]


def searchable(query: str) -> bool:
    """Whether a query is one for BM25; dots and dashes are no part of its grammar, short queries have no trigram."""
    return len(query.strip()) >= 3 and bool(phrases(query)) and not re.search(r"[.\-\"*^():+]", query)


def occurrences(c: Column, phrase: str) -> Column:
    """Places where a phrase stands, overlapping ones too."""
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", phrase.lower()) + ")"))


def length(columns: tuple[str, ...] = SEARCHED) -> Column:
    """A row's number of trigrams, over its searched columns."""
    of = lambda c: F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0))
    return sum((of(c) for c in columns), F.lit(0))


def bm25(rows: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED, totals: DataFrame | None = None) -> DataFrame:
    """``rows`` that have every phrase of the query, with score: lower is better.

    A column's length is its number of trigrams. Means and document counts are one aggregate row; no trigram is ever exploded. ``totals`` (_N, _avg)
    are the number of all rows and their mean length, where ``rows`` are only those that can have the phrases.
    """
    found = phrases(query)
    counted = rows.withColumn("_len", length(columns).cast("double"))
    for k, p in enumerate(found):
        counted = counted.withColumn(f"_tf{k}", sum((occurrences(F.col(c), p) for c in columns), F.lit(0)).cast("double"))
    own = [] if totals is not None else [F.count("*").alias("_N"), F.avg("_len").alias("_avg")]
    met = counted.agg(*own, *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_n{k}") for k in range(len(found))])
    if totals is not None:
        met = met.crossJoin(F.broadcast(totals))  # one row and one row
    scored = counted.where(" and ".join(f"_tf{k} > 0" for k in range(len(found)))).crossJoin(F.broadcast(met))  # one row
    score = F.lit(0.0)
    for k in range(len(found)):
        tf, n = F.col(f"_tf{k}"), F.col(f"_n{k}")
        weight = F.log((F.col("_N") - n + 0.5) / (n + 0.5))
        score = score - F.when(weight <= 0, 1e-6).otherwise(weight) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return scored.withColumn("score", score).select(*rows.columns, "score")


def ranked(scored: DataFrame, most: int) -> DataFrame:
    return scored.orderBy("score", "file", "seq", "qualified_name").limit(most)


def search(symbols: DataFrame, query: str, most: int = 20) -> DataFrame:
    """BM25 where the query is one for it, else literal matches."""
    if not searchable(query):
        return like_rank(symbols, query.strip(), most)
    return ranked(bm25(symbols, query), most)


def merged_terms(symbols: DataFrame, terms: list[str], most: int = 8) -> DataFrame:
    """The best ``3 * most`` symbols for each term, once each, equal names first, then short names."""
    own = None
    for t in terms:
        hits = search(symbols, t, 3 * most).select("qualified_name", "file", "name", "description", "line", "end_line", "signature")
        own = hits if own is None else own.unionByName(hits)
    if own is None:
        return symbols.limit(0).select("qualified_name", "file", "name", "description", "line", "end_line", "signature", F.lit(0).alias("inexact"))
    equal = F.lower(text.last_segment(F.col("qualified_name"))).isin([t.casefold() for t in terms])
    once = own.dropDuplicates(["qualified_name"]).withColumn("inexact", F.when(equal, 0).otherwise(1))
    return once.orderBy("inexact", F.length("qualified_name"), "file", "qualified_name").limit(most)


def evidence(symbols: DataFrame, edges: DataFrame, query: str, most: int = 8) -> DataFrame:
    """evidence_id, kind, qualified_name, file, confidence, of the symbols that a request means and of their callers and callees.

    The symbols come by rank; each brings at most two callers and two callees that aren't there yet; numbers follow the order.
    """
    terms = text.query_terms(query)
    hits = merged_terms(symbols, terms, most)
    order = Window.orderBy("inexact", F.length("qualified_name"), "file", "qualified_name")  # at most ``most`` rows
    ranked = hits.withColumn("at", F.row_number().over(order)).withColumn("confidence", text.evidence_confidence(F.col("qualified_name"), F.coalesce("description", F.lit("")), terms))
    direct = ranked.select("at", F.lit(0).alias("sub"), F.lit("symbol").alias("kind"), "qualified_name", "file", "confidence")
    ends = ranked.select(F.col("qualified_name").alias("_q"))  # at most ``most`` rows
    beside = [edges.select("src_qname", "dst_qname").join(F.broadcast(ends), F.col("_q") == F.col(c), "left_semi") for c in ("src_qname", "dst_qname")]
    around = ranked_neighbours(beside[0].union(beside[1]), 2)
    around = around.join(F.broadcast(ranked.select("at", F.col("qualified_name").alias("node"))), "node").join(ranked.select(F.col("qualified_name").alias("name")), "name", "left_anti")
    first = around.groupBy("name").agg(F.min(F.struct("at", "direction", "rank")).alias("by"))
    found = first.join(symbols.groupBy(F.col("qualified_name").alias("name")).agg(F.min("file").alias("file")), "name")
    indirect = found.select(F.col("by.at").alias("at"), F.lit(1).alias("sub"), F.col("by.direction").alias("kind"), F.col("name").alias("qualified_name"), "file", F.lit(0.65).alias("confidence"))
    number = F.row_number().over(Window.orderBy("sub", "at", "kind", "qualified_name"))  # at most five times ``most`` rows
    return direct.union(indirect).withColumn("n", number).select(F.format_string("ev-%04d", "n").alias("evidence_id"), "kind", "qualified_name", "file", "confidence")


def convention_lines(texts: DataFrame, terms: list[str], path: str = "path", body: str = "text") -> DataFrame:
    """path, line, excerpt: the first line of each text that has one of the terms, at most 240 characters of it."""
    lines = F.transform(F.split(F.coalesce(F.col(body), F.lit("")), r"\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("said")))
    has = lambda x: F.exists(F.array(*[F.lit(t.casefold()) for t in terms]), lambda t: F.contains(F.lower(x), t))
    first = F.get(F.filter(lines, lambda x: has(x.said)), F.lit(0))
    return texts.select(path, first.alias("f")).where("f is not null").select(path, "f.line", F.substr(F.trim("f.said"), F.lit(1), F.lit(240)).alias("excerpt"))


def marked_stale(evidence: DataFrame, indexed: DataFrame, now: DataFrame) -> DataFrame:
    """``evidence`` with stale: its file is gone, or another than when it was indexed; both tables have (path, hash)."""
    was, is_ = indexed.select(F.col("path").alias("file"), F.col("hash").alias("_was")), now.select(F.col("path").alias("file"), F.col("hash").alias("_is"))
    joined = evidence.join(was, "file", "left").join(is_, "file", "left")
    return joined.withColumn("stale", F.col("_is").isNull() | ~F.col("_is").eqNullSafe(F.col("_was"))).drop("_was", "_is")
