"""Resolution of imports to files and of calls to symbols, for the whole index at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.runtime import checkpoint, hinted

SCRIPT_ENDS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")


def normal_path(c: Column) -> Column:
    """``.`` and ``..`` parts folded away; a path that leads outside keeps its leading dots."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def import_candidates(imports: DataFrame) -> DataFrame:
    """file, seq, symbol, pos, candidate: the files that an import may mean, best first.

    Python: dotted modules, and dots that climb from the importing file's folder; ``from . import name`` tries the names first. JavaScript and
    TypeScript: relative sources, with and without their suffix. Go imports name packages, not files.
    """
    src, folder = F.col("source"), folder_of(F.col("file"))
    level = F.length(F.regexp_extract(src, r"^(\.*)", 1))
    climbed = normal_path(F.concat(folder, F.repeat(F.lit("/.."), F.greatest(level - 1, F.lit(0)))))
    prefix = F.when(climbed == "", "").otherwise(F.concat(climbed, F.lit("/")))
    module = F.translate(F.substr(src, level + 1), ".", "/")
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    package = F.array(F.concat(prefix, module, F.lit(".py")), F.concat(prefix, module, F.lit("/__init__.py")))
    siblings = F.concat(F.transform(names, lambda x: F.concat(prefix, x, F.lit(".py"))), F.array(F.concat(prefix, F.lit("__init__.py"))))
    whole = F.translate(src, ".", "/")
    python = F.when(level == 0, F.array(F.concat(whole, F.lit(".py")), F.concat(whole, F.lit("/__init__.py")))).when(module == "", siblings).otherwise(package)
    base = normal_path(F.concat_ws("/", folder, src))
    bare = F.regexp_replace(base, r"\.(js|mjs|cjs|jsx)$", "")
    script = F.concat(F.array(base), F.array(*[F.concat(base, F.lit(e)) for e in SCRIPT_ENDS]), F.array(*[F.concat(bare, F.lit(e)) for e in (".ts", ".tsx")]))
    language = text.language_of(F.col("file"))
    found = F.when(language == "python", python).when(language.isin("javascript", "typescript") & src.startswith("."), script)
    return imports.where("source <> ''").select("file", "seq", F.get(names, F.lit(0)).alias("symbol"), F.posexplode(found).alias("pos", "candidate"))


def import_edges(imports: DataFrame, files: DataFrame, by: str | None = None) -> DataFrame:
    """refs: for each import the first candidate that exists; edges counted by (source, target) with the first import's first name. ``by`` is the joins' hint."""
    met = import_candidates(imports).join(hinted(files.select(F.col("path").alias("candidate")), by), "candidate", "left_semi")
    first = met.groupBy("file", "seq").agg(F.min_by(F.struct("candidate", "symbol"), "pos").alias("hit"))
    edges = first.groupBy(F.col("file").alias("src_file"), F.col("hit.candidate").alias("dst_file"))
    return edges.agg(F.min_by(F.coalesce("hit.symbol", "hit.candidate"), "seq").alias("symbol"), F.count("*").alias("count")).select("src_file", "dst_file", "symbol", "count")


def import_map(refs: DataFrame) -> DataFrame:
    """src_file, symbol, prefix: the dotted prefix of the file that an imported name comes from; of several the last target."""
    return refs.groupBy("src_file", "symbol").agg(F.max("dst_file").alias("dst_file")).select("src_file", "symbol", text.module_prefix(F.col("dst_file")).alias("prefix"))


def resolve_calls(raw_calls: DataFrame, symbols: DataFrame, refs: DataFrame, by: str | None = None, itself: bool = False) -> DataFrame:
    """raw_calls with dst_qname, null where a call can't be resolved or its caller is gone; with ``itself`` a call may mean its own caller.

    ``self.x`` and ``cls.x`` look beside the caller and nowhere else. A dotted callee takes the import of its first part, then the rest as a bare
    name: a unique one, or the first of the caller's file. A bare name must be unique: overall, then in the caller's file, then in its folder.

    Names are aggregated per name, per name and file, and per name and folder before the joins, so no join multiplies rows. ``by`` is the joins' hint:
    where symbols are many and the planner can't tell, "merge" keeps it from sending them all through the driver to every task. Calls that a lookup
    does not concern take a key of their own text there, for those without any would meet in one task.
    """
    sent = lambda df: hinted(df, by)
    one = symbols.groupBy("qualified_name").agg(F.min("file").alias("file"))
    named = symbols.select("name", "file", "qualified_name", folder_of(F.col("file")).alias("folder")).distinct()
    unique = lambda *keys: named.groupBy("name", *keys).agg(F.count("*").alias("n"), F.min("qualified_name").alias("q"))
    everywhere = unique().select(F.col("name").alias("bare"), F.col("n").alias("n_all"), F.col("q").alias("q_all"))
    in_file = unique("file").select(F.col("name").alias("bare"), F.col("file").alias("src_file"), F.col("n").alias("n_file"), F.col("q").alias("q_file"))
    in_folder = unique("folder").select(F.col("name").alias("bare"), F.col("folder").alias("src_folder"), F.col("n").alias("n_folder"), F.col("q").alias("q_folder"))
    raw = F.col("callee_raw")
    own = raw.rlike(r"^(self|cls)\.")
    calls = raw_calls.join(sent(one.select(F.col("qualified_name").alias("src_qname"), F.col("file").alias("src_file"))), "src_qname", "left")
    calls = calls.withColumn("src_folder", folder_of(F.col("src_file")))
    is_dotted, rest = ~own & F.contains(raw, F.lit(".")), F.regexp_replace(raw, r"^[^.]*\.", "")
    calls = calls.withColumn("head", F.substring_index(raw, ".", 1)).withColumn("bare", F.when(is_dotted, rest).otherwise(raw))
    calls = calls.join(sent(import_map(refs).select("src_file", F.col("symbol").alias("head"), "prefix")), ["src_file", "head"], "left")
    beside = F.concat(F.regexp_replace("src_qname", r"\.[^.]*$", ""), F.lit("."), F.regexp_replace(raw, r"^(self|cls)\.", ""))
    full = F.when(own, beside).when(is_dotted, F.concat("prefix", F.lit("."), "bare"))
    calls = calls.withColumn("is_full", full.isNotNull()).withColumn("at", F.coalesce(full, raw))
    calls = calls.join(sent(one.select(F.col("qualified_name").alias("at"), F.lit(True).alias("is_there"))), "at", "left")
    calls = calls.join(sent(everywhere), "bare", "left").join(sent(in_file), ["bare", "src_file"], "left").join(sent(in_folder), ["bare", "src_folder"], "left")
    meant = F.when(F.col("is_full") & F.col("is_there"), F.col("at"))
    dotted = F.coalesce(meant, F.when(F.col("n_all") == 1, F.col("q_all")).otherwise(F.col("q_file")))
    plain = F.when(F.col("n_all") == 1, F.col("q_all")).when(F.col("n_file") == 1, F.col("q_file")).when(F.col("n_folder") == 1, F.col("q_folder"))
    found = F.when(own, meant).when(is_dotted, dotted).otherwise(plain)
    dst = F.when(F.col("src_file").isNotNull() & (F.lit(itself) | (found != F.col("src_qname"))), found)
    return calls.select(*raw_calls.columns, dst.alias("dst_qname"))


class States(NamedTuple):
    """Symbols and file references before and after a change, and the files (path) that it touched."""

    touched: DataFrame
    symbols: DataFrame
    refs: DataFrame
    old_symbols: DataFrame
    old_refs: DataFrame


def altered(at: States) -> DataFrame:
    """kind, a, b: the keys by which a change can alter what a call means, each once; only what differs is among them.

    0: a touched file. 1: the last part of a name of a symbol that came or went. 2: a symbol that came or went. 3: a symbol and the name of an import of
    its file whose target is another now, or gone.
    """
    paths = at.touched.select(F.col("path").alias("file")).distinct()
    own = lambda s: s.join(paths, "file", "left_semi").select("file", "name", "qualified_name").distinct()
    old, new = own(at.old_symbols), own(at.symbols)
    moved = old.subtract(new).union(new.subtract(old))
    was, is_ = import_map(at.old_refs), import_map(at.refs)
    heads = was.subtract(is_).union(is_.subtract(was)).select(F.col("src_file").alias("file"), F.col("symbol").alias("_head")).distinct()
    homes = at.symbols.join(heads.select("file").distinct(), "file", "left_semi").select("qualified_name").distinct()
    first = at.symbols.join(homes, "qualified_name", "left_semi").groupBy("qualified_name").agg(F.min("file").alias("file"))
    key = lambda df, kind, a, b=None: df.select(F.lit(kind).alias("kind"), a.alias("a"), (F.lit(None).cast("string") if b is None else b).alias("b"))
    words = F.explode(F.array(text.last_segment(F.col("name")), text.last_segment(F.col("qualified_name"))))
    sets = [key(paths, 0, F.col("file")), key(moved, 1, words), key(moved, 2, F.col("qualified_name")), key(first.join(heads, "file"), 3, F.col("qualified_name"), F.col("_head"))]
    return reduce(DataFrame.union, sets).distinct()


def marked(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """``calls`` (file, src_qname, callee_raw and others) with ``again``: whether one of the keys of ``altered`` is theirs. No join multiplies rows, and
    keys that are few are broadcast by AQE.
    """
    rows = calls.withColumn("_last", text.last_segment(F.col("callee_raw"))).withColumn("_head", F.substring_index("callee_raw", ".", 1))
    for k, on in enumerate((["file"], ["_last"], ["src_qname"], ["src_qname", "_head"])):
        own = keys.where(F.col("kind") == k).select(*[F.col(c).alias(n) for c, n in zip("ab", on, strict=False)], F.lit(True).alias(f"_m{k}"))
        rows = rows.join(own, on, "left")
    again = F.coalesce(*[F.col(f"_m{k}") for k in range(4)], F.lit(False))
    return rows.select(*calls.columns, again.alias("again"))


def resolve_some(calls: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """``resolve_calls`` for some calls of an index: of its symbols and references only those that these calls can mean or come from."""
    bare = F.when(calls.callee_raw.contains("."), F.regexp_replace("callee_raw", r"^[^.]*\.", "")).otherwise(F.col("callee_raw"))
    wanted = calls.select(F.explode(F.array(text.last_segment(F.col("callee_raw")), bare)).alias("_w")).distinct()
    callers = calls.select(F.col("src_qname").alias("_w")).distinct()
    part = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("_w"))
    parts = F.array(part(0, text.last_segment(F.col("qualified_name"))), part(0, F.col("name")), part(1, F.col("qualified_name")))
    keys = wanted.select(F.lit(0).alias("k"), "_w").union(callers.select(F.lit(1), "_w"))
    near = symbols.select("qualified_name", "name", "file").distinct().select("*", F.inline(parts)).join(keys, ["k", "_w"], "left_semi").select("qualified_name", "name", "file").distinct()
    return resolve_calls(calls, near, refs.join(near.select(F.col("file").alias("src_file")).distinct(), "src_file", "left_semi"))


def by_difference(resolved: DataFrame, raw_calls: DataFrame, at: States) -> DataFrame:
    """What ``resolve_calls`` gives after a change, from what it gave before: answers that can't have changed are kept, the others are found anew."""
    keys = checkpoint(altered(at))
    kept = marked(resolved, keys).where("not again").drop("again")
    again = resolve_some(marked(raw_calls, keys).where("again").drop("again"), at.symbols, at.refs)
    return kept.unionByName(again)


def call_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst_qname is not null").groupBy("src_qname", "dst_qname").agg(F.count("*").alias("count"))


def resolution_rate(resolved: DataFrame) -> DataFrame:
    """total, resolved, rate (four places; 1 without calls)."""
    agg = resolved.agg(F.count("*").alias("total"), F.count("dst_qname").alias("resolved"))
    return agg.select("total", "resolved", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("resolved") / F.col("total"), 4)).alias("rate"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by ascending values; partial aggregates meet, so no group's rows gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)
