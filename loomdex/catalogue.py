"""Every registered query of the engine and, beside it, the SQL that gives the same rows. Each runs an operator over whole tables.

A query's comment names the entries of the operator inventory that it exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex import bindings as b
from loomdex.functions import text
from loomdex.operators import changes, graph, quality, resolve, search, working_set
from loomdex.runtime import checkpoint, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# ---------------------------------------------------------------- aggregations, joins, set operations, top-k


@query(b.with_("steps") + " SELECT dst, count(*) AS weight FROM steps GROUP BY dst ORDER BY weight DESC, dst LIMIT 20")
def indegree_topk(spark, d):  # A2, O4
    edges = b.steps(spark, d)
    return graph.in_degree(edges, "dst", None).select("dst", F.col("in_degree").alias("weight")).orderBy(F.desc("weight"), "dst").limit(20)


@query(b.with_("refs") + " SELECT dst_file, CAST(sum(count) AS BIGINT) AS in_degree FROM refs GROUP BY dst_file")
def weighted_in_degree(spark, d):  # A2
    return graph.in_degree(b.refs(spark, d))


@query(b.with_("call_edges") + " SELECT dst_qname, count(*) AS in_degree FROM call_edges GROUP BY dst_qname")
def caller_in_degree(spark, d):  # A3
    return graph.in_degree(b.call_edges(spark, d), "dst_qname", None)


@query(b.with_("call_edges") + " SELECT * FROM call_edges")
def call_edge_counts(spark, d):  # A4, S20
    return b.call_edges(spark, d)


@query(b.with_("files", "symbols", "import_refs") + """, owned AS (SELECT DISTINCT file AS path FROM symbols UNION SELECT path FROM files)
  SELECT path, coalesce(n, 0) AS symbols, coalesce(w, 0) AS in_degree FROM owned LEFT JOIN (SELECT file, count(*) AS n FROM symbols GROUP BY file) s ON s.file = path
  LEFT JOIN (SELECT dst_file, CAST(sum(count) AS BIGINT) AS w FROM import_refs GROUP BY dst_file) r ON r.dst_file = path""")  # fmt: skip
def file_symbol_counts(spark, d):  # J3, A1, U3
    s = b.symbols(spark, d)
    paths = s.select(F.col("file").alias("path")).union(b.files(spark, d).select("path")).distinct()
    counts, degree = s.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols")), graph.in_degree(b.import_refs(spark, d)).withColumnRenamed("dst_file", "path")
    return paths.join(counts, "path", "left").join(degree, "path", "left").na.fill(0, ["symbols", "in_degree"])


@query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def symbol_file_join(spark, d):  # J2, F1
    line = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return line.join(order, line.l_orderkey == order.o_orderkey).drop("l_orderkey")


@query(b.with_("symbols") + " SELECT file, count(*) FILTER (kind IN ('function', 'method')) AS functions, count(*) FILTER (kind IN ('class', 'interface')) AS classes FROM symbols GROUP BY file")
def conditional_counts(spark, d):  # A10, F4
    return b.symbols(spark, d).groupBy("file").agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind").isin("class", "interface")).alias("classes"))


@query(b.with_("symbols") + " SELECT file, string_agg(name, ',' ORDER BY seq) AS names FROM symbols GROUP BY file")
def list_per_key(spark, d):  # A12
    rows = b.symbols(spark, d).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("rows"))
    return rows.select("file", F.array_join("rows.name", ",").alias("names"))


@query(b.with_("symbols") + " SELECT file, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM symbols GROUP BY file")
def set_per_key(spark, d):  # A13, A19
    return b.symbols(spark, d).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(b.with_("symbols") + " SELECT qualified_name, count(*) AS n, min(file) AS file FROM symbols GROUP BY qualified_name HAVING count(*) > 1")
def duplicate_keys(spark, d):  # A18, J22
    return b.symbols(spark, d).groupBy("qualified_name").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1")


@query(b.with_("symbols") + " SELECT file, coalesce(max(line), 1) AS end_line, count(DISTINCT name) AS names, count(*) AS n FROM symbols GROUP BY file")
def file_extent(spark, d):  # A16, A8, A9
    return b.symbols(spark, d).groupBy("file").agg(F.coalesce(F.max("line"), F.lit(1)).alias("end_line"), F.countDistinct("name").alias("names"), F.count("*").alias("n"))


@query(b.with_("changes") + " SELECT symbol, max(ts) AS last_ts, count(*) AS n FROM changes GROUP BY symbol")
def change_totals(spark, d):  # A6, A7
    return b.changes(spark, d).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(b.with_("changes") + " SELECT symbol, count(*) AS n FROM changes WHERE symbol LIKE '%.7' OR symbol LIKE '%.17' GROUP BY symbol")
def change_counts(spark, d):  # A7, F6
    log = b.changes(spark, d)
    return changes.change_counts(log, "7").union(changes.change_counts(log, "17"))


@query(b.with_("changes") + " SELECT symbol, change_type, arg_max(value, seq) AS value, max(seq) AS seq FROM changes GROUP BY symbol, change_type")
def latest_evidence(spark, d):  # A14, A15, W10
    return changes.last_per_key(b.changes(spark, d).select("symbol", "change_type", "value", "seq"), ["symbol", "change_type"], ["seq"])


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_pending(spark, d):  # A17, W5, O3
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return resolve.first_per_group(o, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def scan_aggregate(spark, d):  # S20, A1, A11: the plain wide scan
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77 OR o_orderkey BETWEEN 100 AND 120")
def point_lookup(spark, d):  # S21, F9
    return table(spark, d, "orders").where("o_custkey = 77 or o_orderkey between 100 and 120").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def deleted_keys(spark, d):  # J9, U1
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT 'orders without items' AS problem, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'parts never sold', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
  UNION ALL SELECT 'labels without document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def orphans(spark, d):  # J10, U5, C1, C6
    t = lambda n: table(spark, d, n)
    pairs = [
        ("orders without items", t("orders").select(F.col("o_orderkey").alias("key")), t("lineitem").select(F.col("l_orderkey").alias("key"))),
        ("parts never sold", t("part").select(F.col("p_partkey").alias("key")), t("lineitem").select(F.col("l_partkey").alias("key"))),
        ("labels without document", t("labels").select(F.col("doc_id").alias("key")), t("documents").select(F.col("doc_id").alias("key"))),
    ]
    return quality.problems(*[quality.orphans(name, left, right) for name, left, right in pairs])


@query("""SELECT l_orderkey AS src, l_partkey AS dst, CASE WHEN o_orderkey IS NULL AND p_partkey IS NULL THEN 'both' WHEN p_partkey IS NULL THEN 'target' ELSE 'source' END AS kind FROM lineitem
  LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '2-HIGH') ON o_orderkey = l_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size >= 3) ON p_partkey = l_partkey WHERE o_orderkey IS NULL OR p_partkey IS NULL""")
def dangling_refs(spark, d):  # C3, J10
    known = table(spark, d, "orders").where("o_orderpriority <> '2-HIGH'").select(F.col("o_orderkey").alias("src")), table(spark, d, "part").where("p_size >= 3").select(F.col("p_partkey").alias("dst"))
    return quality.dangling(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), *known)


@query(b.with_("refs") + " SELECT src_file AS node, dst_file AS other FROM refs UNION SELECT dst_file, src_file FROM refs")
def neighbour_union(spark, d):  # U2, G2
    return graph.related(b.refs(spark, d))


@query("SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def key_intersection(spark, d):  # U4, J14
    return table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key")).intersect(table(spark, d, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT doc_id, score FROM (SELECT doc_id, quality + toxic * 10 AS score, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id DESC) AS n FROM labels) WHERE n = 1")
def keyed_dedup(spark, d):  # U6, K8
    rows = changes.keep_latest(table(spark, d, "labels"), ["quality", "toxic"], ["doc_id"])
    return rows.select("doc_id", F.expr("quality + toxic * 10").alias("score"))


# ---------------------------------------------------------------- change detection and log


@query(b.with_("before", "after") + """ SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'added' ELSE 'signature_changed' END AS change_type, o.status AS old_status, n.status AS new_status
  FROM before_ o FULL JOIN after_ n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.status IS DISTINCT FROM n.status OR o.price IS DISTINCT FROM n.price""")
def snapshot_diff(spark, d):  # J4, F3
    old, new = b.snapshots(spark, d)
    return changes.snapshot_diff(old, new, ["key"], ["status", "price"]).select("key", "change_type", "old_status", "new_status")


@query(b.with_("before", "after") + """ SELECT change_type, status, count(*) AS n FROM (SELECT coalesce(o.key, n.key) AS key, coalesce(n.status, o.status) AS status, CASE WHEN n.key IS NULL THEN 'deleted' WHEN o.key IS NULL THEN 'new'
  WHEN o.status = n.status AND abs(o.price - n.price) < 1e-6 THEN 'same' WHEN o.status = n.status THEN 'touch' ELSE 'changed' END AS change_type FROM before_ o FULL JOIN after_ n ON o.key = n.key) GROUP BY 1, 2""")
def file_actions(spark, d):  # F3, J9
    old, new = b.snapshots(spark, d)
    shape = lambda df: df.select(F.col("key").alias("path"), F.ascii("status").cast("long").alias("size"), F.col("price").alias("mtime"), F.col("status").alias("hash"))
    acts = changes.file_actions(shape(old), shape(new)).withColumnRenamed("action", "change_type")
    status = old.select(F.col("key").alias("path"), F.col("status").alias("o")).join(new.select(F.col("key").alias("path"), F.col("status").alias("s")), "path", "full_outer").select("path", F.coalesce("s", "o").alias("status"))
    return acts.join(status, "path").groupBy("change_type", "status").agg(F.count("*").alias("n"))


@query(b.with_("symbols") + """, gone AS (SELECT qualified_name, row_number() OVER (PARTITION BY line ORDER BY seq) AS n, line FROM symbols WHERE kind IN ('function', 'class', 'method')),
  came AS (SELECT qualified_name, row_number() OVER (PARTITION BY line ORDER BY seq) AS n, line FROM symbols WHERE kind NOT IN ('function', 'class', 'method'))
  SELECT gone.line, gone.qualified_name AS old_symbol, came.qualified_name AS new_symbol FROM gone JOIN came USING (line, n) WHERE gone.qualified_name <> came.qualified_name""")
def rename_pairs(spark, d):  # J5
    s = b.symbols(spark, d)
    return changes.rename_pairs(s.where("kind in ('function', 'class', 'method')"), s.where("kind not in ('function', 'class', 'method')"), ["line"], "qualified_name", ["seq"])


@query(b.with_("changes") + " SELECT symbol, seq, change_type, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM changes) WHERE n <= 20")
def change_history(spark, d):  # W9, R6
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "seq"))
    return b.changes(spark, d).select("symbol", "seq", "change_type", n.alias("n")).where("n <= 20")


@query("""WITH RECURSIVE r AS (SELECT event_id AS id, ts, 'v' || CAST((event_id // 10) % 37 AS VARCHAR) || '.' || CAST(event_id % 10 AS VARCHAR) AS old, 'v' || CAST((event_id // 10) % 37 AS VARCHAR) || '.' || CAST(event_id % 10 + 1 AS VARCHAR) AS new FROM events),
  p AS (SELECT r.id, any_value(r.old) AS old, max(struct_pack(ts := q.ts, id := q.id)).id AS before FROM r LEFT JOIN r q ON q.new = r.old AND (q.ts < r.ts OR (q.ts = r.ts AND q.id < r.id)) GROUP BY r.id),
  w AS (SELECT id AS leaf, old, before, CAST(1 AS BIGINT) AS n FROM p UNION ALL SELECT leaf, p.old, p.before, n + 1 FROM w JOIN p ON p.id = w.before),
  l AS (SELECT new AS symbol, max(struct_pack(ts := ts, id := id)).id AS id FROM r GROUP BY new) SELECT symbol, old AS origin, n AS renames FROM l JOIN w ON leaf = id WHERE before IS NULL""")
def lineages(spark, d):  # R6: chains of renames of names that come again and again
    e, group = table(spark, d, "events"), F.expr("cast((event_id div 10) % 37 as string)")
    name = lambda n: F.concat(F.lit("v"), group, F.lit("."), n.cast("string"))
    at = F.col("event_id") % 10
    log = e.select(F.lit(1).alias("run_id"), F.col("event_id").alias("seq"), "ts", name(at + 1).alias("symbol"), F.lit("renamed").alias("change_type"), name(at).alias("old_value"))
    return changes.lineages(log)


@query(b.with_("changes") + " SELECT seq, ts FROM changes WHERE symbol = 'pkg.42' ORDER BY ts, seq LIMIT 200")
def symbol_history(spark, d):  # R6, W9
    return changes.history(b.changes(spark, d), "pkg.42").select("seq", "ts")


@query(b.with_("changes") + " SELECT symbol, seq, date_diff('second', before_ts, ts) AS gap FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before_ts FROM changes) WHERE epoch(ts) - epoch(before_ts) >= 86400")
def change_gaps(spark, d):  # W6
    log = b.changes(spark, d)
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    secs = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    rows = log.withColumn("before_ts", before).where(secs(F.col("ts")) - secs(F.col("before_ts")) >= 86400)
    return rows.select("symbol", "seq", (F.floor(secs(F.col("ts"))) - F.floor(secs(F.col("before_ts")))).alias("gap"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert(spark, d):  # K1, K2, K4, K9
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return changes.upsert(o, o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


# ---------------------------------------------------------------- resolution

RESOLVED = b.with_("raw_calls", "import_refs") + """, one AS (SELECT qualified_name, min(file) AS file FROM symbols GROUP BY 1), named AS (SELECT DISTINCT name, file, qualified_name, split_part(file, '/', 1) AS folder FROM symbols),
  everywhere AS (SELECT name, count(*) AS n, min(qualified_name) AS q FROM named GROUP BY 1), in_file AS (SELECT name, file, count(*) AS n, min(qualified_name) AS q FROM named GROUP BY 1, 2), in_folder AS (SELECT name, folder, count(*) AS n, min(qualified_name) AS q FROM named GROUP BY 1, 2),
  imap AS (SELECT src_file, symbol, replace(regexp_replace(max(dst_file), '\\.py$', ''), '/', '.') AS prefix FROM import_refs GROUP BY 1, 2),
  c AS (SELECT r.*, o.file AS src_file, split_part(o.file, '/', 1) AS src_folder, CASE WHEN callee_raw LIKE 'self.%' THEN 'self' WHEN callee_raw LIKE '%.%' THEN 'dotted' ELSE 'bare' END AS form, regexp_replace(callee_raw, '^[^.]*\\.', '') AS rest FROM raw_calls r JOIN one o ON o.qualified_name = r.src_qname),
  f AS (SELECT c.*, CASE form WHEN 'self' THEN b.qualified_name WHEN 'dotted' THEN CASE WHEN p.qualified_name IS NOT NULL THEN p.qualified_name WHEN e.n = 1 THEN e.q ELSE i.q END
      ELSE CASE WHEN e.n = 1 THEN e.q WHEN i.n = 1 THEN i.q WHEN d.n = 1 THEN d.q END END AS found
    FROM c LEFT JOIN one b ON form = 'self' AND b.qualified_name = regexp_replace(src_qname, '\\.[^.]*$', '') || '.' || rest
    LEFT JOIN imap m ON form = 'dotted' AND m.src_file = c.src_file AND m.symbol = split_part(callee_raw, '.', 1) LEFT JOIN one p ON p.qualified_name = m.prefix || '.' || rest
    LEFT JOIN everywhere e ON e.name = rest LEFT JOIN in_file i ON i.name = rest AND i.file = c.src_file LEFT JOIN in_folder d ON d.name = rest AND d.folder = c.src_folder),
  resolved AS (SELECT src_qname, callee_raw, line, CASE WHEN found <> src_qname THEN found END AS dst_qname FROM f)"""


def _resolved(spark, d):
    return resolve.resolve_calls(b.raw_calls(spark, d), b.symbols(spark, d), b.import_refs(spark, d))


@query(RESOLVED + " SELECT src_qname, dst_qname, count(*) AS count FROM resolved WHERE dst_qname IS NOT NULL GROUP BY 1, 2")
def call_resolve(spark, d):  # J7, G3, G4, A4, L7
    return resolve.call_edges(_resolved(spark, d))


@query(RESOLVED + " SELECT count(*) AS total, count(dst_qname) AS resolved, round(count(dst_qname) / count(*), 4) AS rate FROM resolved")
def resolution_rate(spark, d):  # A5
    return resolve.resolution_rate(_resolved(spark, d))


@query("""WITH link AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="/([^"]+)"', 1), 1) AS n FROM pages),
  known AS (SELECT DISTINCT lower(target) AS path FROM link WHERE NOT regexp_matches(target, '[.,]$')), tried AS (SELECT page_id, n, 0 AS pos, target AS candidate FROM link UNION ALL SELECT page_id, n, 1, lower(target) FROM link UNION ALL SELECT page_id, n, 2, rtrim(lower(target), '.,') FROM link),
  hit AS (SELECT page_id, n, arg_min(candidate, pos) AS candidate FROM tried WHERE candidate IN (SELECT path FROM known) GROUP BY 1, 2) SELECT page_id, candidate AS dst, count(*) AS count FROM hit GROUP BY 1, 2""")
def import_resolve(spark, d):  # J6, W5
    link = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("n", "target"))
    known = link.where(~F.col("target").rlike("[.,]$")).select(F.lower("target").alias("candidate")).distinct()
    tried = link.select("page_id", "n", F.posexplode(F.array("target", F.lower("target"), F.regexp_replace(F.lower("target"), "[.,]+$", ""))).alias("pos", "candidate"))
    hit = tried.join(known, "candidate", "left_semi").groupBy("page_id", "n").agg(F.min_by("candidate", "pos").alias("dst"))
    return hit.groupBy("page_id", "dst").agg(F.count("*").alias("count"))


# ---------------------------------------------------------------- graphs


@query(b.with_("call_edges") + " SELECT 'caller' AS direction, src_qname AS name FROM call_edges WHERE dst_qname = 7 UNION SELECT 'callee', dst_qname FROM call_edges WHERE src_qname = 7")
def callers_callees(spark, d):  # G1
    return graph.neighbours(b.call_edges(spark, d), 7)


@query(b.with_("call_edges") + """, both_ AS (SELECT dst_qname AS node, 'caller' AS direction, src_qname AS name FROM call_edges UNION SELECT src_qname, 'callee', dst_qname FROM call_edges)
  SELECT node, direction, name, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY name) AS rank FROM both_) WHERE rank <= 2""")
def top_n_neighbours(spark, d):  # W8, J8
    return graph.ranked_neighbours(b.call_edges(spark, d), 2, parts=b.call_parts(spark, d))


@query(b.with_("call_edges") + " SELECT src_qname, dst_qname, count FROM call_edges WHERE src_qname IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst_qname IN (SELECT p_partkey FROM part WHERE p_size > 10) ORDER BY count DESC, src_qname, dst_qname LIMIT 40")
def call_graph_edges(spark, d):  # O5, J18, G9
    nodes = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("node"))
    return graph.top_edges(b.call_edges(spark, d), 40, nodes)


@query(b.with_("refs") + " SELECT src_file, dst_file, count FROM refs ORDER BY count DESC, src_file, dst_file LIMIT 60")
def dependency_edges(spark, d):  # O4, G9
    return graph.top_edges(b.refs(spark, d), 60, None, "src_file", "dst_file")


@query(b.with_("call_edges", recursive=True) + """, both_ AS (SELECT src_qname AS a, dst_qname AS b FROM call_edges UNION SELECT dst_qname, src_qname FROM call_edges),
  walk AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(11 AS BIGINT), 0 UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def bfs_bounded(spark, d):  # G5
    roots = spark.createDataFrame([(3,), (11,)], "node long")
    return graph.reach(b.steps(spark, d), roots, 2, "src", "dst")  # how often a step comes makes no difference


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * n_nationkey + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, n_regionkey * 5 FROM nation),
  c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT CAST(a AS BIGINT) AS node FROM c WHERE a = b""")
def cycle_nodes(spark, d):  # G10
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("r"))
    return graph.cycle_nodes(n.select("a", F.expr("(a * a + 1) % 25").alias("b")).union(n.select("a", F.expr("r * 5"))), "a", "b")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS a, (p_partkey * p_partkey + 1) % n AS b FROM part, n UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_size = 7),
  c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), r AS (SELECT DISTINCT x.a, y.a AS z FROM c x JOIN c y ON y.a = x.b AND y.b = x.a)
  SELECT a AS node, count(*) AS size FROM r GROUP BY a""")
def circle_sizes(spark, d):  # G10: every part points to one other, some to a second
    p = table(spark, d, "part").select(F.col("p_partkey").alias("a"), "p_size")
    n = p.count()
    found = graph.circles(p.select("a", F.expr(f"(a * a + 1) % {n}").alias("b")).union(p.where("p_size = 7").select("a", F.expr("a - 1"))), "a", "b")
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "size")


@query(b.with_("files") + """, p AS (SELECT string_split(path, '/') AS s FROM files), k AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p)
  SELECT DISTINCT array_to_string(s[1:n - 1], '/') AS parent, array_to_string(s[1:n], '/') AS child FROM k""")
def tree_edges(spark, d):  # G8, O11
    return graph.tree_edges(b.files(spark, d))


@query(b.with_("symbols") + """, cls AS (SELECT DISTINCT qualified_name, name, base FROM symbols WHERE kind IN ('class', 'interface')), known AS (SELECT name, max(qualified_name) AS parent FROM cls GROUP BY 1)
  SELECT qualified_name AS child, cls.base, parent FROM cls LEFT JOIN known ON known.name = cls.base""")
def inheritance_edges(spark, d):  # J13, G6
    return graph.inheritance(b.symbols(spark, d))


@query(b.with_("symbols") + """, call_q AS (SELECT 'a' AS x), own AS (SELECT min(file) AS file, split_part(min(file), '/', 1) AS folder FROM symbols WHERE seq = 5)
  SELECT s.qualified_name AS page, count(*) AS copies FROM symbols s, own WHERE split_part(s.file, '/', 1) = own.folder AND s.file <> own.file GROUP BY 1""")
def same_folder(spark, d):  # J19, J20
    s = b.symbols(spark, d)
    own = s.where("seq = 5").agg(F.min("file").alias("own_file"))
    beside = s.crossJoin(F.broadcast(own)).where((resolve.folder_of(F.col("file")) == resolve.folder_of(F.col("own_file"))) & (F.col("file") != F.col("own_file")))
    return beside.groupBy(F.col("qualified_name").alias("page")).agg(F.count("*").alias("copies"))


# ---------------------------------------------------------------- search


@query(b.with_("symbols") + """ SELECT qualified_name, seq, CASE WHEN name = 'f12' THEN 0 WHEN lower(name) LIKE 'f12%' THEN 1 WHEN lower(description) LIKE '%f12%' THEN 2 ELSE 3 END AS rank FROM symbols
  WHERE lower(qualified_name) LIKE '%f12%' OR lower(description) LIKE '%f12%' ORDER BY rank, qualified_name, seq LIMIT 5000""")
def like_rank(spark, d):  # R2, F5, F11, O2
    return search.like_rank(b.symbols(spark, d), "f12", 5000).select("qualified_name", "seq", "rank")


def _bm25_sql(phrases: list[str]) -> str:
    count = lambda c, p: f"CAST((length(lower({c})) - length(replace(lower({c}), '{p}', ''))) / {len(p)} AS DOUBLE)"
    tf = [" + ".join(count(c, p) for c in search.SEARCHED) for p in phrases]
    size = " + ".join(f"greatest(length({c}) - 2, 0)" for c in search.SEARCHED)
    idf = lambda k: f"CASE WHEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{k} + 0.5) / (n{k} + 0.5)) END"
    score = " + ".join(f"({idf(k)}) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / avg_size))" for k in range(len(phrases)))
    return (
        b.with_("symbols") + f", t AS (SELECT seq, qualified_name, CAST({size} AS DOUBLE) AS size, " + ", ".join(f"{x} AS tf{k}" for k, x in enumerate(tf)) + " FROM symbols), "
        + "a AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(size) AS avg_size, " + ", ".join(f"CAST(count(*) FILTER (tf{k} > 0) AS DOUBLE) AS n{k}" for k in range(len(phrases))) + " FROM t) "
        + f"SELECT seq, qualified_name, round(-({score}), 6) AS score FROM t, a WHERE " + " AND ".join(f"tf{k} > 0" for k in range(len(phrases)))
    )


@query(_bm25_sql(["widget", "small"]))
def bm25_rank(spark, d):  # R1, J1
    return search.bm25(b.symbols(spark, d), "widget small").select("seq", "qualified_name", F.round("score", 6).alias("score"))


@query(b.with_("symbols") + """ SELECT seq, CASE WHEN name IN ('f12', 'f77') THEN 0.95 WHEN name LIKE '%f12%' OR name LIKE '%f77%' THEN 0.85 WHEN description LIKE '%f12%' OR description LIKE '%f77%' THEN 0.7 ELSE 0.6 END AS confidence FROM symbols""")
def evidence_confidence(spark, d):  # X17, X5
    return b.symbols(spark, d).select("seq", text.evidence_confidence(F.col("qualified_name"), F.col("description"), ["f12", "F77"]).alias("confidence"))


@query()
def plan_evidence(spark, d):  # R3, W7, O3, O10: no oracle, for its parts have theirs
    s = b.symbols(spark, d)
    names = s.groupBy("seq").agg(F.min("qualified_name").alias("q"))
    e = b.call_edges(spark, d).join(names.select(F.col("seq").alias("src_qname"), F.col("q").alias("a")), "src_qname").join(names.select(F.col("seq").alias("dst_qname"), F.col("q").alias("z")), "dst_qname").select(F.col("a").alias("src_qname"), F.col("z").alias("dst_qname"), "count")
    return search.evidence(s.withColumn("end_line", F.col("line")), e, "find the f123 and f45 widget")


# ---------------------------------------------------------------- working set

_BY_SESSION = ["session_id"]


@query(b.with_("working_set") + """ SELECT session_id, page_id, freed_before FROM (SELECT *, coalesce(CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY score, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS freed_before FROM working_set WHERE NOT pinned) WHERE freed_before < 150""")
def evict_prefix(spark, d):  # W1, M7, F8
    return working_set.evictions(b.working_set(spark, d), F.lit(150), _BY_SESSION).select("session_id", "page_id", "freed_before")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem WHERE l_linestatus IS NOT NULL),
  n AS (SELECT (sum(tokens) // 3)::BIGINT AS need FROM r),
  f AS (SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before FROM r)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tokens, freed_before FROM f, n WHERE freed_before < need""")
def evict_one_scope(spark, d):  # W1, W2, M7: one scope holds every row, and no task does
    rows = table(spark, d, "lineitem").where("l_linestatus is not null").select(
        F.lit("all").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("tokens"), F.lit(False).alias("pinned"), F.col("l_partkey").alias("score"),
    )
    need = rows.groupBy("session_id").agg(F.expr("sum(tokens) div 3").alias("need"))
    gone = working_set.evictions_wide(rows, need, ["session_id"], ("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return gone.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tokens", "freed_before")


@query(b.with_("working_set") + """ SELECT session_id, page_id, used FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY last_access DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, row_number() OVER (PARTITION BY session_id ORDER BY last_access DESC) AS n FROM working_set) WHERE used <= 200 OR n = 1""")
def render_prefix(spark, d):  # W2, M9, O7
    return working_set.rendered(b.working_set(spark, d), F.lit(200), _BY_SESSION, (F.desc("last_access"),)).select("session_id", "page_id", "used")


@query(b.with_("working_set") + """, s AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) - 250 AS over FROM working_set),
  g AS (SELECT session_id, page_id FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY score, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM s WHERE NOT pinned) WHERE f < over),
  l AS (SELECT *, count(*) OVER (PARTITION BY session_id) - 2 AS extra FROM s ANTI JOIN g USING (session_id, page_id)), c AS (SELECT session_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, page_id) AS n FROM l WHERE NOT pinned) WHERE n <= extra)
  SELECT session_id, page_id, 'tokens' AS reason FROM g UNION ALL SELECT session_id, page_id, 'pages' FROM c""")
def enforce_budget(spark, d):  # M8
    return working_set.enforce(b.working_set(spark, d), 250, 2, _BY_SESSION).select("session_id", "page_id", "reason")


@query(b.with_("working_set", recursive=True) + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_access) AS n FROM working_set),
  g AS (SELECT session_id, 0 AS n, CAST(120 AS BIGINT) AS room, CAST(NULL AS BIGINT) AS page_id UNION ALL
    SELECT r.session_id, r.n, CASE WHEN r.tokens <= g.room THEN g.room - r.tokens ELSE g.room END, CASE WHEN r.tokens <= g.room THEN r.page_id END FROM g JOIN r ON r.session_id = g.session_id AND r.n = g.n + 1)
  SELECT session_id, CAST(page_id AS VARCHAR) AS page_id FROM g WHERE page_id IS NOT NULL""".replace("SELECT session_id, 0 AS n", "SELECT DISTINCT session_id, 0 AS n", 1).replace("CAST(NULL AS BIGINT) AS page_id UNION ALL", "CAST(NULL AS BIGINT) AS page_id FROM r UNION ALL", 1))
def greedy_prune(spark, d):  # W4, K10
    return working_set.greedy(b.working_set(spark, d), 120, _BY_SESSION, ["last_access"], "tokens", "page_id")


@query("""WITH l AS (SELECT conv_id * 100 + turn AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
  c AS (SELECT *, CAST(ceil(length(line) / 3.0) AS BIGINT) + 1 AS cost FROM l), u AS (SELECT *, sum(cost) OVER (PARTITION BY page_id ORDER BY n) AS used FROM c)
  SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS excerpt FROM u WHERE used <= 60 OR n = 1 GROUP BY page_id""")
def source_excerpt(spark, d):  # W3, M10
    return working_set.excerpt(table(spark, d, "conversations").select(F.expr("conv_id * 100 + turn").alias("page_id"), F.col("text").alias("source")), 60)


@query(b.with_("working_set") + """ SELECT session_id, CAST(sum(tokens) AS BIGINT) AS usage, count(*) AS pages, greatest(0, CAST(sum(tokens) AS BIGINT) - 300) AS over_tokens, greatest(0, count(*) - 4) AS over_pages FROM working_set GROUP BY session_id""")
def budget_usage(spark, d):  # A11, M4
    return working_set.usage(b.working_set(spark, d), 300, 4, _BY_SESSION).drop("ok", "percent")


@query("""SELECT d.doc_id AS page_id, CASE WHEN l.doc_id IS NULL THEN 'gone' WHEN d.doc_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def page_status(spark, d):  # J11, M11
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".py"))
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    ws = docs.select(path.alias("page_id"), "doc_id")
    version = docs.select(path.alias("page_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.lit("h")).alias("version"))
    files = labels.select(path.alias("path"), F.lit("h").alias("hash"))
    symbols = b.symbols(spark, d)
    return working_set.status(ws, symbols, files, version).select(F.col("doc_id").alias("page_id"), "state")


@query("SELECT count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 3 = 0")
def stale_pages(spark, d):  # J12, M12
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.lit("h")).alias("version"))
    return working_set.stale_count(pages, table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.lit("h").alias("hash")))


@query("SELECT CAST(user_id AS VARCHAR) AS page_id, count(*) AS load_count, arg_max(event_type, ts) AS granularity FROM events GROUP BY user_id")
def page_loads(spark, d):  # K7, M3
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("page_id"), F.lit("f").alias("file"), F.lit("v").alias("version"), F.col("event_type").alias("granularity"), F.col("ts").alias("loaded_at"), F.lit(1).cast("long").alias("index_version"))
    none = e.limit(0).withColumn("load_count", F.lit(0).cast("long"))
    return working_set.load(none, e).select("page_id", "load_count", "granularity")


# ---------------------------------------------------------------- scalars


@query("""SELECT page_id, CASE WHEN contains(u, 'services/') THEN 'service' WHEN contains(u, 'pages/') THEN 'component' WHEN contains(u, 'app.js') THEN 'entry' ELSE 'module' END AS role
  FROM (SELECT page_id, lower(CASE page_id % 4 WHEN 0 THEN 'src/Services/x' WHEN 1 THEN 'web/pages/y' WHEN 2 THEN 'z/App.js' ELSE 'q' || CAST(page_id AS VARCHAR) END) AS u FROM pages)""")
def role_infer(spark, d):  # X10
    path = F.when(F.col("page_id") % 4 == 0, "src/Services/x").when(F.col("page_id") % 4 == 1, "web/pages/y").when(F.col("page_id") % 4 == 2, "z/App.js").otherwise(F.concat(F.lit("q"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", text.role_of(path).alias("role"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3.0) AS BIGINT) + 24 AS cost FROM documents")
def token_estimate(spark, d):  # X12, X13
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.page_cost(F.col("text")).alias("cost"))


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS label FROM (SELECT doc_id, CASE WHEN length(t) > 48 THEN t[1:47] || '…' ELSE t END AS s FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '["`()\[\]{}:;,]', ' ', 'g'), '^\s*([-*+]|\d+\.)\s+', ''), '\s+', ' ', 'g')) AS t FROM documents))""")
def label_clean(spark, d):  # X26
    return table(spark, d, "documents").select("doc_id", text.label(F.col("text")).alias("label"))


@query(b.with_("files") + " SELECT path, split_part(path, '/', 1) AS module, split_part(path, '/', 1) || '-' || md5(split_part(path, '/', 1))[1:8] || '.md' AS detail, 'f_' || right(regexp_replace(path, '[^A-Za-z0-9_]', '_', 'g'), 20) || '_' || md5(path)[1:8] AS node FROM files")
def module_of(spark, d):  # X24, X25, X27
    m = text.top_module(F.col("path"))
    return b.files(spark, d).select("path", m.alias("module"), text.detail_name(m).alias("detail"), text.node_id("f", F.col("path")).alias("node"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS slug, 'def (a, b) -> ' || lower(p_type) AS shape, replace(p_brand, '#', '/') AS flat FROM part")
def name_functions(spark, d):  # X1, X6, X22
    sig = F.concat(F.lit("def  "), F.lit("f1(a,\n  b) -> "), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), text.signature_shape(sig, F.lit("f1")).alias("shape"), F.replace(text.flatten(F.col("p_brand")), F.lit("#"), F.lit("/")).alias("flat"))


@query(b.with_("symbols") + r" SELECT seq, replace(regexp_replace(file, '\.py$', ''), '/', '.') AS module, lower(name) AS last, (contains(file, '/')) AS file_page, split_part(file, '/', 1) AS folder FROM symbols")
def path_functions(spark, d):  # X2, X4, X5, X32
    return b.symbols(spark, d).select("seq", text.module_name(F.col("file")).alias("module"), text.last_segment(F.col("qualified_name")).alias("last"), text.is_file_page(F.col("file")).alias("file_page"), resolve.folder_of(F.col("file")).alias("folder"))


@query("""SELECT event_id, round(0.6 * CASE WHEN event_type = 'view' THEN least(r, 0.7) ELSE r END + 0.4 * (1 - least(abs(user_id - 60) / 400.0, 1.0)), 6) AS score
  FROM (SELECT *, 1 / (1 + greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0)) AS r FROM events)""")
def eviction_scores(spark, d):  # X14, X15, X16, M6
    r = text.recency(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    near = text.locality(F.lit("f"), F.lit(60), F.lit("f"), F.col("user_id"), F.lit("function"), F.lit(False))
    origin = F.when(F.col("event_type") == "view", "prefetch").otherwise("load")
    return table(spark, d, "events").select("event_id", F.round(text.eviction_score(r, near, origin), 6).alias("score"))


@query("""SELECT conv_id, turn, CASE WHEN lower(text) ~ 'auth|password|security|secret|payment|token' THEN 'production' ELSE 'product' END AS profile, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS json_tokens, '["' || role || '","","' || CAST(turn AS VARCHAR) || '"]' AS scope FROM conversations""")
def request_functions(spark, d):  # X21, X31, X35
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", text.engineering_profile(F.col("text"))["profile"].alias("profile"), text.json_tokens(F.col("text")).alias("json_tokens"), text.scope_key(F.col("role"), F.lit(""), F.col("turn").cast("string")).alias("scope"))


# ---------------------------------------------------------------- overlaps and impact

_TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: length(x) >= 3)))"


@query(f"""WITH p AS (SELECT p_partkey AS planned, unnest({_TOKENS.format("p_name || ' ' || p_type")}) AS t FROM part), c AS (SELECT s_suppkey AS changed, unnest({_TOKENS.format("s_name || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'economy bolt' WHEN 1 THEN 'small' ELSE 'ring' END")}) AS t FROM supplier),
  l AS (SELECT t, min(changed) AS changed FROM c GROUP BY t), f AS (SELECT planned, min(changed) AS changed FROM p JOIN l USING (t) GROUP BY planned)
  SELECT f.planned, f.changed, string_agg(DISTINCT p.t, ', ' ORDER BY p.t) AS overlap FROM f JOIN p ON p.planned = f.planned JOIN c ON c.changed = f.changed AND c.t = p.t GROUP BY 1, 2""")
def token_overlap(spark, d):  # J15, X20, U4
    from loomdex.plans import impact

    word = F.element_at(F.array(F.lit("economy bolt"), F.lit("small"), F.lit("ring")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    planned = table(spark, d, "part").select(F.col("p_partkey").alias("planned"), F.concat_ws(" ", "p_name", "p_type").alias("ref"))
    changed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("changed"), F.concat_ws(" ", F.col("s_name"), word).alias("changed_ref"))
    return impact.token_overlap(planned, changed, "planned", "ref", "changed", "changed_ref").select("planned", "changed", "overlap")


@query("""WITH f AS (SELECT doc_id, source || '/' || lang || '/' || CAST(n_chars % 500 AS VARCHAR) AS path FROM documents), n AS (SELECT DISTINCT path, split_part(path, '/', 3) AS name FROM f),
  r AS (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) AS k FROM n), o AS (SELECT a.name, a.path AS first, b.path AS second FROM r a LEFT JOIN r b ON b.name = a.name AND b.k = 2 WHERE a.k = 1)
  SELECT doc_id, f.path, CASE WHEN first <> f.path THEN first ELSE second END AS other FROM f JOIN o ON o.name = split_part(f.path, '/', 3) WHERE first <> f.path OR second IS NOT NULL""")
def basename_match(spark, d):  # J16
    from loomdex.plans import impact

    f = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", (F.col("n_chars") % 500).cast("string")).alias("path"))
    return impact.basename_match(f, f.select(F.col("path").alias("ref")), "path", "ref", ["doc_id"]).select("doc_id", "path", F.col("ref").alias("other"))


@query("""WITH k AS (SELECT DISTINCT 'pkg.' || replace(p_name, ' ', '.') AS q FROM part), w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN 'pkg.' || replace(p_name, ' ', '.') ELSE 'no.' || p_name END AS ref FROM part)
  SELECT p_partkey, ref FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE q = ref OR suffix(q, '.' || ref))""")
def unresolved_refs(spark, d):  # J17, C9
    p = table(spark, d, "part")
    known = p.select(F.concat(F.lit("pkg."), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("q")).distinct()
    ref = F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("pkg."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))).otherwise(F.concat(F.lit("no."), "p_name"))
    return quality.unresolved(p.select("p_partkey", ref.alias("ref")), known, "ref", "q")


@query("""WITH g AS (SELECT user_id % 10 AS batch, event_type AS gate, CASE WHEN value > 20 THEN 'passed' ELSE 'failed' END AS outcome, CAST(event_id % 7 AS VARCHAR) AS print, event_id AS seq FROM events),
  l AS (SELECT batch, gate, arg_max(outcome, seq) AS outcome, arg_max(print, seq) AS print FROM g GROUP BY 1, 2) SELECT batch, gate, outcome, print FROM l WHERE outcome = 'passed' AND print <> CAST(batch % 7 AS VARCHAR)""")
def stale_evidence(spark, d):  # J21, A14, P15
    from loomdex.plans import evidence

    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("batch"), F.col("event_type").alias("gate"), F.when(F.col("value") > 20, "passed").otherwise("failed").alias("outcome"), (F.col("event_id") % 7).cast("string").alias("print"), F.col("event_id").alias("seq"))
    now = spark.range(10).select(F.col("id").alias("batch"), (F.col("id") % 7).cast("string").alias("current"))
    return evidence.stale(e, now, ["batch", "gate"], ["batch"], "print").select("batch", "gate", "outcome", "print")


# ---------------------------------------------------------------- sources and plans, over texts made from the tables


def _sources(spark, d):
    """One small source for each part: Python, TypeScript and Go in turn."""
    key, other = F.col("p_partkey").cast("string"), ((F.col("p_partkey") * 7) % 1000).cast("string")
    py = F.concat(F.lit("from .m"), other, F.lit(" import g\n\ndef f"), key, F.lit("(a, b=1) -> int:\n    \"\"\"The "), "p_name", F.lit(".\"\"\"\n    return f"), other, F.lit("(a)\n"))
    ts = F.concat(F.lit("import { g } from './m"), other, F.lit("';\n/** The "), "p_name", F.lit(". */\nexport function f"), key, F.lit("(a: number): number { return f"), other, F.lit("(a); }\n"))
    go = F.concat(F.lit("package p\nimport \"m"), other, F.lit("\"\n// The "), "p_name", F.lit(".\nfunc f"), key, F.lit("(a int) int { return f"), other, F.lit("(a) }\n"))
    form = lambda *x: F.when(F.col("p_partkey") % 3 == 0, x[0]).when(F.col("p_partkey") % 3 == 1, x[1]).otherwise(x[2])
    return table(spark, d, "part").select(F.concat(F.lit("p"), key, form(F.lit(".py"), F.lit(".ts"), F.lit(".go"))).alias("path"), form(py, ts, go).cast("binary").alias("content"))


@query("""SELECT 'p' || k || CASE m WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS file, 'p' || k || '.f' || k AS qualified_name, 'function' AS kind, CASE m WHEN 0 THEN 'def f' || k || '(a, b=1) -> int' WHEN 1 THEN 'function f' || k || '(a: number): number' ELSE 'func f' || k || '(a int) int' END AS signature,
  'The ' || p_name || '.' AS description, CASE m WHEN 2 THEN 4 ELSE 3 END AS line FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 AS m FROM part)""")
def extract_symbols(spark, d):  # S5-S8, S13, S14, X11, L6
    from loomdex.sources import extract

    return extract.symbols_table(extract.extract_contents(_sources(spark, d))).select("file", "qualified_name", "kind", "signature", "description", "line")


@query("""SELECT 'p' || k AS module, CASE m WHEN 0 THEN '.m' || o WHEN 1 THEN './m' || o ELSE 'm' || o END AS source, 'p' || k || '.f' || k AS src_qname, 'f' || o AS callee_raw FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 AS m, CAST((p_partkey * 7) % 1000 AS VARCHAR) AS o FROM part)""")
def extract_edges(spark, d):  # S9-S12, K4
    from loomdex.sources import extract

    got = checkpoint(extract.extract_contents(_sources(spark, d)).select("path", "imports", "calls"))  # parsed once for both
    return extract.imports_table(got).join(extract.calls_table(got).select("file", "src_qname", "callee_raw").hint("merge"), "file").select(F.regexp_replace("file", r"\.\w+$", "").alias("module"), "source", "src_qname", "callee_raw")


def _plans(spark, d):
    """A plan for each nation, whose batches are its region's and whose tasks name suppliers as files; every fifth has a status that there isn't."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_regionkey").cast("string").alias("r"), F.when(F.col("n_nationkey") % 5 == 0, "odd").otherwise("draft").alias("status"))
    body = F.concat(F.lit("---\nid: plan-"), "k", F.lit("\nstatus: "), "status", F.lit("\nrevision: 1\n---\n## Tasks\n| # | Batch | Files | Symbols | Risk | Status | Validation |\n|---|---|---|---|---|---|---|\n| 1 | B"), "r", F.lit(" | s/"), "k", F.lit(".py, none | m.f"), "k", F.lit(" | low | pending | gate x |\n| 2 | B9 | `t.py` | - | odd | done | works |\n## Batches\n| Batch | Status |\n|---|---|\n| B"), "r", F.lit(" | pending |\n"))
    return n.select(F.concat(F.lit("plans/"), "k", F.lit(".md")).alias("path"), body.alias("text"))


@query("""SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, 1 AS number, 'B' || CAST(n_regionkey AS VARCHAR) AS batch, 's/' || CAST(n_nationkey AS VARCHAR) || '.py' AS files, 'm.f' || CAST(n_nationkey AS VARCHAR) AS symbols FROM nation
  UNION ALL SELECT 'plan-' || CAST(n_nationkey AS VARCHAR), 2, 'B9', 't.py', '' FROM nation""")
def plan_tasks(spark, d):  # S15-S19
    from loomdex.plans import records

    return records.tasks(records.from_texts(_plans(spark, d))).select("plan_id", "number", "batch", F.array_join("files", ",").alias("files"), F.array_join("symbols", ",").alias("symbols"))


@query("""WITH p AS (SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, n_nationkey % 5 = 0 AS odd FROM nation)
  SELECT plan_id, unnest(['tasks[2].risk', 'tasks[2].batch', 'tasks[2].validation']) AS field, unnest(['PLAN_SCHEMA_INVALID', 'PLAN_SCHEMA_INVALID', 'PLAN_VAGUE_VALIDATION']) AS code FROM p""")
def plan_task_lint(spark, d):  # P4, P7
    from loomdex.plans import lint, records

    found = lint.lint(records.from_texts(_plans(spark, d)))
    return found.where("field like 'tasks[%'").select("plan_id", "field", "code")


@query("""SELECT kind, ref, batch, count(*) AS plans FROM (SELECT 'symbol' AS kind, 'm.f' || CAST(n_nationkey AS VARCHAR) AS ref, 'B' || CAST(n_regionkey AS VARCHAR) AS batch FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey IN (1, 2, 3, 5)
  UNION ALL SELECT 'file', 't.py', 'B9' FROM nation WHERE n_nationkey % 5 <> 0) GROUP BY 1, 2, 3""")
def plan_direct_impact(spark, d):  # P18, J14, L8
    from loomdex.plans import impact, records

    plans = records.from_texts(_plans(spark, d).withColumn("text", F.replace(F.col("text"), F.lit("status: draft"), F.lit("status: executing"))))
    found = impact.impact(plans, records.tasks(plans), ["t.py"], ["m.f1", "m.f2", "m.f3", "m.f5"], None, None).where("level = 'direct'")
    return found.groupBy("kind", "ref", "batch").agg(F.count("*").alias("plans"))


from loomdex import catalogue_index  # noqa: E402, F401  the rest of the queries, which need ``query`` above
