"""The index's logical tables as projections of the driver's Parquet tables, in DataFrame form and, for the oracles, in SQL.

Operators are written once against the logical tables; here they meet data of any size. ``SQL`` holds one common table expression for each name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.runtime import dealt, hinted, join_hint, parts_of, table

#: Items of an order alike in these differ in nothing that a step has, so that their own order (in SQL by supplier and price) need not be told.
STEP_ORDER = ("l_linenumber", "l_partkey")
SQL: dict[str, str] = {}


def files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, d, "documents").select(path.alias("path"), F.col("lang").alias("language"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("seq"))


SQL["files"] = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang AS language, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size, doc_id AS seq FROM documents)"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    brand, plain = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    name = F.concat(F.lit("f"), (F.col("p_partkey") % 500).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "method", "interface", "type_alias"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(
        F.concat(brand, F.lit("/"), plain, F.lit(".py")).alias("file"), F.concat_ws(".", brand, plain, name).alias("qualified_name"), name.alias("name"), kind.alias("kind"),
        F.concat(F.lit("def "), name, F.lit("(self, "), F.lower("p_type"), F.lit(")")).alias("signature"), F.concat("p_name", F.lit(" of "), F.lower("p_type"), F.lit(" kind")).alias("description"),
        F.col("p_size").alias("line"), F.array(F.concat(F.lit("f"), ((F.col("p_partkey") * 7) % 600).cast("string"))).alias("bases"), F.col("p_partkey").alias("seq"),
    )


SQL["symbols"] = """symbols AS (SELECT replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.py' AS file, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || '.f' || CAST(p_partkey % 500 AS VARCHAR) AS qualified_name,
  'f' || CAST(p_partkey % 500 AS VARCHAR) AS name, ['function', 'class', 'method', 'interface', 'type_alias'][p_partkey % 5 + 1] AS kind, 'def f' || CAST(p_partkey % 500 AS VARCHAR) || '(self, ' || lower(p_type) || ')' AS signature,
  p_name || ' of ' || lower(p_type) || ' kind' AS description, p_size AS line, 'f' || CAST((p_partkey * 7) % 600 AS VARCHAR) AS base, p_partkey AS seq FROM part)"""


def symbol_joins(spark: SparkSession, d: str) -> str | None:
    """The hint for joins with symbols; of Parquet only the footers are read."""
    return join_hint(table(spark, d, "part").count())


def call_parts(spark: SparkSession, d: str) -> int:
    """Into how many tasks steps that take all calls are dealt."""
    return parts_of(table(spark, d, "lineitem"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive parts of an order; orders are dealt by the number of items, so that no task sorts more of them where there are more."""
    w = Window.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
    items = dealt(table(spark, d, "lineitem").select("l_orderkey", *STEP_ORDER), call_parts(spark, d), "l_orderkey")
    rows = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst")


SQL["steps"] = """steps AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst)"""


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    pairs = dealt(steps(spark, d).select(F.col("src").alias("src_qname"), F.col("dst").alias("dst_qname")), call_parts(spark, d), "src_qname", "dst_qname")
    return pairs.groupBy("src_qname", "dst_qname").agg(F.count("*").alias("count"))


SQL["call_edges"] = "call_edges AS (SELECT src AS src_qname, dst AS dst_qname, count(*) AS count FROM steps GROUP BY src, dst)"


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Nation of the customer to nation of the supplier, with the number of items."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    who = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src_file"))
    by = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst_file"))
    return item.join(order, "l_orderkey").join(who, "c_custkey").join(by, "l_suppkey").groupBy("src_file", "dst_file").agg(F.count("*").alias("count"))


SQL["refs"] = "refs AS (SELECT c_nationkey AS src_file, s_nationkey AS dst_file, count(*) AS count FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def raw_calls(spark: SparkSession, d: str) -> DataFrame:
    """Steps between parts as calls: of a sibling, of a bare name, or dotted through an import, by the line's number.

    Callees come first, for their texts are the shorter ones to carry on.
    """
    own, by = symbols(spark, d), symbol_joins(spark, d)
    src, dst = own.select(F.col("seq").alias("src"), F.col("file"), F.col("qualified_name").alias("src_qname")), own.select(F.col("seq").alias("dst"), F.col("name").alias("to"))
    form = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("self."), "to")).when(F.col("l_linenumber") % 3 == 1, F.col("to")).otherwise(F.concat(F.lit("m"), (F.col("dst") % 5).cast("string"), F.lit("."), F.col("to")))
    said = steps(spark, d).join(hinted(dst, by), "dst").select("src", form.alias("callee_raw"), F.col("l_linenumber").alias("line"))
    return said.join(hinted(src, by), "src").select("file", "src_qname", "callee_raw", "line")


SQL["raw_calls"] = """raw_calls AS (SELECT s.file, s.qualified_name AS src_qname, CASE l_linenumber % 3 WHEN 0 THEN 'self.' || t.name WHEN 1 THEN t.name ELSE 'm' || CAST(dst % 5 AS VARCHAR) || '.' || t.name END AS callee_raw, l_linenumber AS line
  FROM steps JOIN symbols s ON s.seq = src JOIN symbols t ON t.seq = dst)"""


def import_refs(spark: SparkSession, d: str) -> DataFrame:
    """Every file imports the file of the part that follows one of its own, under one of five names."""
    own = symbols(spark, d).select("seq", "file")
    next_ = hinted(own.select(F.col("seq").alias("next"), F.col("file").alias("dst_file")), symbol_joins(spark, d))
    return own.select(F.col("file").alias("src_file"), (F.col("seq") + 1).alias("next"), F.concat(F.lit("m"), (F.col("seq") % 5).cast("string")).alias("symbol")).join(next_, "next").groupBy("src_file", "dst_file").agg(F.min("symbol").alias("symbol"), F.count("*").alias("count"))


SQL["import_refs"] = "import_refs AS (SELECT a.file AS src_file, b.file AS dst_file, min('m' || CAST(a.seq % 5 AS VARCHAR)) AS symbol, count(*) AS count FROM symbols a JOIN symbols b ON b.seq = a.seq + 1 GROUP BY 1, 2)"


def changes(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select(F.lit(1).cast("long").alias("run_id"), F.col("event_id").alias("seq"), ts.alias("ts"), F.concat(F.lit("pkg."), F.col("user_id").cast("string")).alias("symbol"), F.col("event_type").alias("change_type"), "value")


SQL["changes"] = "changes AS (SELECT 1 AS run_id, event_id AS seq, ts, 'pkg.' || CAST(user_id AS VARCHAR) AS symbol, event_type AS change_type, value FROM events)"


def working_set(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages: the system's are pinned, tokens by their text, score by turn and conversation."""
    from loomdex.functions import text

    score = F.round(F.lit(1.0) / (F.lit(1.0) + (F.col("conv_id") * 31 + F.col("turn") * 17) % 13), 6)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("page_id"), F.col("turn").alias("last_access"), (F.col("role") == "system").alias("pinned"), text.estimate_tokens(F.col("text")).alias("tokens"), score.alias("score"))


SQL["working_set"] = """working_set AS (SELECT conv_id AS session_id, turn AS page_id, turn AS last_access, role = 'system' AS pinned,
  CAST(length(regexp_replace(text, '[^㐀-䶿一-鿿]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^㐀-䶿一-鿿]', '', 'g'))) / 3.0) AS BIGINT) AS tokens,
  round(1.0::DOUBLE / (1.0 + (conv_id * 31 + turn * 17) % 13), 6) AS score FROM conversations)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: those of low priority came, urgent ones went, dear ones have another status, medium ones another price."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("p"))
    new = o.where("p <> '1-URGENT'").select("key", F.when(F.col("price") > 400000, F.lit("X")).otherwise(F.col("status")).alias("status"), F.when(F.col("p") == "3-MEDIUM", F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return o.where("p <> '5-LOW'").drop("p"), new


SQL["before"] = "before_ AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority <> '5-LOW')"
SQL["after"] = "after_ AS (SELECT o_orderkey AS key, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderpriority <> '1-URGENT')"

NEEDS = {"call_edges": ("steps",), "raw_calls": ("steps", "symbols"), "import_refs": ("symbols",)}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of some logical tables, each after those that it is made from."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in out)
