"""More registered queries: names and paths, the working set, documents, checks, plans, and the scan as one job, each beside its SQL.

A query's comment names the entries of the operator inventory that it exercises.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex import bindings as b
from loomdex import catalogue, schema
from loomdex.catalogue import query
from loomdex.functions import text, udf
from loomdex.operators import graph, postings, quality, render, resolve, search, working_set
from loomdex.runtime import checkpoint, table
from loomdex.sources import extract, walk


def pick(by, *values):
    """The value whose place is ``by``, counted from zero."""
    return F.element_at(F.array(*[v if hasattr(v, "alias") else F.lit(v) for v in values]), (by + 1).cast("int"))


# ---------------------------------------------------------------- paths and names


@query(b.with_("symbols") + r" SELECT seq, regexp_replace(file, '\.py$', '') AS module FROM symbols")
def script_modules(spark, d):  # X3
    s = b.symbols(spark, d)
    path = F.concat(F.regexp_replace("file", r"\.py$", ""), pick(F.col("seq") % 6, ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"))
    return s.select("seq", text.script_module(path).alias("module"))


@query(b.with_("symbols") + " SELECT seq, ['python', 'javascript', 'javascript', 'javascript', 'javascript', 'typescript', 'typescript', 'go', NULL, NULL][seq % 10 + 1] AS language FROM symbols")
def languages(spark, d):  # S3
    s = b.symbols(spark, d)
    return s.select("seq", text.language_of(F.concat(F.regexp_replace("file", r"\.py$", ""), pick(F.col("seq") % 10, ".py", ".JS", ".mjs", ".cjs", ".jsx", ".ts", ".TSX", ".go", ".txt", ""))).alias("language"))


@query(b.with_("symbols") + " SELECT seq, seq % 6 IN (0, 5) AS kept FROM symbols")
def indexable_paths(spark, d):  # S3, S4
    f = F.col("file")
    path = pick(F.col("seq") % 6, f, F.concat(F.lit("node_modules/"), f), F.concat(F.lit("a/dist/"), f), "x/.gitignore", F.concat(f, F.lit(".txt")), F.concat(F.lit("a/distant/"), f))
    return b.symbols(spark, d).select("seq", walk.indexable(path).alias("kept"))


@query(b.with_("files") + " SELECT path FROM files WHERE language <> 'en' AND (NOT suffix(path, '7.txt') OR suffix(path, '17.txt'))")
def ignore_rules(spark, d):  # S1, S2
    return walk.kept(b.files(spark, d), ["# note", "", "en/", "*7.txt", "!*17.txt"]).select("path")


@query(b.with_("symbols") + " SELECT seq, CASE WHEN seq % 7 IN (0, 4, 5, 6) THEN file END AS path FROM symbols")
def repo_paths(spark, d):  # X23, F10
    f = F.col("file")
    given = pick(
        F.col("seq") % 7, F.concat(F.lit("./"), f), F.concat(F.lit("/"), f), F.concat(F.lit("C:"), f), F.concat(F.lit("a/../"), f), F.concat(F.lit(" "), F.replace(f, F.lit("/"), F.lit("\\")), F.lit(" ")), F.concat(f, F.lit("/")),
        F.replace(f, F.lit("/"), F.lit("/./")),
    )
    return b.symbols(spark, d).select("seq", text.repo_path(given).alias("path"))


@query(b.with_("symbols") + " SELECT seq, file || ',z' AS paths FROM symbols")
def path_lists(spark, d):  # X34
    f = F.col("file")
    given = F.array(F.concat(F.lit(" "), f, F.lit("/")), f, F.replace(f, F.lit("/"), F.lit("\\")), F.lit(""), F.lit(None).cast("string"), F.lit("z"))
    return b.symbols(spark, d).select("seq", F.array_join(text.path_list(given), ",").alias("paths"))


@query(b.with_("symbols") + """ SELECT seq, MAP {'function': 'Function', 'class': 'Class', 'method': 'Method', 'interface': 'Interface', 'type_alias': 'Type alias'}[kind] AS en,
  MAP {'function': '函数', 'class': '类', 'method': '方法', 'interface': '接口', 'type_alias': '类型别名'}[kind] AS zh FROM symbols""")
def kind_labels(spark, d):  # X36
    return b.symbols(spark, d).select("seq", text.kind_label(F.col("kind")).alias("en"), text.kind_label(F.col("kind"), "zh").alias("zh"))


@query(b.with_("symbols") + """ SELECT seq, '["' || base || '"]' AS encoded, base AS decoded FROM symbols""")
def base_lists(spark, d):  # X29
    s = b.symbols(spark, d).withColumn("encoded", text.json_list(F.col("bases")))
    return s.select("seq", "encoded", F.array_join(text.from_json_list(F.col("encoded")), ",").alias("decoded"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS us FROM events")
def timestamps(spark, d):  # X33
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", *[F.substr(text.iso(ts, u), F.lit(1), F.lit(n)).alias(u) for u, n in (("s", 19), ("ms", 23), ("us", 26))])


# ---------------------------------------------------------------- texts and digests


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS normal, doc_id % 3 <> 0 AND text <> '' AND strlen(text) < 65536 AS comparable FROM documents")
def body_rules(spark, d):  # X7, X9
    crlf, old = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normal_body(crlf).cast("binary"), 256).alias("normal"), text.body_comparable(old, F.col("text")).alias("comparable"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+2/-0' ELSE '+1/-' || CAST(len(string_split(text, chr(10))) AS VARCHAR) END AS difference FROM documents")
def body_differences(spark, d):  # X8
    new = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n# one line\n# and another"))).otherwise("# nothing else")
    return table(spark, d, "documents").select("doc_id", udf.body_difference(F.col("text"), new).alias("difference"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE text[1:list_max(list_filter(range(0, 101), lambda k: strlen(text[1:k]) <= 100))] || '…' END AS cut FROM documents")
def byte_caps(spark, d):  # X30
    return table(spark, d, "documents").select("doc_id", udf.byte_cap(100, "…")(F.col("text")).alias("cut"))


@query("""SELECT event_id, sha256(event_type) AS plain, sha256('{"a":{"k":' || json_extract_string(props, '$.k') || '},"z":"é ' || CAST(event_id AS VARCHAR) || '"}') AS canonical FROM events""")
def content_digests(spark, d):  # X28
    loose = F.concat(F.lit('{"z": "é '), F.col("event_id").cast("string"), F.lit('", "a": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", F.sha2(F.col("event_type").cast("binary"), 256).alias("plain"), F.sha2(udf.canonical(loose).cast("binary"), 256).alias("canonical"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9_\\-]{{3,}}'), lambda w: lower(w) NOT IN ({_STOP})), ' ') AS words FROM documents")
def query_words(spark, d):  # X19
    return table(spark, d, "documents").select("doc_id", F.array_join(text.query_words(F.col("text")), " ").alias("words"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0.35, 1 - 0.15 * l_linenumber), 6)::DOUBLE AS confidence FROM lineitem")
def impact_confidences(spark, d):  # X18
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.impact_confidence(F.col("l_linenumber")).cast("double"), 6).alias("confidence"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l WHERE contains(lower(said), 'license') OR contains(lower(said), 'the'))
  SELECT doc_id, CAST(line AS INTEGER) AS line, trim(said, ' ')[1:240] AS excerpt FROM f WHERE n = 1""")
def convention_lines(spark, d):  # S22
    return search.convention_lines(table(spark, d, "documents"), ["License", "the"], "doc_id")


# ---------------------------------------------------------------- search and neighbours


@query(catalogue.ORACLES["bm25_rank"].replace("SELECT seq, qualified_name, round(", "SELECT qualified_name FROM (SELECT seq, qualified_name, (SELECT file FROM symbols x WHERE x.seq = t.seq) AS file, round(", 1) + ") ORDER BY score, file, seq, qualified_name LIMIT 20")
def search_top(spark, d):  # O1, R1a
    return search.search(b.symbols(spark, d), "widget small", 20).select("qualified_name")


_GRAMS = b.with_("symbols") + """, c AS (SELECT file, lower(x) AS x FROM symbols, unnest([qualified_name, name, signature, description, file]) AS t(x)),
  g AS (SELECT DISTINCT file, x[i:i + 2] AS gram FROM (SELECT file, x, unnest(range(1, greatest(length(x) - 1, 1))) AS i FROM c))"""


@query(_GRAMS + " SELECT gram, count(*) AS files FROM g GROUP BY gram")
def gram_files(spark, d):  # K17: how many files have each trigram
    return postings.grams(b.symbols(spark, d)).groupBy("gram").agg(F.count("*").alias("files"))


def _kept(spark, d):
    """The kept index as an update leaves it: the files of every fifth part come later than the others."""
    s = b.symbols(spark, d)
    late = s.where("seq % 5 = 0").select("file").distinct()
    first, then = s.join(late, "file", "left_anti").select(*s.columns), s.join(late, "file", "left_semi").select(*s.columns)
    merged = lambda f: f(first).join(late, "file", "left_anti").unionByName(f(then))
    return s, merged(lambda x: postings.grams(x).select("file", "gram")), merged(postings.sizes)


@query(catalogue.ORACLES["bm25_rank"])
def posting_rank(spark, d):  # R1, K17, J1: the same scores from the kept index
    s, grams, sizes = _kept(spark, d)
    near = s.join(postings.candidates(grams, ["widget", "small"]), "file", "left_semi").select(*s.columns)
    return postings.bm25(near, sizes, "widget small").select("seq", "qualified_name", F.round("score", 6).alias("score"))


@query(catalogue.ORACLES["search_top"])
def posting_top(spark, d):  # O1, R1a, K17
    s, grams, sizes = _kept(spark, d)
    return postings.find(s, grams, sizes, "widget small", 20).select("qualified_name")


@query(b.with_("symbols") + """, o AS (SELECT file, min(seq) AS n FROM symbols GROUP BY file)
  SELECT 'search index out of date' AS problem, file AS key FROM o WHERE n % 4 = 0 OR file IN (SELECT file FROM symbols WHERE seq % 9 = 0)""")
def posting_problems(spark, d):  # C2: a file that the index lacks, or whose symbols it hasn't all
    s = b.symbols(spark, d)
    gone = s.groupBy("file").agg(F.min("seq").alias("n")).where("n % 4 = 0").select("file")
    return postings.stale(s, postings.sizes(s.where("seq % 9 <> 0")).join(gone, "file", "left_anti"))


def _named_edges(spark, d):
    """Calls between symbols by their names."""
    own = b.symbols(spark, d).select("seq", "qualified_name")
    ends = lambda c: own.select(F.col("seq").alias(c), F.col("qualified_name").alias(c + "_name"))
    e = b.call_edges(spark, d).join(ends("src_qname"), "src_qname").join(ends("dst_qname"), "dst_qname")
    return e.select(F.col("src_qname_name").alias("src_qname"), F.col("dst_qname_name").alias("dst_qname"), "count")


_NAMED = ", e AS (SELECT a.qualified_name AS src_qname, z.qualified_name AS dst_qname, c.count FROM call_edges c JOIN symbols a ON a.seq = c.src_qname JOIN symbols z ON z.seq = c.dst_qname)"


@query(b.with_("symbols", "call_edges", "import_refs") + _NAMED + """, o AS (SELECT qualified_name AS q, file FROM symbols WHERE seq = 1),
  near AS (SELECT src_qname AS page, 0 AS p, 0 AS less FROM e, o WHERE dst_qname = q UNION ALL SELECT dst_qname, 1, 0 FROM e, o WHERE src_qname = q
    UNION ALL SELECT s.qualified_name, 2, -coalesce(n, 0) FROM (SELECT DISTINCT qualified_name, split_part(file, '/', 1) AS folder, file FROM symbols) s JOIN o ON folder = split_part(o.file, '/', 1) AND s.file <> o.file
      LEFT JOIN (SELECT dst_qname, count(*) AS n FROM e GROUP BY 1) g ON g.dst_qname = s.qualified_name
    UNION ALL SELECT other, 3, 0 FROM (SELECT src_file AS node, dst_file AS other FROM import_refs UNION SELECT dst_file, src_file FROM import_refs) r JOIN o ON node = o.file),
  best AS (SELECT page, p, less FROM (SELECT near.*, row_number() OVER (PARTITION BY page ORDER BY p, less) AS n FROM near, o WHERE page <> q) WHERE n = 1)
  SELECT page, p AS priority FROM best ORDER BY p, less, CASE WHEN p = 2 THEN page END DESC, page LIMIT 400""")
def prefetch_neighbours(spark, d):  # G7, O8
    symbols = b.symbols(spark, d)
    first = symbols.where("seq = 1").select("qualified_name").first()
    return graph.prefetch_order(first.qualified_name, symbols, _named_edges(spark, d), b.import_refs(spark, d), 400)


@query(b.with_("symbols") + """, w AS (SELECT CASE seq % 5 WHEN 0 THEN file WHEN 1 THEN qualified_name WHEN 2 THEN name WHEN 3 THEN 'g' || CAST(seq AS VARCHAR) ELSE 'no/such.py' END AS name FROM symbols),
  q AS (SELECT qualified_name AS name, min(file) AS file FROM symbols GROUP BY 1), n AS (SELECT name, count(DISTINCT qualified_name) AS n, min(qualified_name) AS q FROM symbols GROUP BY 1)
  SELECT DISTINCT w.name, CASE WHEN contains(w.name, '/') THEN CASE WHEN w.name IN (SELECT file FROM symbols) THEN 'file' ELSE 'unknown' END WHEN q.name IS NOT NULL OR n.n = 1 THEN 'symbol' WHEN n.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS state,
    CASE WHEN contains(w.name, '/') THEN CASE WHEN w.name IN (SELECT file FROM symbols) THEN w.name END WHEN q.name IS NOT NULL THEN w.name WHEN n.n = 1 THEN n.q END AS page_id, CASE WHEN NOT contains(w.name, '/') AND q.name IS NULL AND n.n > 1 THEN n.n END AS n
  FROM w LEFT JOIN q ON q.name = w.name LEFT JOIN n ON n.name = w.name""")
def resolved_pages(spark, d):  # M1
    s = b.symbols(spark, d)
    names = s.select(pick(F.col("seq") % 5, F.col("file"), F.col("qualified_name"), F.col("name"), F.concat(F.lit("g"), F.col("seq").cast("string")), "no/such.py").alias("name"))
    return working_set.resolved(names, s, s.select(F.col("file").alias("path"))).select("name", "state", "page_id", "n")


@query(b.with_("symbols", "call_edges", "import_refs") + _NAMED + """, s AS (SELECT qualified_name, file, line, signature, description FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY file, line, signature, description) AS n FROM symbols) WHERE n = 1),
  i AS (SELECT q, string_agg('`' || n || '`', ', ' ORDER BY n) AS x FROM (SELECT DISTINCT dst_qname AS q, src_qname AS n FROM e) GROUP BY 1), u AS (SELECT q, string_agg('`' || n || '`', ', ' ORDER BY n) AS x FROM (SELECT DISTINCT src_qname AS q, dst_qname AS n FROM e) GROUP BY 1),
  r AS (SELECT node, string_agg('`' || other || '`', ', ' ORDER BY other) AS x FROM (SELECT src_file AS node, dst_file AS other FROM import_refs UNION SELECT dst_file, src_file FROM import_refs) GROUP BY 1)
  SELECT qualified_name AS page_id, sha256('### ' || qualified_name || chr(10) || chr(10) || '`' || signature || '`' || chr(10) || chr(10) || file || ':' || CAST(line AS VARCHAR) || chr(10) || chr(10) || description || chr(10)
    || coalesce(chr(10) || 'callers: ' || i.x || chr(10), '') || coalesce(chr(10) || 'callees: ' || u.x || chr(10), '') || coalesce(chr(10) || 'related files: ' || r.x || chr(10), '')) AS content
  FROM s LEFT JOIN i ON i.q = qualified_name LEFT JOIN u ON u.q = qualified_name LEFT JOIN r ON r.node = file""")
def symbol_pages(spark, d):  # M2, M15
    return render.symbol_pages(b.symbols(spark, d), _named_edges(spark, d), b.import_refs(spark, d)).select("page_id", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query("""SELECT doc_id, doc_id % 4 = 0 OR l.doc IS NULL AS stale FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS doc FROM labels) l ON l.doc = doc_id""")
def stale_search_evidence(spark, d):  # R4
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"))
    indexed = docs.select(F.col("file").alias("path"), F.lit("h").alias("hash"))
    now = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 4 == 0, "new").otherwise("h").alias("hash")).distinct()
    return search.marked_stale(docs, indexed, now).select("doc_id", "stale")


# ---------------------------------------------------------------- working set


def _entries(spark, d):
    """Turns as entries of some scopes."""
    t = table(spark, d, "conversations")
    part = lambda test, value: F.when(test, F.lit("")).otherwise(value)
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("page_id"), part(F.col("conv_id") % 5 == 0, (F.col("conv_id") % 5).cast("string")).alias("session_id"), part(F.col("turn") % 2 == 0, F.lit("p1")).alias("plan_id"), part(F.col("turn") % 3 == 0, F.lit("b1")).alias("batch_id"),
        (F.col("role") == "system").alias("pinned"), F.length("text").cast("long").alias("tokens"), F.col("turn").alias("turn"),
    )


_ENTRIES = """WITH w AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS page_id, CASE WHEN conv_id % 5 = 0 THEN '' ELSE CAST(conv_id % 5 AS VARCHAR) END AS session_id, CASE WHEN turn % 2 = 0 THEN '' ELSE 'p1' END AS plan_id,
  CASE WHEN turn % 3 = 0 THEN '' ELSE 'b1' END AS batch_id, role = 'system' AS pinned, CAST(length(text) AS BIGINT) AS tokens, turn FROM conversations)"""


@query(_ENTRIES + " SELECT 'global' AS scope, page_id FROM w WHERE session_id = '' AND plan_id = '' AND batch_id = '' UNION ALL SELECT 'session', page_id FROM w WHERE session_id = '3' UNION ALL SELECT 'both', page_id FROM w WHERE session_id = '2' AND plan_id = 'p1'")
def scope_filters(spark, d):  # F2, M5
    ws = _entries(spark, d)
    given = {"global": {}, "session": {"session_id": "3"}, "both": {"session_id": "2", "plan_id": "p1"}}
    parts = [working_set.in_scope(ws, **g).select(F.lit(n).alias("scope"), "page_id") for n, g in given.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(_ENTRIES + " SELECT page_id, pinned OR turn % 4 = 1 AS pinned FROM w")
def pinned_entries(spark, d):  # M13, K8
    ws = _entries(spark, d)
    return working_set.with_pin(ws, ws.where("turn % 4 = 1")).select("page_id", "pinned")


@query(_ENTRIES + " SELECT page_id, session_id FROM w WHERE pinned")
def emptied_scopes(spark, d):  # M13, F8
    return working_set.emptied(_entries(spark, d)).select("page_id", "session_id")


@query(_ENTRIES + " SELECT session_id, plan_id, batch_id, count(*) AS evicted, count(*) > 20 AS many FROM w WHERE NOT pinned GROUP BY 1, 2, 3")
def eviction_shares(spark, d):  # A20
    return working_set.eviction_share(_entries(spark, d).where(~F.col("pinned")))


@query(_ENTRIES + " SELECT page_id, session_id, '' AS plan_id, '' AS batch_id, tokens, CAST(NULL AS VARCHAR) AS origin FROM w")
def migrated_entries(spark, d):  # L5
    old = _entries(spark, d).select("page_id", "session_id", "tokens", F.lit("gone").alias("unknown"))
    return schema.migrated(old, "working_set").select("page_id", "session_id", "plan_id", "batch_id", "tokens", "origin")


@query(b.with_("symbols") + " SELECT DISTINCT qualified_name, min(description) OVER (PARTITION BY qualified_name) AS description, md5(min(file) OVER (PARTITION BY qualified_name)) AS version FROM symbols")
def symbol_lookups(spark, d):  # L14
    s = b.symbols(spark, d)
    versions = s.select("file").distinct().withColumn("version", F.md5(F.col("file").cast("binary")))
    return s.groupBy("qualified_name").agg(F.min("description").alias("description"), F.min("file").alias("file")).join(versions, "file").drop("file")


@query(b.with_("symbols") + ", r AS (SELECT DISTINCT CASE WHEN seq % 5 = 0 THEN 'none.' || name ELSE qualified_name END AS ref FROM symbols), q AS (SELECT qualified_name, min(file) AS file, min(seq) AS seq FROM symbols GROUP BY 1) SELECT ref, CASE WHEN q.seq % 3 = 0 THEN 'said.py' ELSE coalesce(file, '') END AS source_path FROM r LEFT JOIN q ON qualified_name = ref")
def source_paths(spark, d):  # L9
    from loomdex.plans import impact

    s = b.symbols(spark, d)
    refs = s.select(F.when(F.col("seq") % 5 == 0, F.concat(F.lit("none."), "name")).otherwise(F.col("qualified_name")).alias("ref"))
    said = s.groupBy(F.col("qualified_name").alias("ref")).agg(F.min("seq").alias("n")).where("n % 3 = 0").select("ref", F.lit("said.py").alias("path"))
    return impact.source_paths(refs, said, s)


# ---------------------------------------------------------------- documents


@query(b.with_("symbols") + """, f AS (SELECT split_part(file, '/', 1) AS module, file, string_agg('| `' || qualified_name || '` | ' || kind || ' | `' || signature || '` | ' || description || ' |', chr(10) ORDER BY line, qualified_name, '| `' || qualified_name || '` | ' || kind || ' | `' || signature || '` | ' || description || ' |') AS rows FROM symbols GROUP BY 1, 2)
  SELECT module, module || '-' || md5(module)[1:8] || '.md' AS name, sha256('# ' || module || chr(10) || chr(10) || string_agg('## ' || file || chr(10) || chr(10) || 'role: module' || chr(10) || chr(10) || '| symbol | kind | signature | description |' || chr(10) || '|---|---|---|---|' || chr(10) || rows, chr(10) || chr(10) ORDER BY file) || chr(10)) AS content FROM f GROUP BY module""")
def module_documents(spark, d):  # K11, R7
    s = b.symbols(spark, d)
    files = s.select(F.col("file").alias("path")).distinct().withColumn("role", F.lit("module"))
    return render.details(s, files).select("module", "name", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '.md' AS name FROM events ORDER BY name DESC LIMIT 5")
def recent_documents(spark, d):  # O9
    return render.recent(table(spark, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".md")).alias("name")))


# ---------------------------------------------------------------- checks


@query(b.with_("symbols", "raw_calls", "import_refs") + """, p AS (SELECT file AS path, min(seq) AS n FROM symbols GROUP BY 1), files AS (SELECT path FROM p WHERE n % 7 <> 0), disk AS (SELECT path FROM p WHERE n % 11 <> 0),
  ws AS (SELECT CASE WHEN seq % 3 = 0 THEN 'gone.' || name ELSE qualified_name END AS page_id, 's' || CAST(seq % 4 AS VARCHAR) AS session_id, line AS tokens FROM symbols)
  SELECT DISTINCT 'symbols of a file that is gone' AS problem, file AS key FROM symbols WHERE file NOT IN (SELECT path FROM disk)
  UNION ALL SELECT DISTINCT 'reference from an unknown file', src_file FROM import_refs WHERE src_file NOT IN (SELECT path FROM files) UNION ALL SELECT DISTINCT 'reference to an unknown file', dst_file FROM import_refs WHERE dst_file NOT IN (SELECT path FROM files)
  UNION ALL SELECT DISTINCT 'calls of an unknown file', file FROM raw_calls WHERE file NOT IN (SELECT path FROM files)
  UNION ALL SELECT DISTINCT 'working set entry without page', page_id FROM ws WHERE page_id NOT IN (SELECT qualified_name FROM symbols) AND page_id NOT IN (SELECT path FROM files)
  UNION ALL SELECT 'call resolution is low', '0.25' UNION ALL SELECT 'changes without a history document', 'history' WHERE EXISTS (FROM events) UNION ALL SELECT 'working set over budget', session_id || '/p/b' FROM ws GROUP BY session_id HAVING sum(tokens) > 12000""")
def index_problems(spark, d):  # C1, C3, C4, C5, C6, C7, C10
    s = b.symbols(spark, d)
    paths = s.groupBy(F.col("file").alias("path")).agg(F.min("seq").alias("n"))
    ws = s.select(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("gone."), "name")).otherwise(F.col("qualified_name")).alias("page_id"), F.concat(F.lit("s"), (F.col("seq") % 4).cast("string")).alias("session_id"), F.lit("p").alias("plan_id"), F.lit("b").alias("batch_id"), F.col("line").alias("tokens"))
    t = {"files": paths.where("n % 7 <> 0"), "symbols": s, "refs": b.import_refs(spark, d), "raw_calls": b.raw_calls(spark, d), "working_set": ws, "changes": table(spark, d, "events")}
    return quality.doctor(t, paths.where("n % 11 <> 0"), spark.createDataFrame([(8, 0.25)], "total long, rate double"), 12000, paths.where("false"))


# ---------------------------------------------------------------- plans


@query(b.with_("symbols") + """, i AS (SELECT DISTINCT split_part(file, '/', 1) AS batch, file AS path FROM symbols), f AS (SELECT file AS path, md5(file) AS hash FROM symbols GROUP BY file HAVING min(seq) % 2 = 0)
  SELECT batch, 'sha256:' || sha256('[' || string_agg('{"path":"' || path || '","hash":"' || coalesce(hash, 'missing') || '"}', ',' ORDER BY path) || ']') AS current FROM i LEFT JOIN f USING (path) GROUP BY batch""")
def input_fingerprints(spark, d):  # P14, L10
    from loomdex.plans import evidence

    s = b.symbols(spark, d)
    files = s.groupBy(F.col("file").alias("path")).agg(F.min("seq").alias("n")).where("n % 2 = 0").select("path", F.md5(F.col("path").cast("binary")).alias("hash"))
    return evidence.fingerprints(s.select(text.top_module(F.col("file")).alias("batch"), F.col("file").alias("path")), files, ["batch"])


@query("""WITH l AS (SELECT user_id % 20 AS batch, event_type AS gate, arg_max(CASE WHEN value > 20 THEN 'passed' ELSE 'failed' END, CAST(user_id % 3 AS BIGINT) * 1000000000 + event_id) AS outcome FROM events GROUP BY 1, 2),
  r AS (SELECT b.range AS batch, unnest(['view', 'click', 'no such']) AS gate FROM range(25) b) SELECT r.batch, r.gate, coalesce(outcome = 'passed', false) AS ok FROM r LEFT JOIN l USING (batch, gate)""")
def gate_requirements(spark, d):  # P13
    from loomdex.plans import evidence

    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), F.col("event_type").alias("gate"), F.when(F.col("value") > 20, "passed").otherwise("failed").alias("outcome"), (F.col("user_id") % 3).alias("plan_revision"), F.col("event_id").alias("seq"))
    need = spark.range(25).select(F.col("id").alias("batch"), F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("no such"))).alias("gate"))
    return evidence.satisfied(e, need, ["batch", "gate"]).select("batch", "gate", "ok")


@query("""WITH r AS (SELECT event_id AS seq, CASE WHEN event_id % 13 <> 0 THEN user_id % 20 END AS batch, event_type AS gate, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'sha256:' || CAST(event_id AS VARCHAR) END AS f FROM events),
  k AS (SELECT DISTINCT user_id % 20 AS batch, event_type AS gate, 1 AS yes FROM events WHERE value > 20)
  SELECT seq, r.batch, r.gate, CASE WHEN yes IS NULL THEN 'unknown' ELSE 'fingerprint' END AS why FROM r LEFT JOIN k ON k.batch = r.batch AND k.gate = r.gate WHERE yes IS NULL OR coalesce(f, '') = ''""")
def unbound_evidence(spark, d):  # C8
    from loomdex.plans import evidence

    e, batch, gate = table(spark, d, "events"), F.col("user_id") % 20, F.col("event_type").alias("gate")
    seq = F.col("event_id")
    stamp = F.when(seq % 7 == 0, "").when(seq % 7 != 1, F.concat(F.lit("sha256:"), seq.cast("string")))
    results = e.select(seq.alias("seq"), F.when(seq % 13 != 0, batch).alias("batch"), gate, stamp.alias("input_fingerprint"))
    return evidence.unbound(results, e.where("value > 20").select(batch.alias("batch"), gate), ["batch", "gate"]).select("seq", "batch", "gate", "why")


@query("""WITH e AS (SELECT 'plan-' || CAST(user_id % 30 AS VARCHAR) AS plan_id, 'B' || CAST(event_id % 4 AS VARCHAR) AS batch, event_id AS seq, ['in-progress', 'passed', 'failed', 'stale', 'pending', NULL][event_id % 6 + 1] AS status FROM events)
  SELECT plan_id, batch, arg_max(status, seq) AS status FROM e WHERE status IS NOT NULL GROUP BY 1, 2""")
def batch_states(spark, d):  # P11
    from loomdex.plans import workflow

    e = table(spark, d, "events").select(F.concat(F.lit("plan-"), (F.col("user_id") % 30).cast("string")).alias("plan_id"), F.concat(F.lit("B"), (F.col("event_id") % 4).cast("string")).alias("batch"), F.col("event_id").alias("seq"), pick(F.col("event_id") % 6, *[f"batch_{k}" for k in ("start", "complete", "fail", "stale", "reopen")], "gate").alias("kind"))
    return workflow.batch_states(e)


def _whole_plans(spark, d):
    """A complete plan for each nation; what is wrong with it goes by its number."""
    k = F.col("n_nationkey")
    n, v = k.cast("string"), k % 10
    when = lambda i, yes, no: F.when(v == i, F.lit(yes)).otherwise(F.lit(no))
    front = [
        F.lit("---"), when(1, "schema_version: 2", "schema_version: 1"), F.concat(F.lit("id: plan-"), n), F.lit("title: T"), F.when(v == 2, "status: odd").when(v == 8, "status: approved").otherwise("status: draft"), F.lit('created: "2024-01-01"'), F.lit('updated_at: "2024-01-01"'), F.lit("revision: 1"),
        F.lit('content_hash: "sha256:x"'), F.lit("revision_type: semantic"), F.lit("reapproval_required: false"), when(3, "x: y", "owner: me"), F.lit("last_writer: me"), when(9, "files: [no.py]", "files: [s.py]"), F.lit("symbols: []"), F.lit("context_pages: []"), F.lit("evidence: []"), F.lit("change_control: {mode: adaptive}"),
        F.concat(F.lit("engineering: {profile: "), pick(k % 2, "product", "prototype"), F.lit(", architecture_style: none, plain_language: true, standards: [], quality_gates: [g2, g1], gates: [{id: g1, kind: command, blocking: true"), when(6, "}", ", command: [run]}"), F.lit("]}")),
        F.concat(F.lit("testing: {approach: test-with-change, tests: [{test_id: t1, disposition: implement, gate_id: g1"), when(7, "}", ", files: [t.py]}"), F.lit("], manual_checks: []}")), F.lit("approval: {by: me}"), F.lit("---"),
    ]
    body = [
        F.lit("## Goal\ng\n## Non-goals\nn\n## Tasks\n| # | Batch | Files | Symbols | Risk | Status | Validation |\n|---|---|---|---|---|---|---|"), F.concat(F.lit("| 1 | B1 | s.py | m.f"), n, F.lit(" | low | "), when(5, "done", "pending"), F.lit(" | gate g1 |")),
        F.lit("## Batches\n| Batch | Status |\n|---|---|"), F.concat(F.lit("| B1 | "), F.when(v == 5, "passed").when(v == 8, "in-progress").otherwise("pending"), F.lit(" |")), when(4, "## Other", "## Validation"), F.lit("v\n## Testing strategy\nt\n## Execution notes\ne\n## Engineering requirements\nr\n## Quality gates\nq\n"),
    ]
    return table(spark, d, "nation").select(F.concat(F.lit("plans/"), n, F.lit(".md")).alias("path"), F.concat_ws("\n", *front, *body).alias("text"), k.alias("k"))


@query("""WITH i AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS v, unnest(['PLAN_SCHEMA_INVALID', 'PLAN_SCHEMA_INVALID', 'PLAN_SCHEMA_INVALID', 'PLAN_SECTION_MISSING', 'INVALID_TRANSITION', 'GATE_COMMAND_INVALID', 'TEST_CONTRACT_MISMATCH', 'INVALID_TRANSITION', 'PLAN_FILE_NOT_FOUND']) AS code,
    unnest(['schema_version', 'status', 'frontmatter', 'sections.validation', 'batches', 'engineering.gates.g1.command', 'testing.tests[t1].files', 'batches', 'files']) AS field)
  SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, code, field FROM nation JOIN i ON v = n_nationkey % 10""")
def plan_lint(spark, d):  # P1, P2, P3, P5, P6, P7
    from loomdex.plans import lint, records

    known = spark.createDataFrame([("s.py",), ("t.py",)], "path string")
    return lint.lint(records.from_texts(_whole_plans(spark, d)), known).select("plan_id", "code", "field")


@query("""SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, CASE n_nationkey % 10 WHEN 2 THEN 'odd' WHEN 8 THEN 'approved' ELSE 'draft' END AS status, 1 AS tasks, CASE n_nationkey % 10 WHEN 5 THEN 1 ELSE 0 END AS done, 1 AS batches, CASE WHEN n_nationkey % 10 IN (5, 8) THEN NULL ELSE 'B1' END AS next_batch FROM nation""")
def plan_summaries(spark, d):  # P8
    from loomdex.plans import records

    return records.summary(records.from_texts(_whole_plans(spark, d)))


@query("""WITH p AS (SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, CASE n_nationkey % 10 WHEN 2 THEN 'odd' WHEN 8 THEN 'approved' ELSE 'draft' END AS status FROM nation) SELECT status, count(*) AS n, string_agg(plan_id, ',' ORDER BY plan_id) AS plans FROM p GROUP BY status""")
def plans_by_status(spark, d):  # P8
    from loomdex.plans import records

    return records.by_status(records.from_texts(_whole_plans(spark, d))).select("status", "n", F.array_join("plan_ids", ",").alias("plans"))


@query("""SELECT 'plan-' || CAST(n_nationkey AS VARCHAR) AS plan_id, 'sha256:' || sha256('{"profile":"' || CASE n_nationkey % 2 WHEN 0 THEN 'product' ELSE 'prototype' END || '"}') AS profile_hash, 'sha256:' || sha256('{"gates":["g1","g2"]}') AS gates_hash FROM nation""")
def engineering_hashes(spark, d):  # L13
    from loomdex.plans import evidence, records

    return evidence.engineering_hashes(records.from_texts(_whole_plans(spark, d)))


@query("SELECT 'plans/' || CAST(n_nationkey AS VARCHAR) || '.md' AS path, ['none', 'formatting', 'state', 'semantic'][n_nationkey % 4 + 1] AS difference FROM nation")
def plan_differences(spark, d):  # P17
    from loomdex.plans import workflow

    t = F.col("text")
    new = pick(F.col("k") % 4, t, F.replace(t, F.lit("## Goal\ng"), F.lit("## Goal\n\ng")), F.replace(t, F.lit("## Execution notes\ne"), F.lit("## Execution notes\nmore")), F.replace(t, F.lit("## Goal\ng"), F.lit("## Goal\nother")))
    return workflow.differences(_whole_plans(spark, d).select("path", t.alias("old"), new.alias("new")))


@query("""SELECT '{"batch":"B9","kind":"file","level":"direct","plan_id":"plan-' || CAST(n_nationkey AS VARCHAR) || '","ref":"t.py"}' AS item FROM nation WHERE n_nationkey % 5 <> 0""")
def impact_report(spark, d):  # K13, F7, O6
    from loomdex.plans import impact, records

    plans = records.from_texts(catalogue._plans(spark, d).withColumn("text", F.replace(F.col("text"), F.lit("status: draft"), F.lit("status: executing"))))
    found = impact.impact(plans, records.tasks(plans), ["t.py"], [], None, None).where("level = 'direct'")
    return found.select(udf.canonical(F.to_json(F.struct("ref", "plan_id", "level", "kind", "batch"))).alias("item"))


@query(catalogue.RESOLVED + " SELECT src_qname, dst_qname, count(*) AS count FROM resolved WHERE dst_qname IS NOT NULL GROUP BY 1, 2")
def resolved_by_difference(spark, d):  # L2, J7, K5: an index without the files of every eleventh part is resolved, then they come
    symbols, raw, refs = b.symbols(spark, d), b.raw_calls(spark, d), b.import_refs(spark, d)
    came = symbols.where("seq % 11 = 0").select(F.col("file").alias("path")).distinct()
    without = lambda df, c: df.join(came.select(F.col("path").alias(c)), c, "left_anti").select(*df.columns)
    old_symbols, old_refs = without(symbols, "file"), without(without(refs, "src_file"), "dst_file")
    old = resolve.resolve_calls(without(raw, "file"), old_symbols, old_refs)
    return resolve.call_edges(resolve.by_difference(checkpoint(old), raw, resolve.States(came, symbols, refs, old_symbols, old_refs)))


_IMPACT = b.with_("call_edges") + """, w AS (SELECT 'plan-' || CAST(p_partkey % 7 AS VARCHAR) AS plan_id, p_partkey % 7 IN (1, 2, 4, 5) AS open_, p_partkey AS number, 'B' || CAST(p_partkey % 3 AS VARCHAR) AS batch,
    'a/f' || CAST(p_partkey % 50 AS VARCHAR) || '.py' AS file, 's' || CAST(p_partkey AS VARCHAR) AS symbol, p_size > 5 AS changed FROM part),
  e AS (SELECT DISTINCT 's' || CAST(dst_qname AS VARCHAR) AS node, 'caller' AS direction, 's' || CAST(src_qname AS VARCHAR) AS other FROM call_edges UNION SELECT 's' || CAST(src_qname AS VARCHAR), 'callee', 's' || CAST(dst_qname AS VARCHAR) FROM call_edges),
  roots AS (SELECT symbol AS node FROM w WHERE changed), stops AS (SELECT symbol AS node FROM w WHERE open_), moved AS (SELECT DISTINCT 'b/f' || CAST(p_partkey % 30 AS VARCHAR) || '.py' AS path, 'a/f' || CAST(p_partkey % 30 AS VARCHAR) || '.py' AS ref FROM part),
  one AS (SELECT other, min({'v': node, 'd': direction}) AS by_ FROM e WHERE node IN (SELECT node FROM roots) AND other NOT IN (SELECT node FROM roots) GROUP BY other),
  two AS (SELECT e.other, min({'a': by_.v, 'b': by_.d, 'v': one.other, 'd': direction}) AS by_ FROM one JOIN e ON e.node = one.other WHERE one.other NOT IN (SELECT node FROM stops) AND e.other NOT IN (SELECT node FROM roots) AND e.other NOT IN (SELECT other FROM one) GROUP BY e.other),
  hits AS (SELECT other AS node, by_.v AS via, by_.d AS direction, 1 AS depth FROM one UNION ALL SELECT other, by_.v, by_.d, 2 FROM two),
  pf AS (SELECT plan_id, batch, file AS ref, min(number) AS task FROM w WHERE open_ GROUP BY 1, 2, 3),
  every AS (SELECT plan_id, 'direct' AS level, batch, 'symbol' AS kind, symbol AS ref, number AS task, NULL AS changed_ref, NULL AS direction, NULL AS graph_depth FROM w WHERE open_ AND changed
    UNION ALL SELECT plan_id, 'indirect', batch, 'symbol', symbol, number, via, direction, depth FROM w JOIN hits ON hits.node = symbol WHERE open_
    UNION ALL SELECT plan_id, 'possible', met.batch, 'file', met.ref, met.task, path, NULL, NULL FROM (SELECT plan_id, path, min({'ref': pf.ref, 'batch': batch, 'task': task}) AS met FROM pf JOIN moved ON moved.ref = pf.ref GROUP BY 1, 2)),
  counted AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS plan_rows, count(*) FILTER (level = 'possible') OVER (PARTITION BY plan_id) AS plan_possible, row_number() OVER (PARTITION BY plan_id, level ORDER BY batch, ref, changed_ref) AS n FROM every),
  kept AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY level, batch, kind, ref, changed_ref NULLS FIRST) AS m FROM counted WHERE level <> 'possible' OR n <= 12)"""


@query(_IMPACT + " SELECT plan_id, level, batch, kind, ref, CAST(task AS INTEGER) AS task, changed_ref, direction, CAST(graph_depth AS INTEGER) AS graph_depth, plan_rows, plan_possible FROM kept WHERE m <= 200")
def plan_impact(spark, d):  # P18, O12, O6, G5: plans of hundreds of tasks, of which some are over; every row of the tables takes part
    from loomdex.plans import impact

    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    plan, symbol = F.concat(F.lit("plan-"), (F.col("k") % 7).cast("string")).alias("plan_id"), F.concat(F.lit("s"), F.col("k").cast("string"))
    file = lambda folder, n: F.concat(F.lit(f"{folder}/f"), (F.col("k") % n).cast("string"), F.lit(".py"))
    none = F.array().cast("array<string>")
    plans = p.select(plan, F.when(F.col("k") % 7 == 0, "draft").when(F.col("k") % 7 == 3, "completed").when(F.col("k") % 7 == 6, "archived").otherwise("executing").alias("status"), none.alias("files"), none.alias("symbols")).distinct()
    tasks = p.select(plan, F.col("k").cast("int").alias("number"), F.concat(F.lit("B"), (F.col("k") % 3).cast("string")).alias("batch"), F.array(file("a", 50)).alias("files"), F.array(symbol).alias("symbols"))
    changed = p.where("p_size > 5").select(F.lit("symbol").alias("kind"), symbol.alias("ref")).union(p.select(F.lit("file"), file("b", 30)).distinct())
    named = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias(c)
    edges = b.call_edges(spark, d).select(named("src_qname"), named("dst_qname"), "count")
    got = impact.impact(plans, tasks, changed, None, p.select(file("a", 50).alias("file"), symbol.alias("qualified_name")), edges, parts=b.call_parts(spark, d))
    return got.select("plan_id", "level", "batch", "kind", "ref", "task", "changed_ref", "direction", "graph_depth", "plan_rows", "plan_possible")


# ---------------------------------------------------------------- the scan as one job


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST((p_partkey * 7) % 1000 AS VARCHAR) AS o FROM part), one AS (SELECT k FROM p)
  SELECT 'p' || p.k || '.f' || p.k AS src_qname, 'p' || p.o || '.f' || p.o AS dst_qname, CAST(1 AS BIGINT) AS count FROM p JOIN one ON one.k = p.o WHERE p.o <> p.k""")
def scanned_calls(spark, d):  # L1, K1, K2, K5, S20
    got = checkpoint(extract.extract_contents(catalogue._sources(spark, d)))  # parsed once for all tables
    symbols, files = extract.symbols_table(got), got.select("path")
    refs = resolve.import_edges(extract.imports_table(got), files, "merge")
    return resolve.call_edges(resolve.resolve_calls(extract.calls_table(got), symbols, refs, "merge"))  # there are as many symbols as calls
