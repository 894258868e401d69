import pytest
from pyspark.sql import functions as F

from loomdex.operators import changes, graph, quality, resolve, search, working_set

SYMBOLS = "file string, qualified_name string, name string, kind string, signature string, params string, returns string, description string, body string, bases array<string>, line int, end_line int, seq int"


def symbols(spark, rows):
    full = [(f, q, q.rsplit(".", 1)[-1], "function", sig, "()", "", desc, body, [], k + 1, k + 5, k) for k, (f, q, sig, desc, body) in enumerate(rows)]
    return spark.createDataFrame(full, SYMBOLS)


def test_file_actions(spark):
    schema = "path string, size long, mtime double, hash string"
    old = spark.createDataFrame([("same", 1, 1.0, "a"), ("touch", 1, 1.0, "a"), ("edit", 1, 1.0, "a"), ("gone", 1, 1.0, "a")], schema)
    new = spark.createDataFrame([("same", 1, 1.0, "zz"), ("touch", 1, 2.0, "a"), ("edit", 2, 1.0, "b"), ("new", 1, 1.0, "a")], schema)
    assert {tuple(r) for r in changes.file_actions(old, new).collect()} == {("same", "same"), ("touch", "touch"), ("edit", "changed"), ("gone", "deleted"), ("new", "new")}


def test_symbol_changes_and_renames(spark):
    big = "x" * 70000
    old = symbols(spark, [("a.py", "m.keep", "def keep()", "", "pass"), ("a.py", "m.body", "def body()", "", "one"), ("a.py", "m.blank", "def blank()", "", ""), ("a.py", "m.big", "def big()", "", big), ("a.py", "m.old1", "def old1(x)", "", "p"), ("a.py", "m.old2", "def old2(x)", "", "p"), ("b.py", "n.old3", "def old3(x)", "", "p"), ("a.py", "m.sig", "def sig()", "", "p")])
    new = symbols(spark, [("a.py", "m.keep", "def keep()", "", "pass"), ("a.py", "m.body", "def body()", "", "one\ntwo"), ("a.py", "m.blank", "def blank()", "", "now"), ("a.py", "m.big", "def big()", "", "small"), ("a.py", "m.new1", "def new1(x)", "", "p"), ("a.py", "m.new2", "def new2(x)", "", "p"), ("a.py", "m.new3", "def new3(x)", "", "p"), ("a.py", "m.sig", "def sig(a)", "", "p")])
    got = changes.pair_renames(changes.symbol_changes(old, new)).orderBy("file", "at").collect()
    assert [(r.symbol, r.change_type, r.old_value, r.new_value, r.detail) for r in got] == [
        ("m.body", "signature_stable", "def body()", "def body()", "+1/-0"), ("m.new1", "renamed", "m.old1", "m.new1", ""), ("m.new2", "renamed", "m.old2", "m.new2", ""), ("m.new3", "added", None, "def new3(x)", ""),
        ("m.sig", "signature_changed", "def sig()", "def sig(a)", ""), ("n.old3", "removed", "def old3(x)", None, ""),
    ]
    assert changes.symbol_changes(old, old).count() == 0


def test_log_questions(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "f", "p.a", "added", None, "s"), (2, 1, "2024-01-01 00:40:00", "f", "p.b", "renamed", "p.a", "p.b"), (3, 1, "2024-01-01 00:50:00", "f", "p.c", "renamed", "p.b", "p.c"), (3, 2, "2024-01-01 00:50:00", "f", "p_a", "added", None, "s"), (3, 3, "2024-01-01 00:50:00", "f", "q.A", "added", None, "s")]
    log = spark.createDataFrame(rows, "run_id long, seq int, ts string, file string, symbol string, change_type string, old_value string, new_value string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert changes.lineage(log, "p.c") == ["p.c", "p.b", "p.a"]
    assert [r.symbol for r in changes.history(log, "a").collect()] == ["p.a", "q.A"] and changes.history(log, "p.a").count() == 1 and changes.history(log, "_a").count() == 0
    runs = log.groupBy("run_id").agg(F.max("ts").alias("ts")).withColumn("k", F.lit(1))
    assert [(r.run_id, r.gap_seconds) for r in changes.gaps(runs, ["k"], "ts").collect()] == [(2, 2400)]
    assert {r.symbol: r.n for r in changes.change_counts(log, "a").collect()} == {"p.a": 1, "q.A": 1}


@pytest.mark.parametrize(("file", "source", "names", "want"), [
    ("src/app/cli.py", ".plans", ["X"], "src/app/plans.py"), ("src/app/cli.py", ".", ["store"], "src/app/store.py"), ("src/app/cli.py", ".", ["nothing"], "src/app/__init__.py"), ("src/app/sub/x.py", "..plans", ["X"], "src/app/plans.py"), ("src/app/cli.py", "src.app.store", [], "src/app/store.py"),
    ("src/app/cli.py", "src.app", [], "src/app/__init__.py"), ("src/app/cli.py", "os.path", [], None), ("main.py", ".util", ["f"], "util.py"), ("src/app/cli.py", ".sub.deep", ["f"], "src/app/sub/deep.py"),
    ("web/a.ts", "./lib", ["q"], "web/lib/index.ts"), ("web/x/a.ts", "../b", ["q"], "web/b.tsx"), ("web/a.ts", "./c.js", ["q"], "web/c.js"), ("web/a.ts", "./d.js", ["q"], "web/d.ts"), ("web/a.ts", "react", ["q"], None), ("p/a.go", "fmt", [], None),
])
def test_import_edges(spark, file, source, names, want):
    known = ["src/app/__init__.py", "src/app/cli.py", "src/app/plans.py", "src/app/store.py", "src/app/sub/deep.py", "util.py", "web/lib/index.ts", "web/b.tsx", "web/c.js", "web/d.ts"]
    files = spark.createDataFrame([(p,) for p in known], "path string")
    imports = spark.createDataFrame([(file, source, names, 0), (file, source, names, 1)], "file string, source string, names array<string>, seq int")
    got = resolve.import_edges(imports, files).collect()
    assert [(r.src_file, r.dst_file, r["count"]) for r in got] == ([(file, want, 2)] if want else [])
    assert not got or got[0].symbol == (names[0] if names else want)


def test_call_resolution_order(spark):
    own = symbols(spark, [(f, q, "", "", "") for f, q in [("p/a.py", "p.a.main"), ("p/a.py", "p.a.C.go"), ("p/a.py", "p.a.C.stop"), ("p/b.py", "p.b.helper"), ("p/a.py", "p.a.twin"), ("q/c.py", "q.c.twin"), ("p/d.py", "p.d.pair"), ("q/e.py", "q.e.pair"), ("q/f.py", "q.f.pair"), ("x/g.py", "x.g.far"), ("x/h.py", "x.h.far"), ("q/c.py", "q.c.only"), ("y/z.py", "y.z.m1"), ("y/w.py", "y.w.m1")]])
    refs = spark.createDataFrame([("p/a.py", "y/z.py", "z", 1), ("p/a.py", "p/b.py", "helper", 1)], "src_file string, dst_file string, symbol string, count long")
    cases = {
        ("p.a.C.go", "self.stop"): "p.a.C.stop", ("p.a.C.go", "cls.none"): None, ("p.a.C.go", "self.helper"): None, ("p.a.main", "helper"): "p.b.helper", ("p.a.main", "twin"): "p.a.twin", ("p.a.main", "pair"): "p.d.pair", ("p.a.main", "far"): None,
        ("p.a.main", "z.m1"): "y.z.m1", ("p.a.main", "mod.only"): "q.c.only", ("p.a.main", "obj.twin"): "p.a.twin", ("p.a.main", "obj.pair"): None, ("p.a.main", "print"): None, ("p.a.main", "main"): None, ("gone.f", "helper"): None, ("q.c.only", "pair"): None,
    }
    raw = spark.createDataFrame([("f", s, c, k) for k, (s, c) in enumerate(cases)], "file string, src_qname string, callee_raw string, line int")
    got = resolve.resolve_calls(raw, own, refs)
    assert {(r.src_qname, r.callee_raw): r.dst_qname for r in got.collect()} == cases
    rate = resolve.resolution_rate(got).first()
    assert (rate.total, rate.resolved, rate.rate) == (15, 7, round(7 / 15, 4)) and resolve.resolution_rate(got.limit(0)).first().rate == 1.0


def test_bounded_search_follows_a_queue(spark):
    edges = [("a", "b"), ("c", "a"), ("b", "d"), ("d", "e"), ("c", "f"), ("f", "g"), ("z", "a"), ("b", "p1"), ("p1", "p2"), ("a", "p0")]
    df = spark.createDataFrame([(s, d, 1) for s, d in edges], "src_qname string, dst_qname string, count long")
    node = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node string")

    def queue(roots, stops, depth, most):
        seen, todo, out = set(roots), [(r, 0) for r in sorted(roots)], set()
        while todo:
            now, d = todo.pop(0)
            if d >= depth:
                continue
            near = sorted({("caller", s) for s, x in edges if x == now} | {("callee", x) for s, x in edges if s == now})
            for direction, n in near:
                if n in seen:
                    continue
                seen.add(n)
                if len(seen) > most:
                    continue
                if n in stops:
                    out.add((n, now, direction, d + 1))
                else:
                    todo.append((n, d + 1))
        return out

    for most in (256, 5, 4, 3, 1):
        for depth in (1, 2):
            got = graph.bounded_search(df, node("a"), node("p0", "p1", "p2", "d", "f"), depth, most)
            assert {tuple(r) for r in got.collect()} == queue({"a"}, {"p0", "p1", "p2", "d", "f"}, depth, most), (most, depth)
    assert {(r.node, r.depth) for r in graph.reach(df, node("a"), 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("z", 1), ("p0", 1), ("d", 2), ("p1", 2), ("f", 2)}


def test_whole_search_equals_the_queue_without_a_bound(spark):
    import random

    rng = random.Random(5)
    for depth, n in ((1, 30), (2, 40), (3, 40)):
        edges = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(60)})
        roots, stops = {f"n{rng.randrange(n):02d}" for _ in range(4)} | {"absent"}, {f"n{rng.randrange(n):02d}" for _ in range(12)}
        seen, todo, want = set(roots), [(r, 0) for r in sorted(roots)], set()
        while todo:
            now, d = todo.pop(0)
            for direction, m in sorted({("caller", s) for s, x in edges if x == now} | {("callee", x) for s, x in edges if s == now}) if d < depth else []:
                if m not in seen:
                    seen.add(m)
                    want |= {(m, now, direction, d + 1)} if m in stops else set()
                    todo += [] if m in stops else [(m, d + 1)]
        node = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "node string")
        got = graph.search(spark.createDataFrame([(*e, 1) for e in edges], "src_qname string, dst_qname string, count long"), node(roots), node(stops), depth)
        assert {tuple(r) for r in got.hits.collect()} == want and not got.cut


def test_three_hundred_roots_give_every_hit_or_a_mark(spark):
    edges = spark.range(300).select(F.concat(F.lit("c"), "id").alias("src_qname"), F.concat(F.lit("r"), "id").alias("dst_qname"), F.lit(1).alias("count"))
    roots, stops = edges.select(F.col("dst_qname").alias("node")), edges.select(F.col("src_qname").alias("node"))
    whole, bounded = graph.search(edges, roots, stops), graph.search(edges, roots, stops, most=256)
    assert whole.hits.count() == 300 and not whole.cut and bounded.cut and bounded.hits.count() == 0
    few = graph.search(edges, roots.limit(5), stops, most=256)
    assert few.hits.count() == 5 and not few.cut


def test_top_per_key_says_how_many_there_are(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = changes.top_per_key(df, ["k"], [F.desc("v")], 2).collect()
    assert sorted((r.k, r.v, r.of) for r in got) == [(0, 996, 334), (0, 999, 334), (1, 994, 333), (1, 997, 333), (2, 995, 333), (2, 998, 333)]
    assert "WindowGroupLimit" in changes.top_per_key(df, ["k"], [F.desc("v")], 2)._jdf.queryExecution().executedPlan().toString()


def test_cycles_tree_inheritance_neighbours(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("5", "5"), ("4", "6")], "src string, dst string")
    assert {r.node for r in graph.cycle_nodes(e).collect()} == {"1", "2", "3", "5"} and graph.cycle_nodes(e.limit(0)).count() == 0
    f = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")
    assert {tuple(r) for r in graph.tree_edges(f).collect()} == {("", "a"), ("a", "a/b"), ("a/b", "a/b/c.py"), ("a", "a/d.py"), ("", "e.py")}
    s = symbols(spark, [("p/a.py", "p.a.f", "", "", ""), ("p/b.py", "p.b.g", "", "", ""), ("p/b.py", "p.b.h", "", "", ""), ("q/c.py", "q.c.i", "", "", "")])
    calls = spark.createDataFrame([("q.c.i", "p.a.f", 1), ("p.a.f", "p.b.g", 1), ("q.c.i", "p.b.h", 1)], "src_qname string, dst_qname string, count long")
    refs = spark.createDataFrame([("p/a.py", "q/c.py", "x", 1)], "src_file string, dst_file string, symbol string, count long")
    assert [r.page for r in graph.prefetch_order("p.a.f", s, calls, refs).collect()] == ["q.c.i", "p.b.g", "p.b.h", "q/c.py"]


def test_search(spark):
    s = symbols(spark, [("a.py", "m.save", "def save(x)", "Saves.", ""), ("a.py", "m.save_all", "def save_all()", "", ""), ("b.py", "n.load", "def load()", "not saved_here", ""), ("b.py", "n.打印消息", "def 打印消息()", "输出文本", ""), ("c.py", "o.io", "def io()", "", "")])
    assert [r.qualified_name for r in search.like_rank(s, "save").collect()] == ["m.save", "m.save_all", "n.load"]
    assert search.like_rank(s, "a_v").count() == 0 and search.like_rank(s, "%").count() == 0
    assert search.search(s, "打印消息").first().qualified_name == "n.打印消息" and search.search(s, "io").first().qualified_name == "o.io" and search.search(s, "m.save").first().qualified_name == "m.save"
    hits = search.search(s, "save def").collect()
    assert [h.qualified_name for h in hits] == ["m.save", "m.save_all", "n.load"] and hits[0].score <= hits[1].score <= hits[2].score
    many = symbols(spark, [("f.py", f"m.x{i}", "aaaa" if i == 3 else "b", "", "") for i in range(20)])
    assert [(r.name, r.score < 0) for r in search.bm25(many, "aaa").collect()] == [("x3", True)]
    e = spark.createDataFrame([("n.load", "m.save", 1), ("m.save", "o.io", 1)], "src_qname string, dst_qname string, count long")
    got = search.evidence(s, e, "please save it").orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.kind, r.qualified_name, r.confidence) for r in got][:2] == [("ev-0001", "symbol", "m.save", 0.95), ("ev-0002", "symbol", "n.load", 0.7)] or got[0].qualified_name == "m.save"
    assert {r.kind for r in got} >= {"symbol", "callee"}


def test_working_set(spark):
    schema = "page_id string, session_id string, plan_id string, batch_id string, pinned boolean, tokens long, score double, last_access_at int, origin string"
    ws = spark.createDataFrame([("a", "", "", "", False, 100, 0.1, 1, "load"), ("b", "", "", "", False, 200, 0.2, 2, "load"), ("c", "", "", "", True, 300, 0.0, 3, "load"), ("d", "", "", "", False, 50, 0.3, 4, "prefetch"), ("e", "s", "p", "", False, 10, 0.5, 5, "load")], schema)
    assert {r.page_id for r in working_set.in_scope(ws).collect()} == {"a", "b", "c", "d"} and {r.page_id for r in working_set.in_scope(ws, plan_id="p").collect()} == {"e"} and working_set.in_scope(ws, "s", "q").count() == 0
    pages = lambda df: {r.page_id for r in df.collect()}
    own = working_set.in_scope(ws)
    assert pages(working_set.evictions(own, F.lit(1))) == {"a"} and pages(working_set.evictions(own, F.lit(101))) == {"a", "b"} and pages(working_set.evictions(own, F.lit(0))) == set() and pages(working_set.evictions(own, F.lit(9999))) == {"a", "b", "d"}
    assert {(r.page_id, r.reason) for r in working_set.enforce(own, 560, 2).collect()} == {("a", "tokens"), ("b", "pages")}
    assert pages(working_set.rendered(own, F.lit(360))) == {"c", "d"} and pages(working_set.rendered(own, F.lit(1))) == {"d"}
    rows = spark.createDataFrame([("k", 1, "x", 60), ("k", 2, "y", 50), ("k", 3, "z", 40), ("k", 4, "w", 1)], "k string, o int, name string, cost int")
    assert {r.name for r in working_set.greedy(rows, 100, ["k"], ["o"]).collect()} == {"x", "z"}
    assert [working_set.greedy_walk(rows, room, ["o"], chunk=c) for room in (100, 0, 41, 999) for c in (1, 2, 100)] == [["x", "z"]] * 3 + [[]] * 3 + [["z", "w"]] * 3 + [["x", "y", "z", "w"]] * 3
    src = spark.createDataFrame([("p", "\n".join(["abc"] * 10)), ("q", "x" * 9000)], "page_id string, source string")
    assert {r.page_id: r.excerpt.count("\n") for r in working_set.excerpt(src, 6).collect()} == {"p": 2, "q": 0}


def test_status_and_loads(spark):
    s = symbols(spark, [("a.py", "m.f", "", "", ""), ("b.py", "m.g", "", "", "")])
    files = spark.createDataFrame([("a.py", "h1"), ("b.py", "h2"), ("d/c.py", "h3")], "path string, hash string")
    pages = spark.createDataFrame([("m.f", "a.py", "h1"), ("m.g", "b.py", "old"), ("d/c.py", "d/c.py", "h3"), ("gone", "x.py", "h")], "page_id string, file string, version string")
    ws = pages.select("page_id")
    assert {r.page_id: r.state for r in working_set.status(ws, s, files, pages.drop("file")).collect()} == {"m.f": "fresh", "m.g": "stale", "d/c.py": "fresh", "gone": "gone"}
    assert working_set.stale_count(pages, files).first().n == 1


def test_quality(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b"), ("y", "x")], "src string, dst string")
    known = spark.createDataFrame([("a",), ("b",)], "n string")
    got = quality.dangling(edges, known.select(F.col("n").alias("src")), known.select(F.col("n").alias("dst")))
    assert {(r.src, r.dst, r.kind) for r in got.collect()} == {("a", "x", "target"), ("y", "b", "source"), ("y", "x", "both")}
    refs = spark.createDataFrame([("m.C.f",), ("C.f",), ("f",), ("app/a.py",), ("a.py",), ("py",), ("g",)], "ref string")
    names = spark.createDataFrame([("m.C.f",), ("src/app/a.py",)], "q string")
    assert {r.ref for r in quality.unresolved(refs, names, "ref", "q").collect()} == {"g"}


def test_circles_are_found_beside_long_chains(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    edges = spark.createDataFrame([*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "n000"), ("s", "s")], "src string, dst string")
    assert sorted(r.node for r in graph.cycle_nodes(edges).collect()) == ["a", "b", "c", "s"]
    assert graph.cycle_nodes(spark.createDataFrame(chain, "src string, dst string")).count() == 0


def test_names_resolve_to_pages(spark):
    symbols = spark.createDataFrame([("a.f", "f", "a.py"), ("b.f", "f", "b.py"), ("b.g", "g", "b.py")], "qualified_name string, name string, file string")
    files = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    names = spark.createDataFrame([("f",), ("g",), ("a.f",), ("a.py",), ("c.py",), ("zz",)], "name string")
    got = {r.name: (r.state, r.page_id, r.file, r.n) for r in working_set.resolved(names, symbols, files).collect()}
    assert got == {"f": ("ambiguous", None, None, 2), "g": ("symbol", "b.g", "b.py", None), "a.f": ("symbol", "a.f", "a.py", None), "a.py": ("file", "a.py", "a.py", None), "c.py": ("unknown", None, None, None), "zz": ("unknown", None, None, None)}


def test_resolution_by_difference_equals_resolution_anew(spark):
    import random

    rng = random.Random(11)
    names, files = [f"f{k}" for k in range(9)], [f"{d}/m{k}.py" for d in "pq" for k in range(4)]
    prefix = lambda f: f[:-3].replace("/", ".")

    def world(base=None, edited=()):
        """Symbols, raw calls and references of every file; those of files that aren't edited as before."""
        out = {}
        for f in files:
            if base and f not in edited:
                out[f] = base[f]
                continue
            own = [(f, f"{prefix(f)}.{n}", f"def {n}()", "", "") for n in rng.sample(names, rng.randrange(0, 5))]
            own += [(f, f"{prefix(f)}.C.{n}", "def x(self)", "", "") for n in rng.sample(names, rng.randrange(0, 2))] + ([("p/m0.py", "shared.twin", "", "", "")] if f == "p/m0.py" else [])
            callee = lambda: rng.choice([rng.choice(names), "self." + rng.choice(names), rng.choice(["h0", "h1", "x"]) + "." + rng.choice(names), "a.b." + rng.choice(names)])
            calls = [(f, rng.choice([q for _, q, *_ in own]) if own else "none.here", callee(), k, k) for k in range(rng.randrange(0, 9))]
            imports = [(f, rng.choice(files), f"h{k}", 1) for k in range(rng.randrange(0, 3))]
            out[f] = (own, calls, imports)
        return out

    def frames(w):
        each = [[x for f in files for x in w[f][k]] for k in range(3)]
        raw, refs = "file string, src_qname string, callee_raw string, line int, seq int", "src_file string, dst_file string, symbol string, count long"
        return symbols(spark, each[0]), spark.createDataFrame(each[1], raw), spark.createDataFrame(each[2], refs)

    before, kept = world(), 0
    for k in range(2):
        edited = rng.sample(files, (1, 4)[k])
        after = world(before, edited)
        # a reference may change in a file that nobody touched, where its target came or went
        other = rng.choice(files)
        after[other] = (*after[other][:2], [(other, rng.choice(files), "h0", 1)])
        (s0, r0, f0), (s1, r1, f1) = frames(before), frames(after)
        old = resolve.resolve_calls(r0, s0, f0)
        at = resolve.States(spark.createDataFrame([(f,) for f in edited], "path string"), s1, f1, s0, f0)
        want, got = sorted(map(tuple, resolve.resolve_calls(r1, s1, f1).collect()), key=repr), sorted(map(tuple, resolve.by_difference(old, r1, at).collect()), key=repr)
        assert got == want
        kept += resolve.marked(r1, resolve.altered(at)).where("not again").count()
        before = after
    assert kept


def _circles(edges):
    """Node to the set of its strongly connected component, of the nodes that reach themselves; by plain closure."""
    reach = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            now = todo.pop()
            for x, y in edges:
                if x == now and y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    return {a: frozenset(b for b in r if a in reach.get(b, ())) for a, r in reach.items() if a in r}


def test_circles_equal_the_closure(spark):
    import random

    rng = random.Random(9)
    rings = [(k, (k + 1) % 5) for k in range(5)] + [(10, 11), (11, 12), (12, 13), (13, 10), (12, 10)] + [(20 + k, 21 + k) for k in range(7)] + [(30, 30), (30, 31)]
    two = [(40, 41), (41, 42), (42, 40), (42, 43), (43, 44), (44, 45), (45, 46), (46, 44)]
    for edges in (rings, two, sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)}), []):
        got = graph.circles(spark.createDataFrame(edges, "src long, dst long")).collect()
        want, by = _circles(edges), {}
        for r in got:
            by.setdefault(r.component, set()).add(r.node)
        assert len(got) == len({r.node for r in got}) and {r.node: frozenset(by[r.component]) for r in got} == want


def test_a_long_ring_and_a_long_path_end(spark):
    n = 4_000  # 100,000 end as well, in some minutes
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    path = spark.range(n, 2 * n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.circles(ring.union(path).union(spark.range(1).selectExpr("5L as src", f"{n}L as dst")))
    assert got.agg(F.count("*"), F.max("node"), F.countDistinct("component")).first() == (n, n - 1, 1)


def test_lineages_of_names_that_come_again(spark):
    schema = "run_id long, seq long, ts string, symbol string, change_type string, old_value string"
    rows = [(1, 1, "2024-01-01", "b", "renamed", "a"), (1, 2, "2024-01-02", "c", "renamed", "b"), (2, 1, "2024-01-03", "b", "renamed", "z"), (2, 2, "2024-01-03", "a", "renamed", "c"), (3, 1, "2024-01-04", "d", "renamed", "b"), (3, 2, "2024-01-05", "x", "added", None), (3, 3, "2024-01-06", "y", "renamed", "y")]
    rows += [(9, k, "2025-01-01", f"n{k + 1}", "renamed", f"n{k}") for k in range(40)]
    log = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.symbol: (r.origin, r.renames) for r in changes.lineages(log).collect()}
    assert {k: v for k, v in got.items() if k[0] != "n"} == {"b": ("z", 1), "c": ("a", 2), "a": ("a", 3), "d": ("z", 2)}
    assert all(got[f"n{k}"] == ("n0", k) for k in range(1, 41))
    assert changes.lineage(log, "n40") == [f"n{k}" for k in range(40, -1, -1)] and changes.lineage(log, "d") == ["d", "b", "z"]
    assert changes.lineage(log, "a") == ["a", "c", "b"] and changes.lineage(log, "x") == ["x"] and changes.lineages(log.limit(0)).count() == 0


def test_wide_evictions_equal_the_window(spark):
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else f"s{rng.randrange(4)}", k, rng.randrange(0, 40), rng.randrange(5) / 4, rng.random() < 0.1) for k in range(4000)]
    df = spark.createDataFrame(rows, "session_id string, page_id long, tokens long, score double, pinned boolean").repartition(6)
    for need in (1, 700, 30_000, 10**9):
        of = df.select("session_id").distinct().select("session_id", F.when(F.col("session_id") == "s1", F.lit(0)).otherwise(F.lit(need)).alias("need"))
        want = working_set.evictions(df.join(of, "session_id"), F.col("need"), ["session_id"]).select(*df.columns, "freed_before")
        assert sorted(map(tuple, working_set.evictions_wide(df, of, ["session_id"]).collect())) == sorted(map(tuple, want.collect()))
    plan = working_set.evictions_wide(df, of, ["session_id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and "_part" in plan and working_set.evictions_wide(df.limit(0), of, ["session_id"]).count() == 0


def test_circles_in_few_jobs_and_named_alike_where_a_node_points_to_itself(spark):
    """Trees 60 deep lead into a ring; and a node with an edge to itself stands within a larger component."""
    ring = [(k, (k + 1) % 3) for k in range(3)]
    deep = [(100 + k, 99 + k if k else 0) for k in range(60)] + [(200 + k, 199 + k if k else 100) for k in range(60)]
    inner = [(1005, 1001), (1001, 1001), (1001, 1006), (1006, 1005), (1005, 1006), (1002, 1005), (1006, 1002), (1002, 1003), (1003, 1004), (1004, 1002)]
    jobs, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("circles", "circles")
    try:
        got = graph.circles(spark.createDataFrame(ring + deep + inner, "src long, dst long")).collect()
        many = len(jobs.getJobIdsForGroup("circles"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    want, by = _circles(ring + deep + inner), {}
    for r in got:
        by.setdefault(r.component, set()).add(r.node)
    assert {r.node: frozenset(by[r.component]) for r in got} == want and len(got) == 9
    assert many < 400


def test_tasks_follow_the_number_of_calls(spark, monkeypatch):
    """A task takes so many rows at most, however few partitions adaptive execution would make of them."""
    from loomdex import bindings, runtime
    from tests.test_catalogue import FOLDER

    monkeypatch.setattr(runtime, "TASK_ROWS", 300)
    parts = bindings.call_parts(spark, FOLDER)
    assert parts == -(-bindings.table(spark, FOLDER, "lineitem").count() // 300) > 8
    edges = bindings.call_edges(spark, FOLDER)
    for df in (bindings.steps(spark, FOLDER), edges, graph.ranked_neighbours(edges, 2, parts=parts)):
        assert df.rdd.getNumPartitions() == parts


def test_neighbours_and_reach_of_repeated_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "d"), ("d", "a"), ("a", "b")], "src_qname string, dst_qname string")
    got = sorted((r.node, r.direction, r.name, r["rank"]) for r in graph.ranked_neighbours(edges, 2, parts=3).collect())
    assert got == [("a", "callee", "b", 1), ("a", "callee", "c", 2), ("a", "caller", "d", 1), ("b", "caller", "a", 1), ("c", "caller", "a", 1), ("d", "callee", "a", 1), ("d", "caller", "a", 1)]
    assert sorted(map(tuple, graph.reach(edges, spark.createDataFrame([("b",)], "node string"), 2).collect())) == [("a", 1), ("b", 0), ("c", 2), ("d", 2)]


def test_search_keeps_only_edges_to_nodes_not_seen(spark, monkeypatch):
    """What a step stores are edges that it may follow, not all."""
    sizes, real = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: sizes.append((out := real(df)).count()) or out)
    edges = spark.createDataFrame([(f"r{k}", f"r{j}") for k in range(9) for j in range(9) if k != j] + [("r0", "x"), ("x", "y")], "src_qname string, dst_qname string")
    roots, stops = spark.createDataFrame([(f"r{k}",) for k in range(9)], "node string"), spark.createDataFrame([("y",)], "node string")
    got = graph.search(edges, roots, stops, 2, parts=4)
    assert [tuple(r) for r in got.hits.collect()] == [("y", "x", "callee", 2)] and not got.cut and max(sizes) == 9
