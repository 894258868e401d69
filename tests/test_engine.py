import pytest
from pyspark.sql import functions as F

from loomdex.engine import AmbiguousSymbol, Index, IndexMissing, LeaseHeld
from loomdex.operators.render import write_details

FILES = {
    "src/__init__.py": "", "src/pkg/__init__.py": "",
    "src/pkg/service.py": 'from .store import save\nclass Service(Base):\n    def create(self, a):\n        """Create it."""\n        self.check(a)\n        return save(a)\n    def check(self, a): pass\n',
    "src/pkg/store.py": "def save(x):\n    return fmt(x)\ndef fmt(x):\n    return str(x)\n", "src/app.ts": 'import { a } from "./lib/util";\nexport function main() { a(); go(); }\nfunction go() {}\n', "src/lib/util.ts": "export const a = () => 1;\n",
}


def write(root, files):
    for p, s in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(s)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def state(i):
    """What an incremental index must share with one that is made anew."""
    return [rows(i.table("symbols"), "file", "qualified_name", "signature", "line"), rows(i.table("refs"), "src_file", "dst_file", "symbol", "count"), rows(i.table("call_edges"), "src_qname", "dst_qname", "count"), rows(i.table("files"), "path", "hash"), rows(i.table("raw_calls"), "src_qname", "callee_raw", "line")]


def test_lifecycle(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, FILES)
    i = Index(spark, root, tmp_path / "w")
    with pytest.raises(IndexMissing):
        i.search("save")
    out = i.scan()
    assert (out.files, out.changes, out.errors, out.full) == (6, 8, [], True) and out.rate == round(5 / 6, 4)
    assert rows(i.table("call_edges"), "src_qname", "dst_qname") == [("src.pkg.service.Service.create", "src.pkg.service.Service.check"), ("src.pkg.service.Service.create", "src.pkg.store.save"), ("src.pkg.store.save", "src.pkg.store.fmt"), ("src/app.main", "src/app.go"), ("src/app.main", "src/lib/util.a")]
    assert i.doctor().count() == 0
    again = i.update()
    assert (again.changed, again.deleted, again.changes) == (0, 0, 0)

    write(root, {"src/pkg/store.py": "def save(x, y=1):\n    return fmt2(x)\ndef fmt2(x):\n    z = 1\n    return str(x)\n", "src/pkg/extra.py": "from .store import save\ndef use(): save(1)\n", "src/bad.py": "def (:"})
    (root / "src/lib/util.ts").unlink()
    assert {tuple(r) for r in i.doctor().collect()} == {("symbols of a file that is gone", "src/lib/util.ts")}
    out = i.update()
    assert (out.changed, out.deleted, out.changes) == (3, 1, 4) and [p for p, _ in out.errors] == ["src/bad.py"]
    log = i.table("changes").where("run_id = 2").orderBy("seq").collect()
    assert [(r.symbol, r.change_type) for r in log] == [("src/lib/util.a", "removed"), ("src.pkg.extra.use", "added"), ("src.pkg.store.save", "signature_changed"), ("src.pkg.store.fmt2", "renamed")]
    assert i.doctor().count() == 0
    fresh = Index(spark, root, tmp_path / "w2")
    fresh.scan()
    assert state(i) == state(fresh)
    assert [r.change_type for r in i.history("src.pkg.store.fmt2").collect()] == ["added", "renamed"]
    assert [r.name for r in i.callers("src.pkg.store.save").collect()] == ["src.pkg.extra.use", "src.pkg.service.Service.create"]
    assert [r.path for r in i.related("src/pkg/store.py").collect()] == ["src/pkg/extra.py", "src/pkg/service.py"]
    import os

    os.utime(root / "src/app.ts", (1, 1))
    out = i.update()
    assert (out.changed, out.changes) == (0, 0) and i.table("files").where("path = 'src/app.ts'").first().mtime == 1.0

    text = i.overview()
    assert "files: 7" in text and "| `src/app.ts` | typescript | entry | 2 |" in text and "left out" not in text
    assert "file(s) left out" in i.overview(420)
    docs = write_details(i.details(), tmp_path / "docs")
    (tmp_path / "docs" / "old-12345678.md").write_text("")
    assert write_details(i.details(), tmp_path / "docs") == docs and len(list((tmp_path / "docs").iterdir())) == 1
    assert "No changes" not in i.history_document()
    found = i.plan_context("create the save service")
    assert found["status"] == "ok" and found["evidence"][0]["confidence"] == 0.95 and not any(e.get("stale") for e in found["evidence"]) and found["engineering"]["profile"] == "product"
    assert i.plan_context("create the save service", tokens=1)["truncated"] and i.plan_context("a")["error_code"] == "EMPTY_QUERY"


def test_context(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, FILES | {"src/other.py": "def save(): pass\n"})
    i = Index(spark, root, tmp_path / "w")
    i.scan()
    with pytest.raises(AmbiguousSymbol) as e:
        i.context_load("save")
    assert e.value.candidates == ["src.other.save", "src.pkg.store.save"]
    with pytest.raises(LookupError):
        i.context_load("nothing")
    got = i.context_load("create", with_source=True)
    assert got["page"]["callees"] == ["src.pkg.service.Service.check", "src.pkg.store.save"] and "Create it." in got["rendered"] and "self.check(a)" in got["rendered"]
    assert {r.page_id: (r.origin, r.state) for r in i.context_status().collect()} == {"src.pkg.service.Service.create": ("load", "fresh")} | {p: ("prefetch", "fresh") for p in got["prefetched"]}
    i.context_load("src.pkg.store.save", prefetch=False)
    assert i.table("working_set").where("page_id = 'src.pkg.store.save'").first().origin == "load" and i.table("pages").where("page_id = 'src.pkg.store.save'").first().load_count == 2
    i.context_load("src/pkg/store.py", session="s", pin=True)
    assert rows(i.context_status(session="s"), "page_id", "pinned", "tokens") == [("src/pkg/store.py", True, 24)]
    with pytest.raises(ValueError, match="pinned"):
        i.context_evict("src/pkg/store.py", session="s")
    assert i.context_evict("src/pkg/store.py", session="s", force=True)["freed"] == 24
    i.context_pin("src.pkg.service.Service.create")
    out = i.context_evict(need=10_000)
    assert out["unsatisfied"] > 0 and rows(i.context_status(), "page_id") == [("src.pkg.service.Service.create",)]
    assert "### src.pkg.service.Service.create" in i.context_render()
    assert i.context_budget(max_pages=1)["max_pages"] == 1
    got = i.context_load("fmt", prefetch=False)
    assert got["evicted"] == [] and i.table("working_set").count() == 2
    with pytest.raises(ValueError):
        i.context_budget(nothing=1)
    write(root, {"src/pkg/store.py": "def save(x): pass\n"})
    i.update()
    assert {r.page_id: r.state for r in i.context_status().collect()} == {"src.pkg.service.Service.create": "fresh", "src.pkg.store.fmt": "gone"}
    with i.lease(owner="one"), pytest.raises(LeaseHeld), i.lease(owner="two"):
        pass
    with i.lease(owner="one", seconds=-1), i.lease(owner="two"):
        pass
    assert {r.problem for r in i.doctor().collect()} == {"working set entry without page"}


def test_command_line(spark, tmp_path, capsys):
    from loomdex.cli import main

    root = tmp_path / "repo"
    write(root, FILES)
    run = lambda *a: main(["--root", str(root), *a], spark)
    assert run("query", "save") == 2 and run("doctor") == 1 and run("version") == 0
    assert run("scan") == 0 and run("update") == 0 and run("query", "save") == 0 and run("callers", "src.pkg.store.save") == 0 and run("history", "save") == 0 and run("doctor") == 0
    assert run("context", "load", "create") == 0 and run("context", "status") == 0 and run("context", "budget", "--set", "total=100") == 0 and run("context", "evict", "--all") == 0 and run("context", "ws") == 0
    assert run("context", "load", "none") == 1 and run("overview") == 0 and run("details", str(tmp_path / "d")) == 0 and run("plan-context", "save it") == 0 and run("history-document") == 0
    plans = str(tmp_path / "plans")
    assert run("plan", "new", plans, "p1", "First") == 0 and run("plan", "lint", plans) == 0 and run("plan", "status", plans) == 0
    path = f"{plans}/p1.md"
    assert run("plan", "approve", path, "me") == 0 and run("plan", "start", path, "B1") == 0 and run("plan", "complete", path, "B1") == 1
    assert run("plan", "gate-record", path, "B1", "unit-tests", "passed") == 0 and run("plan", "complete", path, "B1") == 0 and run("plan", "show", path) == 0
    assert '"status": "done"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("unknown")


def test_update_touches_plans(spark, tmp_path):
    from loomdex.plans import records, upkeep, workflow

    root, plans = tmp_path / "repo", tmp_path / "repo" / "plans"
    write(root, {"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"})
    i = Index(spark, root, tmp_path / "w")
    i.scan()
    w = workflow.Workflow.create(plans, "p1", "Title")
    head, body = records.frontmatter(w.path.read_text())
    w.path.write_text(workflow.document(head, body.replace("| 1 | B1 | none | none", "| 1 | B1 | a.py | a.f").replace("| B1 | pending | none |", "| B1 | pending | none |\n| B2 | pending | B1 |")))
    w.approve("me")
    w.batch("B1", "start")
    w.gate("B1", "unit-tests", "passed", upkeep.current_fingerprints(records.read(spark, str(plans)), i.table("files")).first().current)
    w.batch("B1", "complete")
    write(root, {"b.py": "def g(x): pass\n"})
    i.update()
    assert i.update_plans(str(plans))["marked"] == []
    write(root, {"a.py": "def f(x): pass\n"})
    i.update()
    done = i.update_plans(str(plans))
    assert [(m["batch"], m["gates"]) for m in done["marked"]] == [("B1", ["unit-tests"])] and w.plan.batches[0]["status"] == "stale"
    report = (tmp_path / "w" / "plans" / "impact-report.json").read_text()
    assert '"level":"direct"' in report and '"ref":"a.f"' in report


def test_full_scan_logs_every_symbol_again(spark, tmp_path):
    write(tmp_path / "repo", {"a.py": "def f(): pass\n"})
    i = Index(spark, tmp_path / "repo", tmp_path / "w")
    i.scan()
    i.scan()
    assert i.table("changes").where(F.col("change_type") == "added").count() == 2 and i.table("symbols").count() == 1


def test_empty_tree(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    i = Index(spark, tmp_path / "repo", tmp_path / "w")
    out = i.scan()
    assert (out.files, out.changes, out.rate) == (0, 0, 1.0) and i.doctor().count() == 0


def test_an_update_writes_touched_buckets_only(spark, tmp_path, monkeypatch):
    """Files of untouched buckets stay as they are, byte and time; what the update gives equals an index made anew."""
    monkeypatch.setattr("loomdex.engine.LEAST_BUCKETS", 16)
    root, home = tmp_path / "repo", tmp_path / "w"
    write(root, {f"m{k}.py": f"from m{(k + 1) % 24} import f{(k + 1) % 24}\ndef f{k}():\n    return f{(k + 1) % 24}()\ndef only{k}(): pass\n" for k in range(24)})
    i = Index(spark, root, home)
    i.scan()
    parts = lambda: {p: p.stat().st_mtime_ns for name in ("symbols", "imports", "raw_calls", "resolved", "call_edges", "refs", "files", "grams", "sizes") for p in (home / "tables" / name).rglob("*.parquet")}
    before = parts()
    assert len({p.parent.name for p in before}) > 8
    write(root, {"m3.py": "from m4 import f4\ndef g3():\n    return f4()\ndef only3(): pass\n"})
    out = i.update()
    assert (out.changed, out.deleted) == (1, 0)
    after = parts()
    assert all(after[p] == t for p, t in before.items() if p in after)
    fresh = [p for p in after if p not in before]
    for name, most in (("symbols", 1), ("imports", 1), ("grams", 1), ("sizes", 1), ("raw_calls", 1), ("files", 1), ("resolved", 2), ("refs", 1), ("call_edges", 3)):
        assert len({p.parent for p in fresh if p.parts[-4] == name}) <= most, name
    (root / "m5.py").unlink()
    assert i.update().deleted == 1
    anew = Index(spark, root, tmp_path / "w2")
    anew.scan()
    assert state(i) == state(anew)
    for name, columns in (("resolved", ("src_qname", "callee_raw", "line", "dst_qname")), ("grams", ("gram", "file")), ("sizes", ("file", "symbols", "length")), ("files", ("path",))):
        assert rows(i.table(name).na.fill(""), *columns) == rows(anew.table(name).na.fill(""), *columns)
    from loomdex.operators import search

    for q in ("f1 only", "def only3", "nothing here"):
        assert [tuple(r) for r in i.search(q).collect()] == [tuple(r) for r in search.search(i.table("symbols"), q).collect()]
    assert i.doctor().count() == 0
    left = {p.parent for p in (home / "tables").rglob("*.parquet")}
    read = {home / p for tables in (i.meta["tables"], i.meta["before"]) for n in tables for p in i._paths(tables, n)}
    assert left <= read
