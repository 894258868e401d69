from pathlib import Path

import pytest

from loomdex.sources import extract, golang, python, script
from loomdex.sources.walk import IgnoreRules, source_files

PY = '''import os, sys as s
from .plans import X, Y as Z
from . import helper
@dec(arg())
def process(item_id: int,
            b="(") -> str:
    """Process one item."""
    x = self.go(helper(1)).done()
    def inner(): hidden()
    return [f(y) for y in z]
class ItemService(Base, m.Other, metaclass=M):
    "Doc"
    class Nested:
        async def deep(self): await self.x()
    def rename(self): return cls.y(lambda: q())
if True:
    def skipped(): pass
    import late
'''
TS = '''import def, { a as b, c } from "./helper";
import * as ns from '../x';
import './side';
/** Entry point. */
export function bootstrap(cfg: Config, cb: (x: number) => void): Promise<void> {
  const r = ns.run(cfg.get("a")).then(() => inner());
  if (ok) { go(`t ${tpl(1)} u`); }
  return new App(cfg).start();
}
interface Config { name: string; get(k: string): string }
export type Id = string | { a: number };
export abstract class App<T> extends Base<T> implements Op, Runnable {
  private x = 1;
  /** Start the app. */
  async start(now?: Date): Promise<void> { await this.boot(now); }
  handler = async (e: Event): Promise<void> => { this.log(e); };
}
export const arrow = (a, b = {}) => a.map(f(b));
const notfn = 5, fn2 = function (z) { return z(); };
if (cond) { function inblock() { q(); } }
'''
GO = '''package svc
import (
  "fmt"
  alias "a/b"
)
// Service does things.
// More.
type Service struct { db *DB; n int }
type Runner interface {
  Run(ctx context.Context) error
  Stop()
}
// New makes one.
func New(db *DB) (*Service, error) {
  go func() { work(1) }()
  return &Service{db: db}, fmt.Errorf("x %d", len(db.items))
}
func (s *Service) Run(ctx context.Context) error { defer s.db.Close(); return nil }
'''


def names(out):
    return [(s.qualified_name, s.kind, s.signature) for s in out.symbols]


def test_python():
    out = python.extract("src/service.py", PY)
    assert names(out) == [
        ("src.service.process", "function", 'def process(item_id: int, b="(") -> str'), ("src.service.ItemService", "class", "class ItemService(Base, m.Other)"), ("src.service.ItemService.Nested", "class", "class Nested"),
        ("src.service.ItemService.Nested.deep", "method", "def deep(self)"), ("src.service.ItemService.rename", "method", "def rename(self)"),
    ]
    first = out.symbols[0]
    assert (first.docstring, first.returns, first.line, first.end_line) == ("Process one item.", "str", 5, 10) and first.body.startswith('"""Process') and out.symbols[1].bases == ["Base", "m.Other"]
    assert out.imports == [("os", []), (".plans", ["X"]), (".", ["helper"]), ("late", [])]
    assert [c for _, c, _ in out.calls] == ["self.go(helper(1)).done", "self.go", "helper", "f", "self.x", "cls.y", "q"]


def test_package_and_unicode_names():
    assert python.extract("src/pkg/__init__.py", "def f(): pass").symbols[0].qualified_name == "src.pkg.f"
    out = python.extract("src/工具.py", 'def 打印消息(文本):\n    """打印文本"""\n    输出(文本)\n')
    assert (out.symbols[0].qualified_name, out.symbols[0].docstring, out.calls[0][1]) == ("src.工具.打印消息", "打印文本", "输出")


def test_script():
    out = script.extract("src/app.ts", TS)
    assert names(out) == [
        ("src/app.bootstrap", "function", "function bootstrap(cfg: Config, cb: (x: number) => void): Promise<void>"), ("src/app.Config", "interface", "interface Config"), ("src/app.Id", "type_alias", "type Id"),
        ("src/app.App", "class", "class App extends Base<T> implements Op, Runnable"), ("src/app.App.start", "method", "start(now?: Date)"), ("src/app.App.handler", "method", "handler(e: Event)"),
        ("src/app.arrow", "function", "function arrow(a, b = {})"), ("src/app.fn2", "function", "function fn2(z)"), ("src/app.inblock", "function", "function inblock()"),
    ]
    docs = {s.name: s.docstring for s in out.symbols}
    assert docs["bootstrap"] == "Entry point." and docs["start"] == "Start the app."
    assert out.imports == [("./helper", ["def", "b", "c"]), ("../x", ["ns"]), ("./side", [])]
    assert {c for a, c, _ in out.calls if a == "src/app.bootstrap"} == {"ns.run", "cfg.get", 'ns.run(cfg.get("a")).then', "go", "tpl"}
    assert {c for a, c, _ in out.calls if a != "src/app.bootstrap"} == {"this.boot", "this.log", "a.map", "f", "z", "q"}


def test_go():
    out = golang.extract("pkg/svc.go", GO)
    assert [(s.qualified_name, s.kind) for s in out.symbols] == [("svc.Service", "class"), ("svc.Runner", "interface"), ("svc.New", "function"), ("svc.Service.Run", "method")]
    assert out.symbols[1].bases == ["Run", "Stop"] and out.symbols[0].docstring == "Service does things. More." and out.symbols[2].signature == "func New(db *DB) (*Service, error)"
    assert out.imports == [("fmt", []), ("a/b", [])] and [c for _, c, _ in out.calls] == ["work", "fmt.Errorf", "len", "s.db.Close"]


@pytest.mark.parametrize(("path", "source"), [("a.py", b"def (:"), ("a.py", b"\xff\xfe"), ("a.ts", b"class { ( [ `${"), ("a.go", b"func ( type ("), ("a.js", b"/* never closed"), ("a.py", b""), ("a.go", b"func"), ("a.ts", b"import {")])
def test_broken_sources_give_a_row(path, source):
    row = extract.record(path, source)
    assert row["path"] == path and (row["error"] is None or not row["symbols"])


def test_long_bodies_are_cut_between_characters():
    out = python.extract("a.py", "def f():\n    x = '" + "é" * 40000 + "'\n")
    assert len(out.symbols[0].body.encode()) <= 65536 and out.symbols[0].body.endswith("é")


def test_walk(tmp_path):
    for p in ("src/a.py", "src/__init__.py", "src/b.TS", "src/c.txt", "node_modules/x.js", ".venv/y.py", "gen/out.py", "gen/keep.py", "logs/a.log.py", "deep/logs/b.py", "yarn.lock", "x.go"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("")
    assert source_files(tmp_path) == ["deep/logs/b.py", "gen/keep.py", "gen/out.py", "logs/a.log.py", "src/__init__.py", "src/a.py", "src/b.TS", "x.go"]
    (tmp_path / ".gitignore").write_text("# note\n\n/gen/*\n!/gen/keep.py\nlogs/\n*.go\n")
    assert source_files(tmp_path) == ["gen/keep.py", "src/__init__.py", "src/a.py", "src/b.TS"]
    with pytest.raises(NotADirectoryError):
        source_files(tmp_path / "none")


@pytest.mark.parametrize(("lines", "path", "out"), [
    (["*.py"], "a/b.py", True), (["/a"], "a/b.py", True), (["/a"], "c/a/b.py", False), (["a/**/z.py"], "a/b/c/z.py", True), (["a/**/z.py"], "a/z.py", True), (["a/"], "a", False), (["a/"], "x/a/b.py", True),
    (["*", "!keep.py"], "keep.py", False), (["a/", "!a/keep.py"], "a/keep.py", True), (["[ab].py"], "b.py", True), (["[!ab].py"], "b.py", False), ([r"\#x.py"], "#x.py", True), (["a?.py"], "a/.py", False), (["**/d"], "q/w/d", True), (["d/**"], "d/e/f", True),
])
def test_ignore_rules(lines, path, out):
    assert IgnoreRules(lines).ignores(path) is out


def test_tables_from_a_tree(spark, tmp_path):
    for p, s in {"src/service.py": PY, "src/app.ts": TS, "svc.go": GO, "bad.py": "def (:"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        Path(tmp_path / p).write_text(s)
    got = extract.extract_paths(spark, str(tmp_path), source_files(tmp_path)).cache()
    assert {r.path for r in got.where("error is not null").collect()} == {"bad.py"}
    symbols = {r.qualified_name: r for r in extract.symbols_table(got).collect()}
    assert symbols["src.service.process"].description == "Process one item." and symbols["src/app.arrow"].description == "Function arrow defined at line 18."
    assert symbols["svc.New"].description == "New makes one." and symbols["src.service.process"].role == "module"
    assert extract.imports_table(got).count() == 9 and extract.calls_table(got).count() == 22
    contents = spark.createDataFrame([(p, bytearray(Path(tmp_path / p).read_bytes())) for p in ("src/service.py", "svc.go")] + [("notes.txt", bytearray(b""))], "path string, content binary")
    assert {r.path for r in extract.extract_contents(contents).collect()} == {"src/service.py", "svc.go"}
    got.unpersist()


def test_sources_of_one_split_are_parsed_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from loomdex.sources import extract

    one = spark.range(0, 400, 1, 1).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit(b"def f():\n    return g()\n").alias("content"))
    got = extract.extract_contents(one)
    assert got.count() == 400 and got.where("size(symbols) = 1 and size(calls) = 1").count() == 400
    assert got.rdd.glom().filter(len).count() > 8


def test_queries_on_sources_parse_once(spark, tmp_path, monkeypatch):
    from loomdex import catalogue
    from loomdex.sources import extract
    from tests.test_catalogue import FOLDER

    for query in ("extract_edges", "scanned_calls"):
        plan = catalogue.QUERIES[query](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan  # it was staged before


def test_queries_on_sources_send_no_table_whole(spark):
    """The planner takes what is parsed for as small as the Parquet that its sources come from."""
    from loomdex import catalogue
    from tests.test_catalogue import FOLDER

    for query in ("extract_edges", "scanned_calls"):
        plan = catalogue.QUERIES[query](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_joins_hint_alters_no_answer(spark):
    from loomdex.operators import resolve

    symbols = spark.createDataFrame([("p/a.py", "p.a.C.f", "f"), ("p/a.py", "p.a.g", "g"), ("p/b.py", "p.b.g", "g"), ("q.py", "q.only", "only")], "file string, qualified_name string, name string")
    refs = spark.createDataFrame([("p/a.py", "p/b.py", "b", 1)], "src_file string, dst_file string, symbol string, count long")
    raw = spark.createDataFrame([("p.a.C.f", c) for c in ("self.f", "self.none", "b.g", "b.none", "x.g", "g", "only", "p.b.g", "none")] + [("p.a.g", "g"), ("p.a.C.h", "g"), ("q.only", "only")], "src_qname string, callee_raw string")
    plain, merged, itself = ({tuple(r): r.dst_qname for r in resolve.resolve_calls(raw, symbols, refs, *x).collect()} for x in ((), ("merge",), ("merge", True)))
    assert plain == merged and {k[1]: v for k, v in plain.items() if k[0] == "p.a.C.f"} == {"self.f": None, "self.none": None, "b.g": "p.b.g", "b.none": None, "x.g": "p.a.g", "g": "p.a.g", "only": "q.only", "p.b.g": None, "none": None}
    assert {k[:2]: v for k, v in itself.items() if k not in plain} == {("p.a.C.f", "self.f"): "p.a.C.f", ("p.a.g", "g"): "p.a.g", ("q.only", "only"): "q.only"}
