"""An index of a source tree: scan, incremental update, questions, context working set, checks.

A warehouse is a folder: ``tables/<name>/<version>`` are Parquet folders that are never changed once written, ``changes/run_id=<n>`` the append-only
log, and ``meta.json`` says which version of each table counts; it is replaced in one step, so a reader sees one state or the next. Tables with a
key of files or symbols are cut into buckets by its hash (``bucket=<b>`` below a version), and ``meta.json`` names a version for each bucket: an
update writes the buckets that it touches and keeps the others where they are.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions import text
from loomdex.operators import changes, graph, postings, quality, render, resolve, search, working_set
from loomdex.plans import impact, records, upkeep
from loomdex.runtime import checkpoint
from loomdex.schema import BUCKETED, SORTED, TABLES
from loomdex.sources import extract, walk


class IndexMissing(RuntimeError):
    """There is no index yet: scan first."""


#: Files that a bucket is made for, and the bounds of their number, which a scan sets.
BUCKET_FILES, LEAST_BUCKETS, MOST_BUCKETS = 2_000, 1, 4_096
#: How many names an ambiguous one is said to stand for; the error says if there are more.
CANDIDATES = 50


class AmbiguousSymbol(LookupError):
    def __init__(self, name: str, candidates: list[str], truncated: bool = False):
        super().__init__(f"{name} may be any of {', '.join(candidates)}{' and others' if truncated else ''}")
        self.candidates, self.truncated = candidates, truncated


class LeaseHeld(RuntimeError):
    """Another owner works on this scope."""


@dataclass
class Outcome:
    """What a scan or an update did."""

    version: int
    files: int = 0
    changed: int = 0
    deleted: int = 0
    changes: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)
    rate: float = 1.0
    full: bool = False


def utc() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Index:
    """The index of one source tree."""

    def __init__(self, spark: SparkSession, root: str | Path, warehouse: str | Path | None = None, lang: str = "en"):
        self.spark, self.root, self.lang = spark, str(Path(root).resolve()), lang
        self.home = Path(warehouse or Path(self.root) / ".loomdex")

    # ---------------------------------------------------------------- state

    @property
    def meta(self) -> dict[str, Any]:
        try:
            return json.loads((self.home / "meta.json").read_text("utf-8"))
        except OSError:
            return {"version": 0, "tables": {}, "evict_count": 0, "budget": {"total": working_set.TOTAL, "working_set": working_set.RESIDENT, "max_pages": working_set.PAGES}}

    def _save(self, meta: dict[str, Any]) -> None:
        self.home.mkdir(parents=True, exist_ok=True)
        meta["before"] = self.meta["tables"]  # readers of the state before may still be at work
        (self.home / ".gitignore").write_text("*\n", encoding="utf-8")
        with tempfile.NamedTemporaryFile("w", dir=self.home, delete=False, encoding="utf-8") as f:
            json.dump(meta, f, indent=1, sort_keys=True)
        os.replace(f.name, self.home / "meta.json")

    def require(self) -> None:
        if "files" not in self.meta["tables"]:
            raise IndexMissing(f"no index in {self.home}; scan {self.root} first")

    def _schema(self, name: str) -> T.StructType:
        return T._parse_datatype_string(TABLES[name])

    def table(self, name: str) -> DataFrame:
        """A table's current state; columns that an older version lacks are null."""
        if name == "changes":
            folder = self.home / "changes"
            return self.spark.read.schema(self._schema("changes")).parquet(str(folder)) if folder.exists() else self.spark.createDataFrame([], self._schema("changes"))
        return self._at(self.meta, name)

    def _paths(self, tables: dict[str, Any], name: str, buckets: set[int] | None = None) -> list[str]:
        """The folders of a table, or of some of its buckets, below the warehouse."""
        at = tables.get(name) or {}
        if isinstance(at, str):
            return [at]
        return [f"tables/{name}/{version}/bucket={b}" for b, version in sorted(at.items()) if buckets is None or int(b) in buckets]

    def _at(self, meta: dict[str, Any], name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or some buckets of it, as of ``meta``."""
        paths = [str(self.home / p) for p in self._paths(meta["tables"], name, buckets)]
        return self.spark.read.schema(self._schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(name))

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in self._schema(name).fields])

    def _bucket(self, meta: dict[str, Any], key: str):
        return F.pmod(F.xxhash64(key), F.lit(meta["buckets"])).cast("int")

    def _write(self, meta: dict[str, Any], **frames: DataFrame) -> None:
        """Write new versions of whole tables, in folders that nothing reads yet; none counts before ``_save``."""
        for name, df in frames.items():
            if name in BUCKETED:
                self._replace(meta, name, df, None)
                continue
            meta["step"] = meta.get("step", 0) + 1
            path = f"tables/{name}/{meta['step']:08d}"
            shutil.rmtree(self.home / path, ignore_errors=True)
            self._shaped(name, df).write.parquet(str(self.home / path))
            meta["tables"][name] = path

    def _replace(self, meta: dict[str, Any], name: str, df: DataFrame, buckets: set[int] | None) -> None:
        """Write new versions of some buckets of a table, or of all; ``df`` has their rows only."""
        meta["step"] = meta.get("step", 0) + 1
        version = f"{meta['step']:08d}"
        folder = self.home / "tables" / name / version
        shutil.rmtree(folder, ignore_errors=True)
        rows = self._shaped(name, df).withColumn("bucket", self._bucket(meta, BUCKETED[name])).repartition("bucket")
        rows.sortWithinPartitions("bucket", SORTED.get(name, BUCKETED[name])).write.partitionBy("bucket").parquet(str(folder))
        old = meta["tables"].get(name)
        kept = {b: v for b, v in old.items() if int(b) not in buckets} if buckets is not None and isinstance(old, dict) else {}
        meta["tables"][name] = kept | {p.name.split("=")[1]: version for p in folder.glob("bucket=*")}

    def _buckets(self, meta: dict[str, Any], keys: DataFrame, key: str) -> set[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return {r.b for r in keys.select(self._bucket(meta, key).alias("b")).distinct().collect()}

    def _sweep(self, meta: dict[str, Any]) -> None:
        """Remove what neither this state nor the one before it reads."""
        for name in meta["tables"]:
            read = {self.home / p for tables in (meta["tables"], meta.get("before", {})) for p in self._paths(tables, name)}
            for version in [p for p in (self.home / "tables" / name).iterdir() if p.is_dir()]:
                if version in read:
                    continue
                for bucket in version.glob("bucket=*"):
                    if bucket not in read:
                        shutil.rmtree(bucket, ignore_errors=True)
                if not any(version.glob("bucket=*")):
                    shutil.rmtree(version, ignore_errors=True)

    # ---------------------------------------------------------------- scan and update

    def _finish(self, meta: dict[str, Any], version: int, out: Outcome) -> Outcome:
        """Counters from the tables just written; then the new state counts."""
        out.rate = resolve.resolution_rate(self._at(meta, "resolved")).first().rate
        out.files = self._at(meta, "files").count()
        meta |= {"version": version, "rate": out.rate, "lang": self.lang}
        self._save(meta)
        shutil.rmtree(self.home / "staging", ignore_errors=True)
        self._sweep(meta)
        return out

    def _park(self, df: DataFrame, name: str) -> DataFrame:
        """Rows that several steps of one run read, written once."""
        path = str(self.home / "staging" / name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _derive(self, meta: dict[str, Any]) -> None:
        """References and calls from the tables just written, all of them."""
        self._write(meta, refs=resolve.import_edges(self._at(meta, "imports"), self._at(meta, "files")))
        self._write(meta, resolved=resolve.resolve_calls(self._at(meta, "raw_calls"), self._at(meta, "symbols"), self._at(meta, "refs")))
        self._write(meta, call_edges=resolve.call_edges(self._at(meta, "resolved")))

    def _derive_changed(self, old: dict[str, Any], meta: dict[str, Any], touched: DataFrame) -> None:
        """References and calls that a change of the touched files alters, in the buckets that hold them; ``old`` is the state before."""
        was, refs = self._at(old, "refs"), self._park(resolve.import_edges(self._at(meta, "imports"), self._at(meta, "files")), "refs")
        moved = was.subtract(refs).union(refs.subtract(was)).select("src_file").distinct()
        if buckets := self._buckets(meta, moved, "src_file"):
            self._replace(meta, "refs", refs.where(self._bucket(meta, "src_file").isin(buckets)), buckets)
        symbols = self._at(meta, "symbols")
        keys = self._park(resolve.altered(resolve.States(touched, symbols, refs, self._at(old, "symbols"), was)), "keys")
        before = self._park(resolve.marked(self._at(old, "resolved"), keys).where("again").select("file", "src_qname"), "before")
        again = self._park(resolve.marked(self._at(meta, "raw_calls"), keys).where("again").drop("again"), "again")
        done = self._park(self._shaped("resolved", resolve.resolve_some(again, symbols, refs)), "done")
        buckets = self._buckets(meta, before.select("file").union(done.select("file")), "file")
        if not buckets:
            return
        kept = resolve.marked(self._at(old, "resolved", buckets), keys).where("not again").drop("again")
        self._replace(meta, "resolved", kept.unionByName(done), buckets)
        callers = self._park(before.select("src_qname").union(done.select("src_qname")).distinct(), "callers")
        buckets = self._buckets(meta, callers, "src_qname")
        edges = resolve.call_edges(self._at(meta, "resolved").join(callers, "src_qname", "left_semi"))
        self._replace(meta, "call_edges", self._at(old, "call_edges", buckets).join(callers, "src_qname", "left_anti").unionByName(edges), buckets)

    def _stage(self, extracted: DataFrame, version: int) -> DataFrame:
        """Extracted rows, written once: parsing is the dear part and several tables come from it."""
        path = self.home / f"staging/{version:08d}"
        shutil.rmtree(path, ignore_errors=True)
        extracted.write.parquet(str(path))
        return self.spark.read.schema(extract.SCHEMA).parquet(str(path))

    def _log(self, rows: DataFrame, run: int, ts: datetime) -> int:
        """Append a run's changes, numbered in order of file and place: ranges of files in parallel, so numbers ascend but have gaps."""
        numbered = rows.repartitionByRange("file").sortWithinPartitions("file", "at", "symbol").withColumn("seq", F.monotonically_increasing_id())
        path = self.home / f"changes/run_id={run}"
        columns = [f.name for f in self._schema("changes").fields if f.name != "run_id"]
        numbered.withColumn("ts", F.lit(ts).cast("timestamp")).select(*columns).write.mode("overwrite").parquet(str(path))
        return self.spark.read.parquet(str(path)).count()

    def scan(self) -> Outcome:
        """Index every file anew; each symbol is logged as added, and the working set is cleared."""
        paths, meta = walk.source_files(self.root), self.meta
        version, ts = meta["version"] + 1, utc()
        got = self._stage(extract.extract_paths(self.spark, self.root, paths) if paths else self.spark.createDataFrame([], extract.SCHEMA), version)
        symbols = extract.symbols_table(got, self.lang)
        meta["buckets"] = min(MOST_BUCKETS, max(LEAST_BUCKETS, len(paths) // BUCKET_FILES))
        self._write(meta, files=extract.files_table(got, ts), symbols=symbols, imports=extract.imports_table(got), raw_calls=extract.calls_table(got), working_set=self.table("working_set").limit(0))
        own = self._at(meta, "symbols")
        out = Outcome(version, full=True, errors=[(r.path, r.error) for r in got.where("error is not null").select("path", "error").collect()])
        none = own.limit(0)
        out.changes = self._log(changes.symbol_changes(none, own), version, ts)
        out.changed = len(paths)
        self._write(meta, grams=postings.grams(own), sizes=postings.sizes(own))
        self._derive(meta)
        return self._finish(meta, version, out)

    def update(self) -> Outcome:
        """Index what changed since the last time, log the differences, and resolve again what they can have altered.

        Tables are read and written in the buckets of touched files only; the list of files is compared as a whole.
        """
        old, meta = self.meta, self.meta
        if "sizes" not in meta["tables"] or meta.get("lang", self.lang) != self.lang:
            return self.scan()
        version, ts = meta["version"] + 1, utc()
        stored = self._at(old, "files")
        seen = self.spark.createDataFrame(extract.stamps(self.root, walk.source_files(self.root)), "path string, size long, mtime double")
        acts = changes.file_actions(stored, seen.withColumn("hash", F.lit(None).cast("string")))
        todo = [r.path for r in acts.where("action in ('new', 'changed')").select("path").collect()]
        gone = self._park(acts.where("action = 'deleted'").select("path"), "gone")
        out = Outcome(version, deleted=gone.count())
        if not todo and not out.deleted:
            out.version, out.files, out.rate = meta["version"], stored.count(), meta.get("rate", 1.0)
            return out
        got = self._stage(extract.extract_paths(self.spark, self.root, todo) if todo else self.spark.createDataFrame([], extract.SCHEMA), version)
        fresh = got.join(stored.select("path", F.col("hash").alias("_h")), "path", "left").where("_h is null or _h <> hash").drop("_h")
        out.changed = fresh.count()
        out.errors = [(r.path, r.error) for r in fresh.where("error is not null").select("path", "error").collect()]
        looked, touched = got.select("path").union(gone), self._park(fresh.select("path").union(gone), "touched")
        buckets = self._buckets(meta, looked, "path")
        rest = self._at(old, "files", buckets).join(looked, "path", "left_anti")
        self._replace(meta, "files", rest.unionByName(extract.files_table(got, ts)), buckets)
        buckets, of = self._buckets(meta, touched, "path"), touched.select(F.col("path").alias("file"))
        new = {"symbols": extract.symbols_table(fresh, self.lang), "imports": extract.imports_table(fresh), "raw_calls": extract.calls_table(fresh)}
        diff = changes.symbol_changes(self._at(old, "symbols", buckets).join(of, "file", "left_semi"), new["symbols"])
        out.changes = self._log(changes.pair_renames(diff), version, ts)
        new |= {"grams": postings.grams(new["symbols"]), "sizes": postings.sizes(new["symbols"])}
        if buckets:
            for name, rows in new.items():
                rest = self._at(old, name, buckets).join(of, "file", "left_anti")
                self._replace(meta, name, rest.unionByName(self._shaped(name, rows)), buckets)
            self._derive_changed(old, meta, touched)
        return self._finish(meta, version, out)

    # ---------------------------------------------------------------- questions

    def search(self, query: str, most: int = 20) -> DataFrame:
        """The best symbols for a query: BM25 reads the postings, and the symbols of the buckets that have candidates."""
        self.require()
        meta = self.meta
        if not search.searchable(query) or "sizes" not in meta["tables"]:
            return search.search(self.table("symbols"), query, most)
        files = checkpoint(postings.candidates(self._at(meta, "grams"), search.phrases(query)))
        near = self._at(meta, "symbols", self._buckets(meta, files, "file"))
        near = near.join(files, "file", "left_semi").select(*near.columns)
        return search.ranked(postings.bm25(near, self._at(meta, "sizes"), query), most)

    def history(self, symbol: str, most: int = 200) -> DataFrame:
        """A symbol's changes, under its former names too."""
        self.require()
        log = self.table("changes")
        names = changes.lineage(log, symbol) if "." in symbol else [symbol]
        out = None
        for n in names:
            own = changes.history(log, n, most)
            out = own if out is None else out.unionByName(own)
        return out.distinct().orderBy("ts", "run_id", "seq").limit(most)

    def callers(self, symbol: str) -> DataFrame:
        return graph.neighbours(self.table("call_edges"), symbol).where("direction = 'caller'").select("name").orderBy("name")

    def callees(self, symbol: str) -> DataFrame:
        return graph.neighbours(self.table("call_edges"), symbol).where("direction = 'callee'").select("name").orderBy("name")

    def related(self, path: str) -> DataFrame:
        return graph.related(self.table("refs")).where(F.col("node") == path).select(F.col("other").alias("path")).orderBy("path")

    def plan_context(self, query: str, most: int = 8, tokens: int = 6000) -> dict[str, Any]:
        """Evidence for a request, whether it is stale, and what it suggests; at most ``tokens`` by size as JSON."""
        if "files" not in self.meta["tables"] or not text.query_terms(query):
            return {"status": "bootstrap_required", "error_code": "NO_INDEX" if "files" not in self.meta["tables"] else "EMPTY_QUERY", "query": query, "evidence": [], "suggested_pages": [], "tokens": 0, "truncated": False}
        rows = search.evidence(self.table("symbols"), self.table("call_edges"), query, most).join(self.table("files").select(F.col("path").alias("file"), "hash"), "file", "left").orderBy("evidence_id").collect()
        now = {p: extract.record(p, (Path(self.root) / p).read_bytes())["hash"] if (Path(self.root) / p).is_file() else None for p in {r.file for r in rows}}
        evidence = [r.asDict() | {"stale": now[r.file] is None or now[r.file] != r["hash"]} for r in rows] + self.conventions(query)
        out = {"status": "ok", "query": query, "evidence": evidence, "suggested_pages": [e["qualified_name"] for e in evidence if "qualified_name" in e], "index_version": self.meta["version"], "truncated": False}
        profile = self.spark.range(1).select(text.engineering_profile(F.lit(query)).alias("p")).first().p.asDict()
        out |= {"engineering": profile, "impact_scope": {"files": sorted({e["file"] for e in evidence}), "symbols": sorted(out["suggested_pages"])}}
        size = lambda: max(1, len(json.dumps(out, ensure_ascii=False).encode()) // 4)
        while size() > tokens and len(out["evidence"]) > 1:
            out["evidence"].pop()
            out["truncated"] = True
        return out | {"tokens": size()}

    def conventions(self, query: str, names: tuple[str, ...] = ("AGENTS.md", "CONTRIBUTING.md", "README.md"), most: int = 2) -> list[dict[str, Any]]:
        """The first line of each convention file that has a word of the query."""
        terms, out = [t.casefold() for t in text.query_terms(query)], []
        for name in names:
            with contextlib.suppress(OSError):
                for k, line in enumerate((Path(self.root) / name).read_text("utf-8", "replace").splitlines(), 1):
                    if any(t in line.casefold() for t in terms):
                        out.append({"kind": "convention", "file": name, "line": k, "excerpt": line.strip()[:240], "confidence": 0.55})
                        break
            if len(out) == most:
                break
        return out

    def impact(self, plans: DataFrame, files: list[str] | DataFrame, symbols: list[str] | None, **limits) -> DataFrame:
        """What changed files and symbols touch in the open plans."""
        have = bool("files" in self.meta["tables"])
        loose = records.tasks(plans)
        return impact.impact(plans.where("code is null"), loose, files, symbols, self.table("symbols") if have else None, self.table("call_edges") if have else None, **limits)

    def update_plans(self, folder: str, run: int | None = None) -> dict[str, Any]:
        """After an update: what it touches in the open plans and which evidence it made stale, as reports; batches are marked where the project allows it."""
        log = self.table("changes").where(F.col("run_id") == (run or self.meta["version"]))
        touched = log.select(F.lit("file").alias("kind"), F.col("file").alias("ref")).union(log.select(F.lit("symbol"), "symbol")).where("ref is not null").distinct()
        plans, files = records.read(self.spark, folder), self.table("files")
        out = self.home / "plans"
        index, edges = (self.table(n) if "files" in self.meta["tables"] else None for n in ("symbols", "call_edges"))
        found = impact.everything(plans.where("code is null"), records.tasks(plans), touched, None, index, edges)
        reports = [upkeep.write_report(checkpoint(found.rows), out / "impact-report.json", ["plan_id", *impact.ORDER], cut=found.cut)]
        stale = upkeep.stale_evidence(self.spark, folder, files)
        reports.append(upkeep.write_report(stale, out / "stale-report.json", ["plan_id", "batch", "gate"]))
        allowed = upkeep.config(self.root)["allow_update_plan_state"]
        marks = upkeep.mark_stale(folder, stale.collect()) if allowed else {"marked": [], "skipped": []}
        return marks | {"allow_update_plan_state": allowed, "reports": [r.as_posix() for r in reports]}

    def doctor(self, history: str | Path | None = None) -> DataFrame:
        """Problems of the index; none if all is well. ``history`` is the folder of history documents, where these are kept."""
        self.require()
        disk = self.spark.createDataFrame([(p,) for p in walk.source_files(self.root)], "path string")
        t = self.tables()
        raw = t["raw_calls"].count()
        rate = self.spark.createDataFrame([(raw, float(self.meta.get("rate", 1.0)))], "total long, rate double")
        kept = None if history is None else self.spark.createDataFrame([(f.name,) for f in Path(history).glob("*.md")], "name string")
        return quality.doctor(t, disk, rate, self.meta["budget"]["working_set"], kept)

    # ---------------------------------------------------------------- documents

    def overview(self, most: int | None = None) -> str:
        self.require()
        return render.overview(self.tables(), most)

    def details(self) -> DataFrame:
        self.require()
        return render.details(self.table("symbols"), self.table("files"))

    def history_document(self) -> str:
        return render.history(self.table("changes"), lang=self.lang)

    # ---------------------------------------------------------------- working set

    @contextlib.contextmanager
    def lease(self, session: str = "", plan: str = "", batch: str = "", owner: str = "local", seconds: int = 30):
        """Hold a scope for an owner: the same owner renews, an expired lease is taken over, only its owner gives it back."""
        key = json.dumps([session, plan, batch], separators=(",", ":"))
        folder = self.home / "leases"
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / (lease_name(key) + ".json")
        mine = json.dumps({"owner": owner, "expires": (utc() + timedelta(seconds=seconds)).isoformat(timespec="milliseconds")})
        try:
            with path.open("x", encoding="utf-8") as f:
                f.write(mine)
        except FileExistsError:
            held = json.loads(path.read_text("utf-8") or "{}")
            if held.get("owner") != owner and held.get("expires", "") > utc().isoformat(timespec="milliseconds"):
                raise LeaseHeld(f"{held.get('owner')} holds {key}") from None
            path.write_text(mine, encoding="utf-8")
        try:
            yield
        finally:
            with contextlib.suppress(OSError, ValueError):
                if json.loads(path.read_text("utf-8")).get("owner") == owner:
                    path.unlink()

    def resolve_page(self, name: str) -> tuple[str, str]:
        """page id and its file: a file of the index, an exact qualified name, or the only symbol of a bare name."""
        self.require()
        if "/" in name or Path(name).suffix in text.LANGUAGES:
            if self.table("files").where(F.col("path") == name).count():
                return name, name
            raise LookupError(f"no file {name}")
        symbols = self.table("symbols")
        exact = symbols.where(F.col("qualified_name") == name).select("file").first()
        if exact:
            return name, exact.file
        found = symbols.where(F.col("name") == name).select("qualified_name", "file").distinct().orderBy("qualified_name").limit(CANDIDATES + 1).collect()
        if len(found) == 1:
            return found[0].qualified_name, found[0].file
        if found:
            raise AmbiguousSymbol(name, [r.qualified_name for r in found[:CANDIDATES]], len(found) > CANDIDATES)
        raise LookupError(f"no symbol {name}")

    def page(self, name: str, with_source: bool = False) -> dict[str, Any]:
        """A page: what a symbol or a file is, who calls it and whom it calls, related files, and an excerpt of its source."""
        page, file = self.resolve_page(name)
        row = self.table("files").where(F.col("path") == file).first()
        out: dict[str, Any] = {"page_id": page, "file": file, "version": row.hash, "related_files": [r.path for r in self.related(file).collect()], "granularity": "file" if page == file else "function"}
        if page == file:
            own = self.table("symbols").where(F.col("file") == file).orderBy("line", "qualified_name").collect()
            out |= {"line": 1, "end_line": max([1, *(s.end_line for s in own)]), "signature": file, "summary": f"{len(own)} symbols, role: {row.role}", "symbols": [(s.qualified_name, s.line, s.end_line, s.signature) for s in own], "callers": [], "callees": []}
        else:
            s = self.table("symbols").where((F.col("qualified_name") == page) & (F.col("file") == file)).first()
            out |= {"line": s.line, "end_line": s.end_line, "signature": s.signature, "summary": s.description, "symbols": [], "callers": [r.name for r in self.callers(page).collect()], "callees": [r.name for r in self.callees(page).collect()]}
            if with_source:
                lines = (Path(self.root) / file).read_text("utf-8", "replace").splitlines()[s.line - 1 : s.end_line]
                source = self.spark.createDataFrame([(page, "\n".join(lines))], "page_id string, source string")
                out["source"] = working_set.excerpt(source).first().excerpt
        return out

    @staticmethod
    def render_page(p: dict[str, Any]) -> str:
        lines = [f"### {p['page_id']}", "", f"`{p['signature']}`", "", f"{p['file']}:{p['line']}-{p['end_line']}", "", p["summary"] or ""]
        for name in ("callers", "callees", "related_files"):
            if p[name]:
                lines += ["", f"{name.replace('_', ' ')}: " + ", ".join(f"`{x}`" for x in p[name])]
        if p["symbols"]:
            lines += ["", "| symbol | lines | signature |", "|---|---|---|", *[f"| `{q}` | {a}-{b} | `{s}` |" for q, a, b, s in p["symbols"]]]
        return "\n".join(lines + (["", "```", p["source"], "```"] if p.get("source") else [])) + "\n"

    def _entry(self, p: dict[str, Any], scope: tuple[str, str, str], pinned: bool, origin: str, now: datetime) -> tuple:
        cost = text.PAGE_OVERHEAD if p["granularity"] == "file" else estimate(self.render_page(p)) + text.PAGE_OVERHEAD
        return (p["page_id"], *scope, now, now, pinned, cost, origin)

    def context_load(self, name: str, session: str = "", plan: str = "", batch: str = "", pin: bool = False, with_source: bool = False, prefetch: bool = True, now: datetime | None = None) -> dict[str, Any]:
        """Load a page into a scope: it comes first in memory, neighbours follow, and what is coldest goes where the budget is full."""
        scope, now = (session, plan, batch), now or utc()
        with self.lease(*scope):
            p, meta = self.page(name, with_source), self.meta
            entries, loads = [self._entry(p, scope, pin, "load", now)], [(p["page_id"], p["file"], p["version"], p["granularity"], now, meta["version"])]
            names: list[str] = []
            if prefetch and p["granularity"] == "function":
                near = graph.prefetch_order(p["page_id"], self.table("symbols"), self.table("call_edges"), self.table("refs"))
                resident = {r.page_id for r in working_set.in_scope(self.table("working_set"), *scope).select("page_id").collect()}
                for r in near.collect():
                    if r.page not in resident:
                        with contextlib.suppress(LookupError):
                            q = self.page(r.page)
                            entries.append(self._entry(q, scope, False, "prefetch", now))
                            loads.append((q["page_id"], q["file"], q["version"], q["granularity"], now, meta["version"]))
                            names.append(r.page)
            meta["anchor"] = {"file": p["file"], "line": p["line"]}
            ws = working_set.touch(self.table("working_set"), self.spark.createDataFrame(entries, self._schema("working_set")))
            schema = "page_id string, file string, version string, granularity string, loaded_at timestamp, index_version long"
            pages = working_set.load(self.table("pages"), self.spark.createDataFrame(loads, schema))
            self._write(meta, working_set=ws, pages=pages)
            gone = [r for r in self._enforce(meta, scope, now) if r != p["page_id"]]
            if gone:
                self._write(meta, working_set=self._at(meta, "working_set").where(~self._is(scope, gone)))
                meta["evict_count"] += len(gone)
            self._save(meta)
            self._sweep(meta)
            return {"page": p, "rendered": self.render_page(p), "prefetched": names, "evicted": gone, "many_evicted": len(gone) > 0.4 * meta["budget"]["max_pages"]}

    @staticmethod
    def _is(scope: tuple[str, str, str], pages: list[str]):
        test = F.col("page_id").isin(pages)
        for k, v in zip(working_set.SCOPE, scope, strict=True):
            test = test & (F.col(k) == v)
        return test

    def _scored(self, meta: dict[str, Any], scope: tuple[str, str, str], now: datetime) -> DataFrame:
        """Entries of a scope with their eviction score against the anchor; pages that are gone have none left."""
        ws = working_set.in_scope(self._at(meta, "working_set") if meta["tables"].get("working_set") else self.table("working_set"), *scope)
        own = self.table("symbols").groupBy(F.col("qualified_name").alias("page_id")).agg(F.min("file").alias("s_file"), F.min("line").alias("s_line"))
        linked = graph.related(self.table("refs")).select(F.col("node").alias("p_file"), F.lit(True).alias("linked")).distinct()
        is_file = text.is_file_page(F.col("page_id"))
        ws = ws.join(own, "page_id", "left").withColumn("p_file", F.when(is_file, F.col("page_id")).otherwise(F.col("s_file"))).join(linked, "p_file", "left")
        anchor = meta.get("anchor") or {"file": None, "line": None}
        near = text.locality(F.lit(anchor["file"]).cast("string"), F.lit(anchor["line"]).cast("int"), F.col("p_file"), F.coalesce("s_line", F.lit(1)), F.when(is_file, "file").otherwise("function"), F.coalesce("linked", F.lit(False)))
        score = F.when(F.col("p_file").isNull(), 0.0).otherwise(text.eviction_score(text.recency(F.col("last_access_at"), F.lit(now).cast("timestamp")), near, F.col("origin")))
        return ws.withColumn("score", score)

    def _enforce(self, meta: dict[str, Any], scope: tuple[str, str, str], now: datetime) -> list[str]:
        b = meta["budget"]
        return [r.page_id for r in working_set.enforce(self._scored(meta, scope, now), b["working_set"], b["max_pages"]).collect()]

    def context_evict(self, page: str | None = None, need: int | None = None, session: str = "", plan: str = "", batch: str = "", everything: bool = False, force: bool = False, now: datetime | None = None) -> dict[str, Any]:
        """Evict one page, all that are not pinned, or the coldest until ``need`` tokens are free; ``force`` takes pinned pages too."""
        scope = (session, plan, batch)
        with self.lease(*scope):
            meta = self.meta
            own = working_set.in_scope(self.table("working_set"), *scope)
            if page is not None:
                row = own.where(F.col("page_id") == page).first()
                if row is None:
                    raise LookupError(f"{page} is not loaded")
                if row.pinned and not force:
                    raise ValueError(f"{page} is pinned")
                gone, freed = [page], row.tokens
            else:
                loose = self._scored(meta, scope, now or utc()).withColumn("pinned", F.col("pinned") & F.lit(not force))
                rows = (loose.where("not pinned") if everything else working_set.evictions(loose, F.lit(need or 0))).select("page_id", "tokens").collect()
                gone, freed = [r.page_id for r in rows], sum(r.tokens for r in rows)
                meta["evict_count"] += len(gone)
            if gone:
                self._write(meta, working_set=self.table("working_set").where(~self._is(scope, gone)))
            self._save(meta)
            return {"evicted": sorted(gone), "freed": freed, "unsatisfied": max(0, (need or 0) - freed)}

    def context_pin(self, page: str, pinned: bool = True, session: str = "", plan: str = "", batch: str = "") -> None:
        meta, scope = self.meta, (session, plan, batch)
        with self.lease(*scope):
            meta, ws = self.meta, self.table("working_set")
            if not ws.where(self._is(scope, [page])).count():
                raise LookupError(f"{page} is not loaded")
            self._write(meta, working_set=ws.withColumn("pinned", F.when(self._is(scope, [page]), F.lit(pinned)).otherwise(F.col("pinned"))))
            self._save(meta)

    def context_budget(self, **values: int) -> dict[str, int]:
        """Read the budget, or set any of total, working_set, max_pages."""
        meta = self.meta
        for k, v in values.items():
            if k not in meta["budget"] or v <= 0:
                raise ValueError(f"no such budget: {k}={v}")
            meta["budget"][k] = v
        if values:
            self._save(meta)
        return meta["budget"]

    def context_status(self, session: str = "", plan: str = "", batch: str = "") -> DataFrame:
        """Entries of a scope as fresh, stale or gone."""
        own = working_set.in_scope(self.table("working_set"), session, plan, batch)
        return working_set.status(own, self.table("symbols"), self.table("files"), self.table("pages")).orderBy(F.desc("last_access_at"), "page_id")

    def context_render(self, most: int | None = None) -> str:
        """The latest pages of all scopes, as many as the total budget holds."""
        ws = self.table("working_set").withColumn("one", F.lit(1))
        rows = working_set.rendered(ws, F.lit(most or self.meta["budget"]["total"]), ["one"]).orderBy(F.desc("last_access_at"), "page_id").select("page_id").collect()
        out = []
        for r in rows:
            with contextlib.suppress(LookupError):
                out.append(self.render_page(self.page(r.page_id)))
        return "\n".join(out)


def estimate(s: str) -> int:
    """The token estimate of one string, on the driver."""
    cjk = sum("一" <= c <= "鿿" or "㐀" <= c <= "䶿" for c in s)
    return cjk + -(-(len(s) - cjk) // 3)


def lease_name(s: str) -> str:
    import hashlib

    return hashlib.sha256(s.encode()).hexdigest()[:24]
