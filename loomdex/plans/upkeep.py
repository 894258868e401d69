"""What an update does for plans: fingerprints of batches' inputs, evidence that no longer holds, marks and reports, and the test contracts."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.udf import canonical_json
from loomdex.operators import graph
from loomdex.plans import evidence, lint, records, workflow
from loomdex.plans.records import Plan, PlanError

CONFIG = "loomdex.config.json"
ACTIVE = ("draft", "approved", "executing", "blocked")


def config(root: str | Path) -> dict[str, bool]:
    """Whether updates may change plans' state: the project's say, yes where it has none; anything but true or false is an error."""
    path = Path(root) / CONFIG
    if not path.is_file():
        return {"allow_update_plan_state": True}
    try:
        data = json.loads(path.read_text("utf-8"))
        allowed = data.get("allow_update_plan_state", True)
    except (OSError, ValueError, AttributeError) as e:
        raise PlanError("PLAN_CONFIG_INVALID", f"{CONFIG} is no JSON object: {e}", path=path.as_posix()) from e
    if not isinstance(allowed, bool):
        raise PlanError("PLAN_CONFIG_INVALID", "expected true or false", "allow_update_plan_state", path.as_posix())
    return {"allow_update_plan_state": allowed}


def current_fingerprints(plans: DataFrame, files: DataFrame) -> DataFrame:
    """plan_id, batch, current: the fingerprint of the files that each batch's tasks name."""
    inputs = records.tasks(plans).select("plan_id", "batch", F.explode("files").alias("path"))
    return evidence.fingerprints(inputs, files, ["plan_id", "batch"])


def stale_evidence(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """plan_id, batch, gate, input_fingerprint, current of gates that passed with other inputs, in plans that are not over."""
    if not list(Path(folder).glob(".state/*/*.jsonl")):
        return spark.createDataFrame([], "plan_id string, batch string, gate string, input_fingerprint string, current string")
    plans = records.read(spark, folder)
    active = plans.where(F.col("status").isin(*ACTIVE)).select("plan_id")
    results = workflow.events(spark, folder).where("kind = 'gate'").select("plan_id", "batch", "gate", "outcome", "input_fingerprint", "seq").join(active, "plan_id", "left_semi")
    found = evidence.stale(results, current_fingerprints(plans, files), ["plan_id", "batch", "gate"], ["plan_id", "batch"])
    return found.where("input_fingerprint <> ''").select("plan_id", "batch", "gate", "input_fingerprint", "current")


def mark_stale(folder: str | Path, items: list) -> dict[str, list[dict[str, Any]]]:
    """Mark the passed batches of stale evidence; what can't be marked is listed with the code of its reason."""
    groups: dict[tuple[str, str], list[str]] = {}
    for r in items:
        groups.setdefault((r["plan_id"], r["batch"]), []).append(r["gate"])
    out: dict[str, list[dict[str, Any]]] = {"marked": [], "skipped": []}
    for (plan_id, batch), gates in sorted(groups.items()):
        at = {"plan_id": plan_id, "batch": batch}
        try:
            flow = find(folder, plan_id)
            state = next((b.get("status") for b in flow.plan.batches if b.get("batch") == batch), None)
            code = "PLAN_NOT_ACTIVE" if flow.plan.status not in ACTIVE else "BATCH_NOT_PASSED" if state != "passed" else None
            if code:
                out["skipped"].append(at | {"code": code})
            else:
                out["marked"].append(at | {"gates": sorted(set(gates)), "revision": flow.batch(batch, "stale")})
        except PlanError as e:
            out["skipped"].append(at | {"code": e.code})
    return out


def find(folder: str | Path, plan_id: str) -> workflow.Workflow:
    """The one plan of an id."""
    found = []
    for path in sorted(Path(folder).glob("*.md")):
        flow = workflow.Workflow(path)
        try:
            if flow.plan.id == plan_id:
                found.append(flow)
        except PlanError:
            continue
    if len(found) != 1:
        raise PlanError("PLAN_NOT_FOUND" if not found else "PLAN_ID_DUPLICATE", f"{len(found)} plans have the id {plan_id}")
    return found[0]


def write_report(rows: DataFrame, path: str | Path, order: list[str], most: int = 200, cut: bool = False) -> Path:
    """A bounded report as canonical JSON: at most ``most`` rows in order, how many there are in all, and whether any is missing.

    ``rows`` are all there are, not cut before; ``cut`` says that a search behind them met its bound, so that there may be more.
    """
    items = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(most).collect()]
    total = rows.count()
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    said = {"generated_at": workflow.now(), "items": items, "search_cut": cut, "total": total, "truncated": cut or total > len(items)}
    path.write_text(canonical_json(said) + "\n", encoding="utf-8")
    return path


def latest_snapshot(state: Path) -> tuple[int, Plan] | None:
    """The highest revision that is on file, and its plan."""
    found = sorted(p for p in state.glob("[0-9]*.md") if p.stem.isdigit())
    return (int(found[-1].stem), records.parse(found[-1].read_text("utf-8"), found[-1].as_posix())) if found else None


def resolves(reference: str, root: str | Path) -> bool:
    """Whether a test reference (file, folder or pattern, before ``::``) stands for files within the root, and only such."""
    base, name = Path(root).resolve(), reference.split("::", 1)[0]
    try:
        if any(c in name for c in "*?["):
            hits = list(base.glob(name))
            return bool(hits) and all(h.is_file() and h.resolve().is_relative_to(base) for h in hits)
        full = (base / name).resolve()
        return full.is_relative_to(base) and (any(x.is_file() for x in full.rglob("*")) if full.is_dir() else full.is_file())
    except (OSError, ValueError, NotImplementedError):
        return False


def unmet_contracts(plan: Plan, batch: str, root: str | Path) -> list[str]:
    """Tests that a batch promises to write or to reuse and whose first reference stands for no file."""
    tests = (plan.frontmatter.get("testing") or {}).get("tests") or []
    own = [t for t in tests if isinstance(t, dict) and str(t.get("batch", "")) == batch and t.get("disposition") in ("implement", "reuse")]
    return [str(t.get("test_id")) for t in own if not t.get("files") or not resolves(str(t["files"][0]), root)]


def check(spark: SparkSession, folder: str, files: DataFrame | None = None) -> list[tuple[str, str, str]]:
    """(code, plan, what) of everything wrong with a folder's plans: lint, circles of dependencies, results of gates or batches that there aren't or without a fingerprint,
    projections that are not what their plan says. Sorted; none if all is well.
    """
    plans = records.read(spark, folder)
    found = [(r.code, r.plan_id or r.path, r.field or r.message) for r in lint.lint(plans, files).collect()]
    edges = records.dependencies(plans).select(F.concat_ws("\x1f", "plan_id", "src").alias("src"), F.concat_ws("\x1f", "plan_id", "dst").alias("dst"))
    found += [("DEPENDENCY_CYCLE", *r.node.split("\x1f")) for r in graph.cycle_nodes(edges).collect()]
    for path in sorted(Path(folder).glob("*.md")):
        flow = workflow.Workflow(path)
        try:
            plan = flow.plan
        except PlanError:
            continue
        gates = {g.get("id") for g in (plan.frontmatter.get("engineering") or {}).get("gates") or [] if isinstance(g, dict)}
        batches = {b.get("batch") for b in plan.batches}
        results = [e for e in flow.log() if e["kind"] == "gate"]
        found += [("EVIDENCE_UNBOUND", plan.id, f"{e.get('batch')}/{e.get('gate')}") for e in results if e.get("gate") not in gates or e.get("batch") not in batches or not e.get("input_fingerprint")]
        kept = flow.state / "projection.json"
        if kept.exists() and json.loads(kept.read_text("utf-8")) != json.loads(canonical_json(flow.projection())):
            found.append(("PROJECTION_DRIFT", plan.id, kept.as_posix()))
    return sorted(set(found))
