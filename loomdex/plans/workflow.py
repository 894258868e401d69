"""The plan state machine, on the driver: one document at a time, with numbered snapshots and an append-only event log beside it.

A folder ``<plans>/.state/<plan id>/`` holds ``NNNN.md`` (a snapshot of each revision, never overwritten), ``events.jsonl`` and
``projection.json``. A change is settled by its snapshot, which appears whole; what follows it (plan, event, projection) is noted beforehand and
done by whoever opens the plan next, should the writer be cut off. ``events`` and ``batch_states`` read those logs as DataFrames: the state of every batch is a fold over its events.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.udf import canonical_json, capped
from loomdex.operators.changes import last_per_key
from loomdex.plans.records import Plan, PlanError, parse

# What a batch may become.
TRANSITIONS = {
    "start": ({"pending", "failed", "blocked", "stale"}, "in-progress"), "complete": ({"in-progress", "validating"}, "passed"), "fail": ({"in-progress", "validating"}, "failed"),
    "stale": ({"passed", "in-progress", "validating"}, "stale"), "reopen": ({"passed", "failed", "stale", "skipped"}, "pending"),
}
GATE_OUTPUT, GATE_SECONDS = 20_000, 60
EVENTS = "plan_id string, revision int, seq int, kind string, batch string, gate string, outcome string, input_fingerprint string, detail string, at string"


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")


def content_hash(data: dict[str, Any], body: str) -> str:
    """Digest of what a plan means: its frontmatter without bookkeeping, and its body."""
    kept = {k: v for k, v in data.items() if k not in ("content_hash", "revision", "updated_at", "last_writer", "approval", "status", "revision_type", "reapproval_required")}
    return "sha256:" + hashlib.sha256(canonical_json([json.loads(json.dumps(kept, default=str)), body]).encode()).hexdigest()


def template(plan_id: str, title: str, owner: str = "owner") -> str:
    """A draft that lacks nothing but content."""
    data = {
        "schema_version": 1, "id": plan_id, "title": title, "status": "draft", "created": now(), "updated_at": now(), "revision": 1, "content_hash": "pending", "revision_type": "semantic", "reapproval_required": False, "owner": owner, "last_writer": owner,
        "files": [], "symbols": [], "context_pages": [], "evidence": [], "change_control": {"mode": "adaptive"}, "approval": {},
        "engineering": {"profile": "product", "architecture_style": "none", "standards": [], "quality_gates": ["unit-tests"], "plain_language": True, "gates": [{"id": "unit-tests", "kind": "command", "blocking": True, "command": ["python", "-m", "pytest"]}]},
        "testing": {"approach": "test-with-change", "tests": [], "manual_checks": [{"artifact": "notes"}]},
    }
    said = {"Goal": title, "Non-goals": "None stated.", "Tasks": "| # | Batch | Files | Symbols | Depends on | Risk | Status | Validation |\n|---|---|---|---|---|---|---|---|\n| 1 | B1 | none | none | none | low | pending | gate unit-tests |", "Batches": "| Batch | Status | Depends on |\n|---|---|---|\n| B1 | pending | none |",
            "Validation": "gate unit-tests", "Testing strategy": "Unit tests.", "Execution notes": "None yet.", "Engineering requirements": "None beyond the profile.", "Quality gates": "unit-tests"}
    return document(data, "\n" + "\n\n".join(f"## {k}\n\n{v}" for k, v in said.items()) + "\n")


def document(data: dict[str, Any], body: str) -> str:
    return "---\n" + yaml.safe_dump(data, sort_keys=False, allow_unicode=True) + "---\n" + body


class Workflow:
    """One plan file and its state folder. Every change is checked against the revision that the caller has seen."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self._settle()

    @property
    def plan(self) -> Plan:
        try:
            return parse(self.path.read_text("utf-8-sig"), self.path.as_posix())
        except OSError as e:
            raise PlanError("PLAN_NOT_FOUND", f"Plan not found: {self.path}", path=self.path.as_posix()) from e

    @property
    def state(self) -> Path:
        return self.path.parent / ".state" / re.sub(r"[^\w.-]", "_", self.plan.id)

    @classmethod
    def create(cls, folder: str | Path, plan_id: str, title: str) -> Workflow:
        path = Path(folder) / f"{plan_id}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("x", encoding="utf-8") as f:  # never over another plan
            f.write(template(plan_id, title))
        own = cls(path)
        own._record("created", revision=1)
        return own

    def _record(self, kind: str, **more) -> None:
        self.state.mkdir(parents=True, exist_ok=True)
        log = self.state / "events.jsonl"
        seq = sum(1 for _ in log.open(encoding="utf-8")) if log.exists() else 0
        with log.open("a", encoding="utf-8") as f:
            f.write(canonical_json({"plan_id": self.plan.id, "seq": seq, "kind": kind, "at": now()} | {k: v for k, v in more.items() if v is not None}) + "\n")

    def _expect(self, plan: Plan, revision: int | None) -> None:
        if revision is not None and plan.frontmatter.get("revision") != revision:
            raise PlanError("REVISION_CONFLICT", f"Expected revision {revision}, found {plan.frontmatter.get('revision')}.", "revision", plan.path)

    def _commit(self, plan: Plan, kind: str, body: str | None = None, **event) -> int:
        """Write the next revision, its snapshot, event and projection."""
        data = plan.frontmatter
        data["revision"], data["updated_at"] = int(data.get("revision", 0)) + 1, now()
        text = document(data, plan.body if body is None else body).encode()
        self.state.mkdir(parents=True, exist_ok=True)
        snapshot, draft = self.state / f"{data['revision']:04d}.md", self.state / f"{data['revision']:04d}.draft"
        note = {"snapshot": snapshot.name, "digest": hashlib.sha256(text).hexdigest(), "kind": kind, "revision": data["revision"], "event": event}
        _replace(self._note, canonical_json(note).encode())
        draft.write_bytes(text)
        try:
            os.link(draft, snapshot)  # whole, and never over another revision
        except FileExistsError:
            self._note.unlink()
            raise
        finally:
            draft.unlink()
        self._settle()
        return data["revision"]

    @property
    def _note(self) -> Path:
        return self.path.parent / ".state" / f"{self.path.name}.unsettled"

    def _settle(self) -> None:
        """Do what follows a change's snapshot, as far as it isn't done; a change that never got its snapshot is forgotten."""
        if not self._note.exists():
            return
        note = json.loads(self._note.read_text("utf-8"))
        snapshot = self.state / note["snapshot"]
        text = snapshot.read_bytes() if snapshot.exists() else b""
        if hashlib.sha256(text).hexdigest() == note["digest"]:
            if int(self.plan.frontmatter.get("revision", 0)) < note["revision"]:
                _replace(self.path, text)
            if not any(e["kind"] == note["kind"] and e.get("revision") == note["revision"] for e in self.log()):
                self._record(note["kind"], revision=note["revision"], **note["event"])
            self.project()
        self._note.unlink()

    def projection(self) -> dict[str, Any]:
        """What readers of the plan need."""
        p = self.plan
        return {"plan_id": p.id, "status": p.status, "revision": p.frontmatter.get("revision"), "content_hash": p.frontmatter.get("content_hash"), "batches": [{"batch": b.get("batch"), "status": b.get("status")} for b in p.batches], "tasks": len(p.tasks)}

    def project(self) -> dict[str, Any]:
        """Write the projection as JSON beside the events."""
        out = self.projection()
        self.state.mkdir(parents=True, exist_ok=True)
        (self.state / "projection.json").write_text(canonical_json(out) + "\n", encoding="utf-8")
        return out

    def approve(self, by: str, revision: int | None = None) -> int:
        """A draft, or a plan that must be approved again, becomes approved; its content is fixed by its digest."""
        plan = self.plan
        self._expect(plan, revision)
        if plan.status != "draft" and not plan.frontmatter.get("reapproval_required"):
            raise PlanError("INVALID_TRANSITION", f"A plan that is {plan.status} needs no approval.", "status", plan.path)
        plan.frontmatter |= {"status": "approved" if plan.status == "draft" else plan.status, "content_hash": content_hash(plan.frontmatter, plan.body), "approval": {"by": by, "at": now()}, "reapproval_required": False, "revision_type": "state", "last_writer": by}
        return self._commit(plan, "approved")

    def reapprove(self, by: str, revision: int | None = None) -> int:
        """Approve a plan again whose meaning changed after its approval."""
        if not self.plan.frontmatter.get("reapproval_required"):
            raise PlanError("INVALID_TRANSITION", "The plan needs no new approval.", "reapproval_required", self.path.as_posix())
        return self.approve(by, revision)

    def revise(self, text: str, by: str, revision: int | None = None) -> int:
        """Take over an edited document; an approved plan whose meaning changed must be approved again."""
        plan, new = self.plan, parse(text, self.path.as_posix())
        self._expect(plan, revision)
        if new.id != plan.id:
            raise PlanError("PLAN_ID_CHANGED", "A revision keeps the plan's id.", "id", plan.path)
        kind = difference(plan, new)
        data = new.frontmatter | {k: plan.frontmatter.get(k) for k in ("revision", "status", "approval", "content_hash")} | {"last_writer": by, "revision_type": "semantic" if kind == "semantic" else "state"}
        data["reapproval_required"] = bool(plan.frontmatter.get("reapproval_required")) or kind == "semantic" and plan.status != "draft"
        new.frontmatter = data
        return self._commit(new, "revised", detail=kind)

    def batch(self, batch: str, step: str, revision: int | None = None) -> int:
        """Start, complete, fail, mark stale or reopen a batch, where its state and, to complete it, its gates allow."""
        plan = self.plan
        self._expect(plan, revision)
        row = next((b for b in plan.batches if b.get("batch") == batch), None)
        if row is None:
            raise PlanError("BATCH_NOT_FOUND", f"No batch {batch}.", "batches", plan.path)
        before, after = TRANSITIONS[step]
        if row.get("status") not in before or step == "start" and plan.status not in ("approved", "executing"):
            raise PlanError("INVALID_TRANSITION", f"Batch {batch} is {row.get('status')}, the plan {plan.status}: no {step}.", "batches", plan.path)
        if plan.frontmatter.get("reapproval_required") and step == "start":
            raise PlanError("REAPPROVAL_REQUIRED", "The plan must be approved again first.", "reapproval_required", plan.path)
        if step == "start":
            undone = [d for d in re.split(r"[,;]\s*", row.get("depends on", "")) if d.casefold() not in ("", "none", "-", "n/a") and next((b.get("status") for b in plan.batches if b.get("batch") == d), "") not in ("passed", "skipped")]
            if undone:
                raise PlanError("DEPENDENCY_OPEN", f"Batch {batch} waits for {', '.join(undone)}.", "batches", plan.path)
        if step == "complete" and (lacking := self.missing_gates(batch)):
            raise PlanError("GATE_EVIDENCE_MISSING", f"Gates without a pass: {', '.join(lacking)}.", "gates", plan.path)
        body = _noted(_set_cell(plan.body, "batches", "batch", batch, "status", after), f"- {now()} {batch}: {row.get('status')} → {after}")
        if step == "start":
            plan.frontmatter["status"] = "executing"
        if step == "complete" and all((after if b is row else b.get("status")) in ("passed", "skipped") for b in plan.batches):
            plan.frontmatter["status"] = "done"
        if step == "reopen" and plan.status == "done":
            plan.frontmatter["status"] = "executing"
        return self._commit(plan, f"batch_{step}", body, batch=batch)

    def log(self) -> list[dict[str, Any]]:
        file = self.state / "events.jsonl"
        return [json.loads(x) for x in file.read_text("utf-8").splitlines()] if file.exists() else []

    def missing_gates(self, batch: str) -> list[str]:
        """Blocking gates whose latest result since the batch began is no pass."""
        plan = self.plan
        gates = [g["id"] for g in (plan.frontmatter.get("engineering") or {}).get("gates") or [] if g.get("blocking")]
        last: dict[str, str] = {}
        for e in self.log():
            if e.get("batch") == batch and e["kind"] == "batch_start":
                last = {}
            elif e.get("batch") == batch and e["kind"] == "gate":
                last[e["gate"]] = e["outcome"]
        return [g for g in gates if last.get(g) != "passed"]

    def gate(self, batch: str, gate: str, outcome: str, fingerprint: str = "", detail: str = "") -> None:
        """Record a gate's outcome for a batch."""
        if outcome not in ("passed", "failed", "not-run"):
            raise PlanError("GATE_OUTCOME_INVALID", f"No outcome: {outcome}", "gates")
        self._record("gate", batch=batch, gate=gate, outcome=outcome, input_fingerprint=fingerprint, detail=capped(detail, GATE_OUTPUT), revision=self.plan.frontmatter.get("revision"))

    def review_gate(self, batch: str, gate: str, artifact: str, by: str, outcome: str = "passed", reason: str = "") -> None:
        """Record a person's review for a review gate: who, of what, and why it did not pass."""
        found = next((g for g in (self.plan.frontmatter.get("engineering") or {}).get("gates") or [] if g.get("id") == gate), None)
        if not found or found.get("kind") != "review":
            raise PlanError("GATE_REVIEW_INVALID", f"Gate {gate} is no review gate.", "gates", self.path.as_posix())
        if not by.strip() or not artifact.strip() or outcome != "passed" and not reason.strip():
            raise PlanError("GATE_REVIEW_INVALID", "A review names its reviewer and artifact, and its reason unless it passed.", "gates", self.path.as_posix())
        self.gate(batch, gate, outcome, detail=canonical_json({"artifact": artifact, "by": by, "reason": reason}))

    def run_gate(self, batch: str, gate: str, cwd: str | Path, seconds: int = GATE_SECONDS, fingerprint: str = "") -> str:
        """Run a command gate (an argument list, no shell) and record how it ended."""
        found = next((g for g in (self.plan.frontmatter.get("engineering") or {}).get("gates") or [] if g.get("id") == gate), None)
        command = (found or {}).get("command")
        if not found or found.get("kind") != "command" or not command or not all(isinstance(x, str) for x in command):
            raise PlanError("GATE_COMMAND_INVALID", f"Gate {gate} has no command.", "gates")
        try:
            done = subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=seconds, check=False)
            outcome, said = ("passed" if done.returncode == 0 else "failed"), done.stdout + done.stderr
        except subprocess.TimeoutExpired:
            outcome, said = "failed", f"no end within {seconds} s"
        except OSError as e:
            outcome, said = "not-run", str(e)
        self.gate(batch, gate, outcome, fingerprint, said)
        return outcome


def _replace(path: Path, data: bytes) -> None:
    """The file has the old content or the new, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_bytes(data)
    os.replace(part, path)


def difference(old: Plan, new: Plan) -> str:
    """``semantic`` (its meaning changed), ``state`` (only statuses or bookkeeping did), ``formatting`` or ``none``."""
    strip = lambda rows: [{k: v for k, v in r.items() if k != "status"} for r in rows]
    quiet = {"content_hash", "revision", "updated_at", "last_writer", "approval", "status", "revision_type", "reapproval_required", "evidence"}
    means = lambda p: (json.loads(json.dumps({k: v for k, v in p.frontmatter.items() if k not in quiet}, default=str)), strip(p.tasks), strip(p.batches), {k: " ".join(v.split()) for k, v in p.sections.items() if k not in ("tasks", "batches", "execution notes")})
    if means(old) != means(new):
        return "semantic"
    rest = lambda p: (p.status, [r.get("status") for r in p.tasks], [r.get("status") for r in p.batches], p.sections.get("execution notes"))
    if rest(old) != rest(new):
        return "state"
    return "none" if old.body == new.body else "formatting"


def _set_cell(body: str, section: str, key: str, value: str, column: str, to: str) -> str:
    """The body with one cell of a section's table changed."""
    lines, inside, names = body.split("\n"), False, None
    for i, line in enumerate(lines):
        if m := re.match(r"^#{1,6}\s+(.+?)\s*#*\s*$", line):
            inside, names = m[1].casefold() == section, None
        elif inside and line.strip().startswith("|"):
            own = [c.strip() for c in line.strip().strip("|").split("|")]
            if names is None:
                names = [c.casefold() for c in own]
            elif len(own) == len(names) and own[names.index(key)] == value:
                own[names.index(column)] = to
                lines[i] = "| " + " | ".join(own) + " |"
    return "\n".join(lines)


def _noted(body: str, note: str, section: str = "execution notes") -> str:
    """The body with a line added at the end of a section, or of the document where there is none."""
    lines = body.rstrip("\n").split("\n")
    heads = [(i, m[1].casefold()) for i, x in enumerate(lines) if (m := re.match(r"^#{1,6}\s+(.+?)\s*#*\s*$", x))]
    at = next((k for k, (_, name) in enumerate(heads) if name == section), None)
    end = len(lines) if at is None or at + 1 == len(heads) else heads[at + 1][0]
    while end and not lines[end - 1].strip():
        end -= 1
    return "\n".join([*lines[:end], note, *lines[end:]]) + "\n"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all plans below a folder."""
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(f"{folder.rstrip('/')}/.state/*")


def batch_states(log: DataFrame) -> DataFrame:
    """plan_id, batch, status: the fold over each batch's events."""
    steps = {f"batch_{k}": after for k, (_, after) in TRANSITIONS.items()}
    status = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])[F.col("kind")]
    moved = log.where(F.col("kind").isin(*steps)).withColumn("status", status)
    return last_per_key(moved.select("plan_id", "batch", "status", "seq"), ["plan_id", "batch"], ["seq"]).select("plan_id", "batch", "status")


def differences(pairs: DataFrame) -> DataFrame:
    """path, difference of (path, old, new): how two revisions of a plan's text differ."""
    @F.pandas_udf("string")
    def compare(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([difference(parse(a), parse(z)) for a, z in zip(old, new, strict=True)])

    return pairs.select("path", compare("old", "new").alias("difference"))
