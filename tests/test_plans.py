import json

import pytest

from loomdex.operators.graph import cycle_nodes
from loomdex.plans import evidence, impact, lint, records, workflow
from loomdex.plans.records import PlanError


def plan(plan_id="p1", status="approved", tasks="| 1 | B1 | src/a.py, `src/b.py` | m.f, n.g | none | low | pending | gate unit-tests |", batches="| B1 | pending | none |", **data):
    text = workflow.template(plan_id, "Title")
    head, body = records.frontmatter(text)
    head |= {"status": status, "content_hash": "sha256:1", "approval": {"by": "me"}} | data
    p = records.parse(text)
    body = body.replace(p.sections["tasks"].split("\n")[2], tasks).replace(p.sections["batches"].split("\n")[2], batches)
    return workflow.document(head, body)


def frame(spark, *texts):
    return records.from_texts(spark.createDataFrame([(f"plans/{k}.md", t) for k, t in enumerate(texts)], "path string, text string"))


def codes(df):
    return sorted((r.plan_id, r.code, r.field) for r in df.collect())


def test_parse():
    p = records.parse("﻿" + plan().replace("\n", "\r\n"))
    assert (p.id, p.status, p.tasks[0]["files"], p.tasks[0]["symbols"], p.tasks[0]["number"]) == ("p1", "approved", ["src/a.py", "src/b.py"], ["m.f", "n.g"], 1)
    assert records.sections("## A\nx\n# b #\ny\n## A\nz") == {"a": "x\nz", "b": "y"}
    assert records.table("| A | B |\n|---|:--:|\n| 1 | 2 |\n| 3 |\n\ntext") == [{"a": "1", "b": "2"}] and records.table("| A |") == []
    assert records.references("a, `b`, none, TODO, n/a, -") == ["a", "b"] and records.references(["x ", ""]) == ["x"]
    for bad, field in (("x", "frontmatter"), ("---\na: 1", "frontmatter"), ("---\n[1\n---\n", "frontmatter"), ("---\n- 1\n---\n", "frontmatter")):
        with pytest.raises(PlanError) as e:
            records.parse(bad)
        assert (e.value.code, e.value.field) == ("PLAN_SCHEMA_INVALID", field)
    with pytest.raises(PlanError) as e:
        records.parse("---\n" + "x" * records.MOST_BYTES)
    assert e.value.code == "PLAN_TOO_LARGE"


def test_tables_and_views(spark, tmp_path):
    (tmp_path / "a.md").write_text(plan(batches="| B1 | passed | none |\n| B2 | pending | B1 |"))
    (tmp_path / "notes.md").write_text("# Notes\n")
    (tmp_path / "b.md").write_text("---\nnot closed")
    plans = records.read(spark, str(tmp_path))
    assert sorted((r.plan_id or "", r.code or "") for r in plans.collect()) == [("", "PLAN_SCHEMA_INVALID"), ("p1", "")]
    assert [tuple(r) for r in records.summary(plans).collect()] == [("p1", "approved", 1, 0, 2, "B2")]
    assert [(r.status, r.n, r.plan_ids) for r in records.by_status(plans).collect()] == [("approved", 1, ["p1"])]
    assert [tuple(r) for r in records.dependencies(plans).collect()] == [("p1", "B2", "B1")]
    loop = frame(spark, plan(tasks="| 1 | B1 | none | none | 2 | low | pending | gate a |\n| 2 | B1 | none | none | #1 | low | pending | gate a |\n| 3 | B1 | none | none | 1; 2 | low | pending | gate a |"))
    assert sorted(r.node for r in cycle_nodes(records.dependencies(loop)).collect()) == ["task 1", "task 2"]


def test_lint(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/b.py",)], "path string")
    assert codes(lint.lint(frame(spark, plan()), files)) == []
    bad = plan("p2", tasks="| 1 | B1 | src/none.py, ../x | m.f | none | odd | strange | works |\n| 1 | B9 | none | none | none | low | done | test it |\n| x |  | none | none | none | low | done | look |", batches="| B1 | wrong | none |\n| B2 | pending | none |")
    found = codes(lint.lint(frame(spark, bad), files))
    assert ("p2", "PLAN_FILE_NOT_FOUND", "tasks[1].files") in found and ("p2", "PLAN_SCHEMA_INVALID", "tasks[1].files") in found and ("p2", "BATCH_STATE_INVALID", "batches[B1].status") in found
    assert {f for _, c, f in found if c == "PLAN_SCHEMA_INVALID"} == {"tasks[1].files", "tasks.#", "tasks[1].risk", "tasks[1].status", "tasks[1].batch", "tasks[0].batch"}
    assert [f for _, c, f in found if c == "PLAN_VAGUE_VALIDATION"] == ["tasks[0].validation", "tasks[1].validation", "tasks[1].validation"]
    state = plan("p3", status="draft", tasks="| 1 | B1 | none | none | none | low | pending | gate a |\n| 2 | B2 | none | none | none | low | done | gate a |", batches="| B1 | passed | none |\n| B2 | pending | none |")
    assert {(c, f) for _, c, f in codes(lint.lint(frame(spark, state)))} == {("INVALID_TRANSITION", "batches"), ("PLAN_STATE_CONFLICT", "batches[B1].status"), ("PLAN_STATE_CONFLICT", "batches[B2].status")}
    assert {c for _, c, _ in codes(lint.lint(frame(spark, plan("x"), plan("x"))))} == {"PLAN_ID_DUPLICATE"}
    head, body = records.frontmatter(plan("p4"))
    del head["owner"], head["created"]
    missing = lint.lint(frame(spark, workflow.document(head, body))).collect()
    assert [(r.code, r.message) for r in missing] == [("PLAN_SCHEMA_INVALID", "frontmatter lacks created, owner")]
    tests = [{"test_id": "a", "disposition": "implement", "files": [], "gate_id": "none"}, {"test_id": "a", "disposition": "omit"}, {"disposition": "odd"}]
    gates = [{"id": "g", "kind": "command", "blocking": True, "command": []}, {"id": "g", "kind": "odd", "blocking": "x"}, {"kind": "review", "blocking": False}]
    head, _ = records.frontmatter(plan("p6"))
    deals = plan("p6", testing={"approach": "test-with-change", "tests": tests, "manual_checks": [{"artifact": ""}]}, engineering=head["engineering"] | {"gates": gates})
    assert [(c, f) for _, c, f in codes(lint.lint(frame(spark, deals)))] == [
        ("GATE_COMMAND_INVALID", "engineering.gates.g.command"), ("PLAN_SCHEMA_INVALID", "engineering.gates..id"), ("PLAN_SCHEMA_INVALID", "engineering.gates.g.blocking"), ("PLAN_SCHEMA_INVALID", "engineering.gates.g.id"), ("PLAN_SCHEMA_INVALID", "engineering.gates.g.kind"),
        ("PLAN_SCHEMA_INVALID", "testing.tests[].disposition"), ("PLAN_SCHEMA_INVALID", "testing.tests[].test_id"), ("PLAN_SCHEMA_INVALID", "testing.tests[a].test_id"), ("TEST_CONTRACT_MISMATCH", "testing.manual_checks[0].artifact"), ("TEST_CONTRACT_MISMATCH", "testing.tests[a].files"),
        ("TEST_CONTRACT_MISMATCH", "testing.tests[a].gate_id"), ("TEST_CONTRACT_MISMATCH", "testing.tests[a].reason"),
    ]
    wrong = plan("p5", schema_version=2, revision=0, revision_type="x", reapproval_required="no", files="a", change_control={"mode": "x"}, content_hash="pending", approval={})
    assert {f for _, _, f in codes(lint.lint(frame(spark, wrong)))} == {"schema_version", "revision", "revision_type", "reapproval_required", "files", "change_control.mode", "content_hash", "approval"}


def test_impact(spark):
    one = plan("p1", tasks="| 1 | B1 | src/a.py | m.f | none | low | pending | gate a |\n| 2 | B2 | src/a.py, lib/c.py | n.planned, z.user_profile | none | low | pending | gate a |", files=["loose.py"], symbols=["q.loose", "m.f"])
    plans = frame(spark, one, plan("p2", status="draft"), plan("p3", tasks="| 1 | B1 | none | none | none | low | pending | gate a |"))
    index = spark.createDataFrame([("src/a.py", "m.f"), ("src/a.py", "m.h")], "file string, qualified_name string")
    edges = spark.createDataFrame([("m.h", "x.mid", 1), ("x.mid", "n.planned", 1)], "src_qname string, dst_qname string, count long")
    got = impact.impact(plans, records.tasks(plans), ["src/a.py", "other/c.py"], ["m.f", "k.user_profile_new.profile"], index, edges).orderBy("level", "batch", "kind", "ref").collect()
    rows = [(r.plan_id, r.level, r.batch, r.kind, r.ref, r.task, r.confidence, r.changed_ref) for r in got]
    assert rows == [
        ("p1", "direct", "B1", "file", "src/a.py", 1, 1.0, None), ("p1", "direct", "B1", "symbol", "m.f", 1, 1.0, None), ("p1", "direct", "B2", "file", "src/a.py", 2, 1.0, None),
        ("p1", "indirect", "B2", "symbol", "n.planned", 2, 0.7, "x.mid"), ("p1", "possible", "B2", "file", "lib/c.py", 2, 0.5, "other/c.py"),
    ]
    alike = impact.impact(plans, records.tasks(plans), [], ["k.user_profile"], None, None).collect()
    assert [(r.level, r.ref, r.reason) for r in alike] == [("possible", "z.user_profile", "lexical overlap: user_profile")]
    refs = impact.planned_refs(records.tasks(plans), plans, "symbols").where("plan_id = 'p1'").collect()
    assert {(r.batch, r.ref, r.task) for r in refs} == {("B1", "m.f", 1), ("B2", "n.planned", 2), ("B2", "z.user_profile", 2), ("unassigned", "q.loose", None)}


def test_evidence(spark):
    schema = "plan_id string, batch string, gate_id string, outcome string, input_fingerprint string, plan_revision int, seq int"
    results = spark.createDataFrame([("p", "B", "g", "passed", "old", 1, 1), ("p", "B", "g", "failed", "new", 1, 2), ("p", "B", "h", "failed", "x", 1, 1), ("p", "B", "h", "passed", "x", 2, 2), ("p", "C", "g", "passed", "same", 1, 1)], schema)
    now = spark.createDataFrame([("B", "new"), ("C", "same")], "batch string, current string")
    assert [(r.batch, r.gate_id) for r in evidence.stale(results, now, ["plan_id", "batch", "gate_id"], ["batch"]).collect()] == [("B", "h")]
    need = spark.createDataFrame([("B", "g"), ("B", "h"), ("B", "none")], "batch string, gate_id string")
    assert {r.gate_id: r.ok for r in evidence.satisfied(results, need, ["batch", "gate_id"]).collect()} == {"g": False, "h": True, "none": False}
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    inputs = lambda *p: spark.createDataFrame([("B", x) for x in p], "batch string, path string")
    of = lambda *p: evidence.fingerprints(inputs(*p), files, ["batch"]).first().current
    assert of("a", "b") == of("b", "a", "a") != of("a") and of("a", "gone") != of("a")


def test_workflow(spark, tmp_path):
    w = workflow.Workflow.create(tmp_path, "p1", "Title")
    with pytest.raises(FileExistsError):
        workflow.Workflow.create(tmp_path, "p1", "Title")
    with pytest.raises(PlanError) as e:
        w.batch("B1", "start")
    assert e.value.code == "INVALID_TRANSITION"
    assert w.approve("me", 1) == 2 and w.plan.status == "approved" and w.plan.frontmatter["content_hash"].startswith("sha256:")
    with pytest.raises(PlanError) as e:
        w.batch("B1", "start", revision=1)
    assert e.value.code == "REVISION_CONFLICT"
    w.batch("B1", "start", 2)
    for act in (lambda: w.batch("B1", "complete"), lambda: w.batch("B7", "start"), lambda: w.run_gate("B1", "none", tmp_path), lambda: w.gate("B1", "unit-tests", "maybe")):
        with pytest.raises(PlanError):
            act()
    text = w.path.read_text()
    assert w.revise(text.replace("Unit tests.", "More unit tests."), "me") == 4 and w.plan.frontmatter["reapproval_required"]
    assert w.approve("me") == 5 and not w.plan.frontmatter["reapproval_required"]
    with pytest.raises(PlanError) as e:
        w.revise(text.replace("id: p1", "id: p2"), "me")
    assert e.value.code == "PLAN_ID_CHANGED"
    head, body = records.frontmatter(w.path.read_text())
    head["engineering"]["gates"][0]["command"] = ["python", "-c", "print('x' * 30000)"]
    w.path.write_text(workflow.document(head, body))
    assert w.run_gate("B1", "unit-tests", tmp_path) == "passed" and len(w.log()[-1]["detail"]) == workflow.GATE_OUTPUT
    w.batch("B1", "complete")
    assert "B1: in-progress → passed" in w.plan.sections["execution notes"]
    assert w.plan.status == "done" and w.plan.batches[0]["status"] == "passed" and w.project()["status"] == "done"
    w.batch("B1", "reopen")
    assert w.plan.status == "executing" and w.missing_gates("B1") == []
    w.batch("B1", "start")
    assert w.missing_gates("B1") == ["unit-tests"]
    assert sorted(p.name for p in w.state.glob("*.md")) == [f"{k:04d}.md" for k in range(2, 9)]
    log = workflow.events(spark, str(tmp_path))
    assert [tuple(r) for r in workflow.batch_states(log).collect()] == [("p1", "B1", "in-progress")]


def test_difference():
    a = records.parse(plan())
    same = lambda t: workflow.difference(a, records.parse(t))
    assert same(plan()) == "none" and same(plan().replace("| pending | gate", "| done | gate")) == "state" and same(plan(symbols=["x"])) == "semantic" and same(plan().replace("Unit tests.", "Unit  tests.")) == "formatting" and same(plan(status="blocked")) == "state"


def test_stale_marks_reports_and_contracts(spark, tmp_path):
    from loomdex.plans import upkeep

    plans = tmp_path / "plans"
    w = workflow.Workflow.create(plans, "p1", "Title")
    (tmp_path / "a.py").write_text("x")
    head, body = records.frontmatter(w.path.read_text())
    head["testing"]["tests"] = [{"test_id": "t", "batch": "B1", "disposition": "implement", "files": ["tests/*.py::case"], "gate_id": "unit-tests"}]
    w.path.write_text(workflow.document(head, body.replace("| 1 | B1 | none | none", "| 1 | B1 | a.py | none")))
    w.approve("me")
    w.batch("B1", "start")
    files = lambda h: spark.createDataFrame([("a.py", h)], "path string, hash string")
    current = upkeep.current_fingerprints(records.read(spark, str(plans)), files("1")).first().current
    w.gate("B1", "unit-tests", "passed", current)
    assert upkeep.unmet_contracts(w.plan, "B1", tmp_path) == ["t"]
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "x.py").write_text("")
    assert upkeep.unmet_contracts(w.plan, "B1", tmp_path) == [] and not upkeep.resolves("../x", tmp_path) and upkeep.resolves("tests", tmp_path)
    w.batch("B1", "complete")
    w.batch("B1", "reopen")
    w.batch("B1", "start")
    w.gate("B1", "unit-tests", "passed", current)
    head, body = records.frontmatter(w.path.read_text())
    head["status"] = "executing"
    w.path.write_text(workflow.document(head, workflow._set_cell(body, "batches", "batch", "B1", "status", "passed")))
    assert upkeep.stale_evidence(spark, str(plans), files("1")).count() == 0
    found = upkeep.stale_evidence(spark, str(plans), files("2"))
    assert [(r.plan_id, r.batch, r.gate) for r in found.collect()] == [("p1", "B1", "unit-tests")]
    report = upkeep.write_report(found, tmp_path / "out" / "stale.json", ["plan_id", "batch", "gate"])
    assert '"items":[{"batch":"B1"' in report.read_text()
    assert ("PROJECTION_DRIFT", "p1", (w.state / "projection.json").as_posix()) in upkeep.check(spark, str(plans))
    w.project()
    assert {c for c, *_ in upkeep.check(spark, str(plans))} <= {"PLAN_STATE_CONFLICT"}
    done = upkeep.mark_stale(plans, found.collect())
    assert [m["batch"] for m in done["marked"]] == ["B1"] and w.plan.batches[0]["status"] == "stale"
    assert [m["code"] for m in upkeep.mark_stale(plans, found.collect())["skipped"]] == ["BATCH_NOT_PASSED"] and [m["code"] for m in upkeep.mark_stale(tmp_path / "none", found.collect())["skipped"]] == ["PLAN_NOT_FOUND"]
    assert upkeep.latest_snapshot(w.state)[0] == w.plan.frontmatter["revision"] and upkeep.latest_snapshot(tmp_path) is None
    assert upkeep.config(tmp_path) == {"allow_update_plan_state": True}
    (tmp_path / "loomdex.config.json").write_text('{"allow_update_plan_state": false}')
    assert upkeep.config(tmp_path) == {"allow_update_plan_state": False}
    for bad in ("[]", "{", '{"allow_update_plan_state": 1}'):
        (tmp_path / "loomdex.config.json").write_text(bad)
        with pytest.raises(PlanError):
            upkeep.config(tmp_path)


def test_a_change_that_was_cut_off_is_settled(tmp_path, monkeypatch):
    w = workflow.Workflow.create(tmp_path, "p1", "Title")
    before = w.path.read_text()
    for cut in ("_record", "project", "plan file"):
        with monkeypatch.context() as m:
            def stop(*a, **k):
                raise KeyboardInterrupt

            if cut == "plan file":
                real = workflow._replace
                m.setattr(workflow, "_replace", lambda path, data: stop() if path.suffix == ".md" else real(path, data))
            else:
                m.setattr(workflow.Workflow, cut, stop)
            with pytest.raises(KeyboardInterrupt):
                w.revise(w.path.read_text(), "me") if w.plan.status != "draft" else w.approve("me")
        w = workflow.Workflow(w.path)
        revision = w.plan.frontmatter["revision"]
        assert (w.state / f"{revision:04d}.md").read_bytes() == w.path.read_bytes()
        assert [e["revision"] for e in w.log()] == list(range(1, revision + 1)) and json.loads((w.state / "projection.json").read_text())["revision"] == revision
    assert revision == 4 and before != w.path.read_text() and not list(tmp_path.glob(".state/*.unsettled"))
    with monkeypatch.context() as m:  # cut before the snapshot: nothing happened
        m.setattr(workflow.os, "link", stop)
        with pytest.raises(KeyboardInterrupt):
            w.revise(w.path.read_text(), "me")
    assert workflow.Workflow(w.path).plan.frontmatter["revision"] == 4 and not list(tmp_path.glob(".state/*.unsettled"))
    (w.state / "0005.md").write_text("another's")
    with pytest.raises(FileExistsError):
        w.revise(w.path.read_text(), "me")
    assert workflow.Workflow(w.path).plan.frontmatter["revision"] == 4 and (w.state / "0005.md").read_text() == "another's"


def test_gate_reviews(tmp_path):
    w = workflow.Workflow.create(tmp_path, "p1", "Title")
    head, body = records.frontmatter(w.path.read_text())
    head["engineering"]["gates"].append({"id": "design", "kind": "review", "blocking": True})
    w.path.write_text(workflow.document(head, body))
    for wrong in (("unit-tests", "notes.md", "me"), ("design", "", "me"), ("design", "notes.md", " "), ("design", "notes.md", "me", "failed"), ("none", "notes.md", "me")):
        with pytest.raises(PlanError) as e:
            w.review_gate("B1", *wrong)
        assert e.value.code == "GATE_REVIEW_INVALID"
    w.review_gate("B1", "design", "notes.md", "me", "failed", "too long")
    assert "design" in w.missing_gates("B1") and json.loads(w.log()[-1]["detail"]) == {"artifact": "notes.md", "by": "me", "reason": "too long"}
    w.review_gate("B1", "design", "notes.md", "me")
    assert "design" not in w.missing_gates("B1")


def test_history_documents(spark):
    from loomdex.operators import quality

    some, none = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "name string")
    assert [r.key for r in quality.undocumented(some, none).collect()] == ["history"]
    assert quality.undocumented(some, some).count() == quality.undocumented(none, none).count() == 0


def test_impact_is_bounded_and_says_so(spark, tmp_path):
    from loomdex.plans import upkeep

    plans = spark.createDataFrame([("p1", "executing", [], []), ("p2", "approved", [], []), ("p3", "draft", [], [])], "plan_id string, status string, files array<string>, symbols array<string>")
    tasks = [("p1", k, "B1", [f"new/f{k}.py"] if k < 40 else [], [f"s{k:03d}"]) for k in range(260)] + [(p, 1, "B1", [], ["s000"]) for p in ("p2", "p3")]
    tasks = spark.createDataFrame(tasks, "plan_id string, number int, batch string, files array<string>, symbols array<string>")
    files, symbols = [f"old/f{k}.py" for k in range(40)], [f"s{k:03d}" for k in range(260)]
    got = impact.impact(plans, tasks, files, symbols, None, None).collect()
    own = [r for r in got if r.plan_id == "p1"]
    assert len(own) == 200 and {(r.plan_rows, r.plan_possible) for r in own} == {(300, 40)} and not any(r.search_cut for r in got)
    assert [(r.plan_rows, r.plan_possible) for r in got if r.plan_id == "p2"] == [(1, 0)] and not [r for r in got if r.plan_id == "p3"]
    wide = impact.impact(plans, tasks, files, symbols, None, None, most=1000).where("plan_id = 'p1'")
    assert wide.count() == 272 and wide.where("level = 'possible'").count() == 12
    every = impact.everything(plans, tasks, files, symbols, None, None)
    assert every.rows.count() == 301 and not every.cut
    report = json.loads(upkeep.write_report(every.rows, tmp_path / "r.json", ["plan_id", *impact.ORDER]).read_text())
    assert (len(report["items"]), report["total"], report["truncated"], report["search_cut"]) == (200, 301, True, False)
    small = json.loads(upkeep.write_report(every.rows.where("plan_id = 'p2'"), tmp_path / "r.json", ["plan_id"]).read_text())
    assert (small["total"], small["truncated"]) == (1, False) and json.loads(upkeep.write_report(every.rows.limit(1), tmp_path / "r.json", ["plan_id"], cut=True).read_text())["truncated"]


def test_impact_of_three_hundred_changed_symbols(spark):
    plans = spark.createDataFrame([("p1", "executing", [], [])], "plan_id string, status string, files array<string>, symbols array<string>")
    tasks = spark.createDataFrame([("p1", k, "B1", [], [f"c{k}"]) for k in range(300)], "plan_id string, number int, batch string, files array<string>, symbols array<string>")
    edges = spark.range(300).selectExpr("concat('c', id) as src_qname", "concat('r', id) as dst_qname", "1 as count")
    index = spark.createDataFrame([], "file string, qualified_name string")
    roots = [f"r{k}" for k in range(300)]
    whole = impact.impact(plans, tasks, [], roots, index, edges, most=1000).collect()
    assert len(whole) == 300 and {(r.level, r.direction, r.graph_depth, r.search_cut) for r in whole} == {("indirect", "caller", 1, False)}
    assert impact.everything(plans, tasks, [], roots, index, edges, nodes=256).cut


def test_unbound_evidence_is_told(spark):
    from loomdex.plans import evidence

    rows = [("p", "B1", "g", "sha256:1"), ("p", "B1", "g", ""), ("p", "B1", "g", None), ("p", None, "g", "sha256:1"), ("p", "B1", "no", ""), ("q", "B1", "g", "sha256:1"), ("p", "B1", "g", "")]
    results = spark.createDataFrame(rows, "plan_id string, batch string, gate string, input_fingerprint string")
    known = spark.createDataFrame([("p", "B1", "g")] * 2, "plan_id string, batch string, gate string")
    got = sorted((r.plan_id, r.batch or "", r.gate, r.why) for r in evidence.unbound(results, known, ["plan_id", "batch", "gate"]).collect())
    assert got == [("p", "", "g", "unknown"), *[("p", "B1", "g", "fingerprint")] * 3, ("p", "B1", "no", "unknown"), ("q", "B1", "g", "unknown")]
    assert evidence.unbound(results.limit(0), known, ["plan_id", "batch", "gate"]).count() == 0
