"""Command line: ``python -m loomdex.cli <command>``. Exit codes: 1 for a missing index or a plan problem, 2 for bad usage or an ambiguous name."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from loomdex import __version__


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loomdex").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomdex")
    p.add_argument("--root", default=".")
    p.add_argument("--warehouse")
    p.add_argument("--lang", default="en", choices=["en", "zh"])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "update", "version", "history-document", "serve"):
        sub.add_parser(name)
    sub.add_parser("doctor").add_argument("--history", metavar="FOLDER")
    for name in ("query", "history", "callers", "callees", "plan-context"):
        q = sub.add_parser(name)
        q.add_argument("text")
        q.add_argument("-n", type=int, default=20)
    o = sub.add_parser("overview")
    o.add_argument("--max-tokens", type=int)
    d = sub.add_parser("details")
    d.add_argument("folder")
    c = sub.add_parser("context")
    c.add_argument("action", choices=["load", "status", "evict", "pin", "unpin", "budget", "ws"])
    c.add_argument("page", nargs="?")
    for name in ("session", "plan", "batch"):
        c.add_argument(f"--{name}", default="")
    c.add_argument("--need", type=int)
    c.add_argument("--all", action="store_true")
    c.add_argument("--force", action="store_true")
    c.add_argument("--pin", action="store_true")
    c.add_argument("--source", action="store_true")
    c.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    l = sub.add_parser("plan")
    l.add_argument("action", choices=["new", "lint", "status", "impact", "show", "approve", "reapprove", "revise", "diff", "start", "complete", "fail", "stale", "reopen", "gate-run", "gate-record", "gate-review"])
    l.add_argument("path")
    l.add_argument("rest", nargs="*")
    l.add_argument("--files", nargs="*", default=[])
    l.add_argument("--symbols", nargs="*", default=[])
    l.add_argument("--revision", type=int)
    return p


def show(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def plan(a, index) -> int:
    from loomdex.plans import lint, records, workflow

    if a.action in ("lint", "status", "impact"):
        plans = records.read(index.spark, a.path)
        if a.action == "lint":
            found = lint.lint(plans, index.table("files").select("path") if "files" in index.meta["tables"] else None)
            show(found)
            return int(found.count() > 0)
        show(records.summary(plans) if a.action == "status" else index.impact(plans, a.files, a.symbols))
        return 0
    if a.action == "new":
        print(workflow.Workflow.create(a.path, a.rest[0], " ".join(a.rest[1:]) or a.rest[0]).path)
        return 0
    flow = workflow.Workflow(a.path)
    if a.action == "show":
        print(json.dumps(flow.project(), indent=1, ensure_ascii=False))
    elif a.action == "approve":
        print(flow.approve(a.rest[0] if a.rest else "owner", a.revision))
    elif a.action == "reapprove":
        print(flow.reapprove(a.rest[0] if a.rest else "owner", a.revision))
    elif a.action == "revise":
        print(flow.revise(Path(a.rest[0]).read_text(encoding="utf-8"), a.rest[1] if len(a.rest) > 1 else "owner", a.revision))
    elif a.action == "diff":
        print(workflow.difference(flow.plan, workflow.Workflow(a.rest[0]).plan))
    elif a.action == "gate-run":
        print(flow.run_gate(a.rest[0], a.rest[1], index.root))
    elif a.action == "gate-record":
        flow.gate(a.rest[0], a.rest[1], a.rest[2])
    elif a.action == "gate-review":
        flow.review_gate(a.rest[0], a.rest[1], a.rest[2], *a.rest[3:6])
    else:
        print(flow.batch(a.rest[0], a.action, a.revision))
    return 0


def context(a, index) -> int:
    scope = {"session": a.session, "plan": a.plan, "batch": a.batch}
    if a.action == "load":
        got = index.context_load(a.page, pin=a.pin, with_source=a.source, **scope)
        print(got["rendered"])
        print(json.dumps({k: got[k] for k in ("prefetched", "evicted")}))
    elif a.action == "status":
        show(index.context_status(**scope))
    elif a.action == "evict":
        print(json.dumps(index.context_evict(a.page, a.need, everything=a.all, force=a.force, **scope)))
    elif a.action in ("pin", "unpin"):
        index.context_pin(a.page, a.action == "pin", **scope)
    elif a.action == "budget":
        print(json.dumps(index.context_budget(**{k: int(v) for k, v in (x.split("=", 1) for x in a.set)})))
    else:
        print(index.context_render())
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from loomdex.engine import AmbiguousSymbol, Index, IndexMissing, LeaseHeld
    from loomdex.plans.records import PlanError

    index = Index(spark or session(), a.root, a.warehouse, a.lang)
    try:
        if a.command in ("scan", "update"):
            out = index.scan() if a.command == "scan" else index.update()
            print(json.dumps(vars(out), ensure_ascii=False))
        elif a.command == "query":
            show(index.search(a.text, a.n).drop("body"))
        elif a.command == "history":
            show(index.history(a.text, a.n))
        elif a.command in ("callers", "callees"):
            show(getattr(index, a.command)(a.text))
        elif a.command == "plan-context":
            print(json.dumps(index.plan_context(a.text), ensure_ascii=False, default=str))
        elif a.command == "doctor":
            found = index.doctor(a.history).collect()
            for r in found:
                print(f"{r.problem}: {r.key}")
            return int(bool(found))
        elif a.command == "overview":
            print(index.overview(a.max_tokens))
        elif a.command == "serve":
            from loomdex.server import serve

            serve(index)
        elif a.command == "history-document":
            print(index.history_document())
        elif a.command == "details":
            from loomdex.operators.render import write_details

            print("\n".join(write_details(index.details(), Path(a.folder))))
        elif a.command == "context":
            return context(a, index)
        elif a.command == "plan":
            return plan(a, index)
    except AmbiguousSymbol as e:
        print(e, file=sys.stderr)
        return 2
    except IndexMissing as e:
        print(e, file=sys.stderr)
        return 2 if a.command == "query" else 1
    except (LookupError, LeaseHeld, ValueError) as e:
        code = f"{e.code}: " if isinstance(e, PlanError) else ""
        print(f"{code}{e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
