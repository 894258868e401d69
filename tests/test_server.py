import io
import json

from loomdex.engine import Index
from loomdex.server import TOOLS, serve


def ask(index, *messages):
    out = io.StringIO()
    serve(index, io.StringIO("\n".join(m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages)), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_tools(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def save(x):\n    return fmt(x)\ndef fmt(x): return x\n")
    index = Index(spark, root, tmp_path / "w")
    call = lambda k, name, **args: {"id": k, "method": "tools/call", "params": {"name": name, "arguments": args}}
    got = ask(
        index, {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call(3, "search_symbols", query="save"), call(4, "scan_project"), call(5, "search_symbols", query="save"), call(6, "context_load", page="save"),
        call(7, "context_status"), call(8, "doctor"), call(9, "module_detail", module="(root)"), call(10, "overview"), call(11, "symbol_history", symbol="save"), call(12, "plan_context", query="save it"), call(13, "context_evict", everything=True), call(14, "update_index"), call(15, "odd"), call(16, "overview", odd=1), "{", {"id": 17, "method": "odd"}, {"id": 18, "method": "ping"},
    )
    by = {r["id"]: r for r in got}
    text = lambda k: by[k]["result"]["content"][0]["text"]
    assert {t["name"] for t in by[2]["result"]["tools"]} == set(TOOLS) and len(TOOLS) == 11
    assert by[3]["result"]["isError"] and "IndexMissing" in text(3) and not by[4]["result"]["isError"]
    assert "a.save" in text(5) and "### a.save" in text(6) and "fresh" in text(7) and text(8) == "nothing found" and "a.fmt" in text(9) and "# Overview" in text(10) and "added" in text(11) and "ev-0001" in text(12) and "a.save" in text(13) and '"changed": 0' in text(14)
    assert by[15]["error"]["code"] == -32602 and by[16]["result"]["isError"] and by[None]["error"]["code"] == -32700 and by[17]["error"]["code"] == -32601 and by[18]["result"] == {}


def test_rows_that_are_cut_say_so(spark):
    from loomdex.server import _rows

    assert json.loads(_rows(spark.range(5), 3).splitlines()[-1]) == {"truncated": True, "shown": 3}
    assert len(_rows(spark.range(3), 3).splitlines()) == 3 and _rows(spark.range(0)) == "nothing found"
