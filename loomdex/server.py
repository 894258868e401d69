"""The index as tools for a client over standard input and output: JSON-RPC, one message a line, as the Model Context Protocol has it.

Standard output belongs to the messages; whatever else there is to say goes to standard error. Answers are capped at ``MOST_BYTES``.
"""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from loomdex import __version__
from loomdex.functions.udf import capped

MOST_BYTES = 50_000


def _rows(df, most: int = 200) -> str:
    rows = [json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.limit(most + 1).collect()]
    return "\n".join(rows[:most] + [json.dumps({"truncated": True, "shown": most})] * (len(rows) > most)) or "nothing found"


def _module(index, module: str) -> str:
    row = index.details().where((f"module = '{module}'" if "'" not in module else "false")).first()
    return row.content if row else f"no module {module}"


#: Name, what it does, its arguments (name: type, and default where it has one), and how.
TOOLS: dict[str, tuple[str, dict[str, tuple], Any]] = {
    "scan_project": ("Index the whole tree anew.", {}, lambda i: json.dumps(vars(i.scan()))),
    "update_index": ("Index what changed.", {}, lambda i: json.dumps(vars(i.update()))),
    "overview": ("The overview document.", {"max_tokens": ("integer", None)}, lambda i, max_tokens: i.overview(max_tokens)),
    "module_detail": ("The details of a top-level module.", {"module": ("string",)}, _module),
    "search_symbols": ("Symbols by name and description.", {"query": ("string",), "limit": ("integer", 20)}, lambda i, query, limit: _rows(i.search(query, limit).drop("body"))),
    "symbol_history": ("A symbol's changes.", {"symbol": ("string",), "limit": ("integer", 200)}, lambda i, symbol, limit: _rows(i.history(symbol, limit))),
    "plan_context": ("Evidence for a request.", {"query": ("string",)}, lambda i, query: json.dumps(i.plan_context(query), default=str, ensure_ascii=False)),
    "context_load": ("Load a page into a scope.", {"page": ("string",), "session": ("string", ""), "plan": ("string", ""), "batch": ("string", ""), "pin": ("boolean", False), "with_source": ("boolean", False)}, lambda i, page, **k: i.context_load(page, **k)["rendered"]),
    "context_status": ("Entries of a scope and how fresh they are.", {"session": ("string", ""), "plan": ("string", ""), "batch": ("string", "")}, lambda i, **k: _rows(i.context_status(**k))),
    "context_evict": ("Evict pages of a scope.", {"page": ("string", None), "need": ("integer", None), "everything": ("boolean", False), "force": ("boolean", False), "session": ("string", ""), "plan": ("string", ""), "batch": ("string", "")}, lambda i, **k: json.dumps(i.context_evict(**k))),
    "doctor": ("Problems of the index.", {}, lambda i: _rows(i.doctor())),
}


def described() -> list[dict[str, Any]]:
    out = []
    for name, (said, args, _) in TOOLS.items():
        schema = {"type": "object", "properties": {k: {"type": v[0]} for k, v in args.items()}, "required": [k for k, v in args.items() if len(v) == 1]}
        out.append({"name": name, "description": said, "inputSchema": schema})
    return out


def call(index, name: str, given: dict[str, Any]) -> dict[str, Any]:
    """A tool's answer; its failure is an answer too."""
    try:
        _, args, run = TOOLS[name]
        if unknown := set(given) - set(args):
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        text, failed = run(index, **{k: given[k] if len(v) == 1 else given.get(k, v[1]) for k, v in args.items()}), False
    except Exception as e:  # noqa: BLE001
        text, failed = f"{type(e).__name__}: {e}", True
    return {"content": [{"type": "text", "text": capped(text, MOST_BYTES, f"\n\n[cut at {MOST_BYTES} bytes]")}], "isError": failed}


def answer(index, message: dict[str, Any]) -> dict[str, Any] | None:
    """The response to a message; None for a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    base = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return base | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomdex", "version": __version__}}}
    if method == "ping":
        return base | {"result": {}}
    if method == "tools/list":
        return base | {"result": {"tools": described()}}
    if method == "tools/call" and params.get("name") in TOOLS:
        return base | {"result": call(index, params["name"], params.get("arguments") or {})}
    return base | {"error": {"code": -32601 if method != "tools/call" else -32602, "message": f"unknown: {params.get('name') if method == 'tools/call' else method}"}}


def serve(index, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            reply = answer(index, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
