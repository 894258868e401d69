"""Python sources, read with the standard parser; texts of signatures, bodies and callees are cut from the source as written."""

from __future__ import annotations

import ast

from loomdex.sources.records import Extract, Symbol, body, flat

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class Source:
    """A source's lines as bytes, for columns count bytes."""

    def __init__(self, text: str):
        self.lines = [x.encode() for x in text.splitlines(keepends=True)] if "\x0c" not in text else [x.encode() for x in text.split("\n")]
        if "\x0c" in text:
            self.lines = [x + b"\n" for x in self.lines]

    def cut(self, line: int, column: int, end_line: int, end_column: int) -> str:
        if line == end_line:
            return self.lines[line - 1][column:end_column].decode("utf-8", "replace")
        return b"".join([self.lines[line - 1][column:], *self.lines[line : end_line - 1], self.lines[end_line - 1][:end_column]]).decode("utf-8", "replace")

    def of(self, node) -> str:
        return self.cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


def parameters(head: str) -> str:
    """The bracketed parameter list in the text between a function's name and its body."""
    depth, start, i = 0, -1, 0
    square = 0
    while i < len(head):
        c = head[i]
        if c in "\"'":
            quote = head[i : i + 3] if head[i : i + 3] in ('"""', "'''") else c
            i += len(quote)
            while i < len(head) and not head.startswith(quote, i):
                i += 2 if head[i] == "\\" else 1
            i += len(quote)
            continue
        if c == "#":
            while i < len(head) and head[i] not in "\r\n":
                i += 1
            continue
        if c == "[" and start < 0:
            square += 1
        elif c == "]" and start < 0:
            square -= 1
        elif c in "([{" and not square:
            start = i if start < 0 else start
            depth += 1
        elif c in ")]}" and not square:
            depth -= 1
            if not depth:
                return head[start : i + 1]
        i += 1
    return "()"


def unquoted(raw: str) -> str:
    raw = raw.strip()
    for q in ('"""', "'''"):
        if len(raw) >= 6 and raw.startswith(q) and raw.endswith(q):
            return raw[3:-3].strip()
    if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1].strip()
    return raw


def docstring(node, source: Source) -> str:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and (isinstance(first.value, ast.JoinedStr) or isinstance(first.value, ast.Constant) and isinstance(first.value.value, (str, bytes))):
        return unquoted(source.of(first.value))
    return ""


def calls_in(statements: list, source: Source) -> list[tuple[str, int]]:
    """Calls by a name or an attribute, outer before inner, not those of definitions inside (but of their decorators)."""
    found, todo = [], list(reversed(statements))
    while todo:
        node = todo.pop()
        if isinstance(node, DEFINITIONS):
            todo += reversed(node.decorator_list)
            continue
        if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            found.append((source.of(node.func).strip(), node.lineno))
        todo += reversed(sorted(ast.iter_child_nodes(node), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0))))
    return found


def extract(path: str, text: str) -> Extract:
    """Functions and classes at the top and in classes, imports outside of definitions, calls in functions. A syntax error raises."""
    tree, source, out = ast.parse(text), Source(text), Extract()
    module = (path.removesuffix("/__init__.py") if path.endswith("/__init__.py") else path.removesuffix(".py")).replace("/", ".")

    def define(statements: list, prefix: str) -> None:
        for node in statements:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = node.body[0]
                start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
                column = first.col_offset if start == first.lineno else min(d.col_offset for d in first.decorator_list) - 1
                head = source.cut(node.lineno, node.col_offset, start, column)
                params = flat(parameters(head[head.index("def") + 3 :].lstrip().removeprefix(node.name))) or "()"
                returns = flat(source.of(node.returns)) if node.returns else ""
                name = f"{module}.{prefix}{node.name}"
                out.symbols.append(Symbol(name, node.name, "method" if prefix else "function", f"def {node.name}{params}" + (f" -> {returns}" if returns else ""), params, returns, docstring(node, source), node.lineno, node.end_lineno, [], body(source.cut(start, column, node.body[-1].end_lineno, node.body[-1].end_col_offset))))
                out.calls += [(name, callee, line) for callee, line in calls_in(node.body, source)]
            elif isinstance(node, ast.ClassDef):
                bases = [source.of(x) for x in node.bases if isinstance(x, (ast.Name, ast.Attribute))]
                out.symbols.append(Symbol(f"{module}.{prefix}{node.name}", node.name, "class", f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), "()", "", docstring(node, source), node.lineno, node.end_lineno, bases))
                define(node.body, f"{prefix}{node.name}.")

    define(tree.body, "")
    stack = list(reversed(tree.body))
    while stack:
        node = stack.pop()
        if isinstance(node, DEFINITIONS):
            continue
        if isinstance(node, ast.ImportFrom):
            source_name = "." * node.level + (node.module or "")
            out.imports.append((source_name, [a.name for a in node.names if a.asname is None and a.name not in ("*", source_name)]))
        elif isinstance(node, ast.Import):
            out.imports += [(a.name, []) for a in node.names if a.asname is None]
        else:
            stack += reversed([n for n in ast.iter_child_nodes(node) if isinstance(n, (ast.stmt, ast.excepthandler, ast.match_case))])
    return out
