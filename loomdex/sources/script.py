"""JavaScript and TypeScript sources: declarations, class members, imports and calls, found among tokens."""

from __future__ import annotations

import bisect
import re

from loomdex.functions.text import SCRIPT_SUFFIXES
from loomdex.sources.records import Extract, Symbol, body, flat
from loomdex.sources.tokens import pairs, tokenise

_MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor get set".split())
_NO_CALL = frozenset("if for while switch catch function return typeof await void delete with super import new throw else do in of yield case".split())


class Script:
    def __init__(self, path: str, text: str):
        self.text, self.out = text, Extract()
        self.module = next((path.removesuffix(x) for x in SCRIPT_SUFFIXES if path.endswith(x)), path)
        self.all = tokenise(text)
        self.t = [t for t in self.all if t.kind != "comment"]
        self.pair = pairs(self.t)
        self.back = {b: a for a, b in self.pair.items()}
        self.comments = {}  # by the start of the token that follows
        held = None
        for t in self.all:
            if t.kind == "comment":
                held = t
            else:
                if held:
                    self.comments[t.start] = held.text
                held = None
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    # -- small helpers

    def line(self, k: int, end: bool = False) -> int:
        t = self.t[min(k, len(self.t) - 1)]
        return bisect.bisect_left(self.breaks, t.end - 1 if end else t.start) + 1

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def cut(self, a: int, b: int) -> str:
        """Text of the tokens from a to b, both included."""
        return self.text[self.t[a].start : self.t[b].end] if a <= b < len(self.t) else ""

    def doc(self, k: int) -> str:
        raw = self.comments.get(self.t[k].start, "").strip()
        return raw.strip("/*").strip().lstrip("*").strip() if raw.startswith("/**") else ""

    def angle(self, k: int) -> int:
        """After a list of type parameters that begins at k, or k."""
        if self.at(k) != "<":
            return k
        depth = 0
        while k < len(self.t):
            x = self.at(k)
            depth += (x == "<") - (x == ">") - (2 if x == ">>" else 0)
            if x in ("(", "[", "{"):
                k = self.pair[k]
            k += 1
            if depth <= 0:
                return k
        return k

    def return_type(self, k: int, stop: tuple[str, ...]) -> tuple[str, int]:
        """Text of a type after a colon at k, and the index at which it ends: the first of ``stop`` on its level."""
        if self.at(k) != ":":
            return "", k
        start = k = k + 1
        while k < len(self.t):
            x = self.at(k)
            if x == "{" and "{" in stop and k > start and self.at(k - 1) not in ("|", "&", "=>", ":", "<", ",", "extends"):
                break
            if x in stop and x != "{":
                break
            if x in ("(", "[", "{"):
                k = self.pair[k]
            elif x == "<":
                k = self.angle(k) - 1
            k += 1
        return (flat(self.cut(start, k - 1)) if k > start else ""), k

    # -- functions

    def function_at(self, k: int) -> tuple[str, str, int, int, int, int] | None:
        """A function value at k (``function`` or an arrow): params, returns, body's first and last token, the end, the body's open bracket or -1."""
        if self.at(k) == "async" and self.at(k + 1) in ("function", "(", "<") or self.at(k) == "async" and self.is_name(k + 1) and self.at(k + 2) == "=>":
            k += 1
        if self.at(k) == "function":
            k += 1
            if self.at(k) == "*":
                k += 1
            if self.is_name(k):
                k += 1
            k = self.angle(k)
            if self.at(k) != "(":
                return None
            close = self.pair[k]
            returns, j = self.return_type(close + 1, ("{",))
            if self.at(j) != "{":
                return None
            return flat(self.cut(k, close)), returns, j, self.pair[j], self.pair[j], j
        if self.is_name(k) and self.at(k + 1) == "=>":
            params, returns, j = "()", "", k + 2
        else:
            k = self.angle(k)
            if self.at(k) != "(":
                return None
            close = self.pair[k]
            returns, j = self.return_type(close + 1, ("=>", ";"))
            if self.at(j) != "=>":
                return None
            params, j = flat(self.cut(k, close)), j + 1
        if self.at(j) == "{":
            return params, returns, j, self.pair[j], self.pair[j], j
        end = self.expression_end(j)
        return params, returns, j, end, end, -1

    def expression_end(self, k: int) -> int:
        """Last token of the expression at k: before a comma, semicolon or closing bracket on its level, or where a new statement begins."""
        start = k
        while k < len(self.t):
            x = self.at(k)
            if x in (",", ";", ")", "]", "}"):
                break
            if k > start and self.line(k) > self.line(k - 1, True) and self.t[k].kind == "name" and self.t[k - 1].kind != "punct" and x not in ("in", "of", "instanceof", "as"):
                break
            if k > start and self.line(k) > self.line(k - 1, True) and self.at(k - 1) in (")", "]", "}") and self.t[k].kind == "name" and x not in ("in", "instanceof", "as"):
                break
            k = self.pair[k] if x in ("(", "[", "{") and self.t[k].kind == "punct" else k
            k += 1
        return max(start, k - 1)

    def calls(self, owner: str, first: int, last: int) -> None:
        """Calls by a name or a member in the tokens from first to last, not those of functions and classes inside."""
        k = first
        while k <= last:
            x, t = self.at(k), self.t[k]
            if t.kind == "name" and x == "class" and self.at(k - 1) != ".":
                while k <= last and self.at(k) != "{":
                    k += 1
                k = self.pair.get(k, k) + 1
                continue
            if t.kind == "name" and x in ("function", "async") or x == "(" or t.kind == "name" and self.at(k + 1) == "=>":
                f = self.function_at(k) if self.at(k - 1) not in (".", "?.") else None
                if f and (x != "(" or not (k > first and (self.is_name(k - 1) and self.at(k - 1) not in _NO_CALL))):
                    k = f[4] + 1
                    continue
            if x == "(" and k > first and self.at(k - 1) not in _NO_CALL:
                j = k - 1
                if self.at(j) == ">":
                    depth = 0
                    while j > first:
                        depth += (self.at(j) == ">") - (self.at(j) == "<")
                        j -= 1
                        if not depth:
                            break
                start = self.callee_start(j, first)
                if start is not None and self.at(start - 1) not in ("new", "function", "class"):
                    self.out.calls.append((owner, self.text[self.t[start].start : self.t[j].end].strip(), self.line(start)))
            k += 1

    def callee_start(self, j: int, first: int) -> int | None:
        """First token of a name or member chain that ends at j; None if it is something else."""
        if self.t[j].kind != "name":
            return None
        while j > first and self.at(j - 1) in (".", "?."):
            j -= 2
            while j > first and self.at(j) in (")", "]"):
                open_ = self.back.get(j)
                if open_ is None or open_ <= first:
                    return max(first, open_ or first)
                j = open_
                if self.t[j - 1].kind == "name" and self.at(j - 1) not in _NO_CALL or self.at(j - 1) in (")", "]"):
                    j -= 1
                else:
                    return j
        return j

    # -- statements

    def add(self, k: int, end: int, name: str, kind: str, signature: str, params: str, returns: str, doc: str, text: str, owner: str = "", bases: list[str] | None = None) -> str:
        full = f"{self.module}.{owner}{name}"
        self.out.symbols.append(Symbol(full, name, kind, signature, params, returns, doc, self.line(k), self.line(end, True), bases or [], body(text)))
        return full

    def statements(self, k: int, end: int) -> None:
        """Declarations among the tokens from k to end, also those in blocks that belong to no function or class."""
        while k <= end:
            x, doc_at = self.at(k), k
            if self.t[k].kind != "name":
                k += 1
                continue
            if x == "import" and self.at(k + 1) not in ("(", "."):
                k = self.imported(k)
                continue
            if x == "export":
                k += 1
                if self.at(k) == "default":
                    k += 1
                x = self.at(k)
            while x in ("declare", "abstract", "async") and self.is_name(k + 1) and self.at(k + 1) in ("class", "function", "abstract", "interface", "type", "const", "let", "var"):
                k += 1
                x = self.at(k)
            after = self.declaration(k, doc_at)
            k = after if after > k else k + 1

    def declaration(self, k: int, doc_at: int) -> int:
        """Read a declaration at k and return what follows it, or k."""
        x = self.at(k)
        start = k - 1 if self.at(k - 1) in ("async", "abstract") else k
        if self.at(k - 1) == ".":
            return k
        if x == "function" and (self.is_name(k + 1) or self.at(k + 1) == "*"):
            f, generator = self.function_at(k), self.at(k + 1) == "*"
            if not f:
                return k + 1
            if not generator:
                name = self.at(k + 1)
                full = self.add(start, f[4], name, "function", f"function {name}{f[0]}" + (f": {f[1]}" if f[1] else ""), f[0], f[1], self.doc(doc_at), self.cut(f[2], f[3]))
                self.calls(full, f[2], f[3])
            return f[4] + 1
        if x == "class" and self.is_name(k + 1):
            return self.klass(k, start, doc_at, "")
        if x == "interface" and self.is_name(k + 1):
            j = k + 2
            while j < len(self.t) and self.at(j) != "{":
                j += 1
            if j < len(self.t):
                name = self.at(k + 1)
                self.add(k, self.pair[j], name, "interface", f"interface {name}", "()", "", self.doc(doc_at), self.cut(j, self.pair[j]))
                return self.pair[j] + 1
        if x == "type" and self.is_name(k + 1) and self.at(self.angle(k + 2)) == "=":
            j = self.angle(k + 2) + 1
            end = self.expression_end(j)
            name = self.at(k + 1)
            self.add(k, end, name, "type_alias", f"type {name}", "()", "", self.doc(doc_at), "")
            return end + 1
        if x in ("const", "let", "var"):
            return self.variables(k + 1, doc_at)
        return k

    def variables(self, k: int, doc_at: int) -> int:
        while k < len(self.t):
            start = k
            if not self.is_name(k):
                if self.at(k) not in ("{", "["):
                    return k
                j = self.pair[k] + 1
            else:
                j = k + 1
            _, j = self.return_type(j, ("=", ";", ",")) if self.at(j) == ":" else ("", j)
            if self.at(j) != "=":
                return j
            f = self.function_at(j + 1) if self.is_name(k) else None
            if f:
                name = self.at(k)
                full = self.add(start, f[4], name, "function", f"function {name}{f[0]}" + (f": {f[1]}" if f[1] else ""), f[0], f[1], self.doc(doc_at), self.cut(f[2], f[3]))
                self.calls(full, f[2], f[3])
                j = f[4] + 1
            else:
                j = self.expression_end(j + 1) + 1
            if self.at(j) != ",":
                return j
            k = j + 1
        return k

    def klass(self, k: int, start: int, doc_at: int, owner: str) -> int:
        name = self.at(k + 1)
        j = heritage = self.angle(k + 2)
        while j < len(self.t) and self.at(j) != "{":
            j = self.angle(j) if self.at(j) == "<" else j + 1
        if j >= len(self.t):
            return k + 1
        said = flat(self.cut(heritage, j - 1)) if j > heritage else ""
        bases = [p.strip() for p in re.sub(r"\bextends\b|\bimplements\b", ",", said).split(",") if p.strip()]
        end = self.pair[j]
        self.add(start, end, name, "class", f"class {name}" + (f" {said}" if said else ""), "()", "", self.doc(doc_at), self.cut(j, end), owner, bases)
        self.members(j + 1, end - 1, name)
        return end + 1

    def members(self, k: int, end: int, owner: str) -> None:
        while k <= end:
            doc_at = start = k
            if self.at(k).startswith("@") and self.t[k].kind == "name":
                k += 1
                while self.at(k) == ".":
                    k += 2
                k = self.pair[k] + 1 if self.at(k) == "(" else k
                continue
            while self.at(k) in _MODIFIERS and self.at(k + 1) not in ("(", "=", ":", ";", "?"):
                k += 1
            if self.at(k) == "*":
                k += 1
            if self.at(k) == "class" and self.is_name(k + 1):
                k = self.klass(k, start, doc_at, f"{owner}.")
                continue
            if self.t[k].kind not in ("name", "string") and self.at(k) != "[":
                k += 1
                continue
            name_at = k
            k = self.pair[k] + 1 if self.at(k) == "[" else k + 1
            name = self.cut(name_at, k - 1)
            if self.at(k) in ("?", "!"):
                k += 1
            g = self.angle(k)
            if self.at(g) == "(":
                close = self.pair[g]
                returns, j = self.return_type(close + 1, ("{", ";"))
                if self.at(j) == "{":
                    params = flat(self.cut(g, close))
                    full = self.add(start, self.pair[j], name, "method", f"{name}{params}", params, returns, self.doc(doc_at), self.cut(j, self.pair[j]), f"{owner}.")
                    self.calls(full, j, self.pair[j])
                    k = self.pair[j] + 1
                else:
                    k = j + 1
                continue
            _, j = self.return_type(k, ("=", ";")) if self.at(k) == ":" else ("", k)
            if self.at(j) == "=":
                f = self.function_at(j + 1)
                if f:
                    full = self.add(start, f[4], name, "method", f"{name}{f[0]}", f[0], "", self.doc(doc_at), self.cut(f[2], f[3]), f"{owner}.")
                    self.calls(full, f[2], f[3])
                    k = f[4] + 1
                else:
                    k = self.expression_end(j + 1) + 1
            else:
                k = max(j, k)

    def imported(self, k: int) -> int:
        """``import 'x'``, ``import a, { b as c } from 'x'``, ``import * as ns from 'x'``."""
        j = k + 1
        while j < len(self.t) and self.t[j].kind != "string" and self.at(j) != ";":
            j = self.pair[j] if self.at(j) == "{" else j
            j += 1
        if j >= len(self.t) or self.t[j].kind != "string":
            return k + 1
        clause = re.sub(r"\bfrom\s*$", "", self.text[self.t[k].end : self.t[j].start].strip())
        clause = re.sub(r"^type\s+(?!,|from\b)", "", clause.strip())
        names = [flat(n).split(" as ")[-1].strip() for n in re.sub(r"[{}]", ",", clause).split(",") if n.strip()]
        self.out.imports.append((self.t[j].text.strip("\"'`"), names))
        return j + 1


def extract(path: str, text: str) -> Extract:
    s = Script(path, text)
    if s.t:
        s.statements(0, len(s.t) - 1)
    return s.out
