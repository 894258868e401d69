"""Go sources: functions, methods, types, imports and calls, found among tokens."""

from __future__ import annotations

import bisect
import re

from loomdex.sources.records import Extract, Symbol, body, flat
from loomdex.sources.tokens import pairs, tokenise

_NO_CALL = frozenset("if for switch select func return go defer range case else import package var const type map chan struct interface".split())


class GoFile:
    def __init__(self, path: str, text: str):
        self.text, self.out = text, Extract()
        self.module = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.all = tokenise(text, script=False)
        self.t = [t for t in self.all if t.kind != "comment"]
        self.pair = pairs(self.t)
        self.back = {b: a for a, b in self.pair.items()}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.docs, held = {}, []
        for t in self.all:
            if t.kind == "comment":
                held.append(t.text.strip())
            else:
                self.docs[t.start] = " ".join(c.removeprefix("//").strip() for c in held if c.startswith("//"))
                held = []

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def cut(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b].end] if a <= b < len(self.t) else ""

    def line(self, k: int, end: bool = False) -> int:
        t = self.t[min(k, len(self.t) - 1)]
        return bisect.bisect_left(self.breaks, t.end - 1 if end else t.start) + 1

    def read(self) -> Extract:
        k = 0
        while k < len(self.t):
            x = self.at(k)
            if x == "import":
                k = self.imports(k + 1)
            elif x == "func" and (self.t[k + 1 : k + 2] and self.t[k + 1].kind == "name" or self.at(k + 1) == "("):
                k = self.function(k)
            elif x == "type":
                k = self.types(k)
            elif x in ("(", "{", "["):
                k = self.pair[k] + 1
            else:
                k += 1
        return self.out

    def imports(self, k: int) -> int:
        end = self.pair[k] if self.at(k) == "(" else k + (self.t[k].kind == "name" or self.at(k) == ".") if k < len(self.t) else k
        self.out.imports += [(t.text.strip('"`'), []) for t in self.t[k : end + 1] if t.kind == "string" and t.text.strip('"`')]
        return end + 1

    def result_end(self, k: int) -> int:
        """Index of the body's brace after a result that begins at k (or where there is none, of what follows it)."""
        line = self.line(k - 1, True)
        while k < len(self.t):
            x = self.at(k)
            if x == "{" and self.at(k - 1) not in ("struct", "interface"):
                return k
            if self.line(k) > line:
                return k
            k = self.pair[k] if x in ("(", "[", "{") else k
            line = self.line(k, True)
            k += 1
        return k

    def function(self, k: int) -> int:
        start, doc = k, self.docs.get(self.t[k].start, "")
        k += 1
        receiver = ""
        if self.at(k) == "(":
            receiver = flat(self.cut(k, self.pair[k]))
            inner = [t.text for t in self.t[k + 1 : self.pair[k]]]
            k = self.pair[k] + 1
        name = self.at(k)
        k += 1
        if self.at(k) == "[":
            k = self.pair[k] + 1
        if self.at(k) != "(":
            return k
        params, after = flat(self.cut(k, self.pair[k])), self.pair[k] + 1
        brace = self.result_end(after)
        returns = flat(self.cut(after, brace - 1)) if brace > after else ""
        has_body = self.at(brace) == "{"
        end = self.pair[brace] if has_body else brace - 1
        owner = ""
        if receiver:
            kind = inner[1:] if len(inner) > 1 and inner[0].isidentifier() and inner[1] not in (".", "[") else inner
            owner = flat("".join(kind)).lstrip("*")
        full = f"{self.module}.{owner}.{name}" if owner else f"{self.module}.{name}"
        signature = (f"func ({receiver}) " if receiver else "func ") + name + params + (f" {returns}" if returns else "")
        self.out.symbols.append(Symbol(full, name, "method" if receiver else "function", signature, params, returns, doc, self.line(start), self.line(end, True), [], body(self.cut(brace, end) if has_body else "")))
        if has_body:
            self.calls(full, brace + 1, end - 1)
        return end + 1

    def calls(self, owner: str, first: int, last: int) -> None:
        """Every call, with its callee as written."""
        for k in range(first, last + 1):
            if self.at(k) != "(" or k == first and self.at(k - 1) == "{":
                continue
            j = k - 1
            if self.at(j) == "]" and self.t[self.back[j] - 1].kind == "name":
                j = self.back[j] - 1
            if self.t[j].kind != "name" or self.at(j) in _NO_CALL:
                continue
            start = j
            while start > first and self.at(start - 1) == ".":
                start -= 2
                while self.at(start) in (")", "]") and start in self.back:
                    start = self.back[start]
                    if self.t[start - 1].kind == "name" and self.at(start - 1) not in _NO_CALL:
                        start -= 1
            if self.at(start - 1) == "func":
                continue
            self.out.calls.append((owner, flat(self.cut(start, k - 1)), self.line(start)))

    def types(self, k: int) -> int:
        doc = self.docs.get(self.t[k].start, "")
        k += 1
        if self.at(k) != "(":
            return self.type_spec(k, doc)
        end = self.pair[k]
        k += 1
        while k < end:
            k = self.type_spec(k, doc)
        return end + 1

    def type_spec(self, k: int, doc: str) -> int:
        start, name = k, self.at(k)
        k += 1
        if self.at(k) == "=":  # an alias is no type of its own
            return self.type_end(k + 1)
        if self.at(k) == "[" and self.at(k + 1) != "]" and self.t[k + 1].kind == "name" and self.pair[k] > k + 2:
            k = self.pair[k] + 1
        end = self.type_end(k)
        said = flat(self.cut(k, end - 1))
        interface = self.at(k) == "interface"
        methods = []
        if interface and self.at(k + 1) == "{":
            j, stop = k + 2, self.pair[k + 1]
            while j < stop:
                if self.t[j].kind == "name" and self.at(j + 1) == "(":
                    methods.append(self.at(j))
                    j = self.result_end(self.pair[j + 1] + 1)
                else:
                    j += 1
        self.out.symbols.append(Symbol(f"{self.module}.{name}", name, "interface" if interface else "class", f"type {name} {said}" if said else f"type {name}", "", "", doc, self.line(start), self.line(end - 1, True), methods))
        return end

    def type_end(self, k: int) -> int:
        line = self.line(k)
        while k < len(self.t) and self.line(k) == line and self.at(k) != ")":
            j = self.pair[k] if self.at(k) in ("(", "[", "{") else k
            line = self.line(j, True)
            k = j + 1
        return k


def extract(path: str, text: str) -> Extract:
    g = GoFile(path, text)
    return g.read() if g.t else g.out
