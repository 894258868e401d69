"""Tokens of C-like languages (JavaScript, TypeScript, Go), with brackets matched; enough to find declarations and calls."""

from __future__ import annotations

import re
from typing import NamedTuple

_NUMBER = re.compile(r"0[xXbBoO][\w]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?\w*")
_NAME = re.compile(r"[^\W\d][\w$]*|[$#@][\w$]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.|:=|<-|&&|\|\||\?\?|[<>=!]=+|.", re.S)
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await", "export", "default"}


class Token(NamedTuple):
    kind: str  # name, number, string, comment, regex, punct
    text: str
    start: int
    end: int


def tokenise(s: str, script: bool = True) -> list[Token]:
    """All tokens but white space. A template's text is strings, and what stands in ``${}`` is tokens of its own."""
    out: list[Token] = []
    templates: list[int] = []  # depth of braces at which each open template goes on
    depth, i, n = 0, 0, len(s)
    last: Token | None = None

    def add(kind: str, end: int) -> None:
        nonlocal i, last
        t = Token(kind, s[i:end], i, end)
        out.append(t)
        if kind != "comment":
            last = t
        i = end

    def template(at: int) -> int:
        """End of a template's text from ``at``: after its closing backtick, or after ``${``."""
        while at < n:
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                return at + 1
            elif s.startswith("${", at):
                return at + 2
            else:
                at += 1
        return n

    while i < n:
        c = s[i]
        if c.isspace() or c == "﻿":
            i += 1
        elif s.startswith("//", i) or s.startswith("#!", i) and i == 0:
            end = s.find("\n", i)
            add("comment", n if end < 0 else end)
        elif s.startswith("/*", i):
            end = s.find("*/", i + 2)
            add("comment", n if end < 0 else end + 2)
        elif c == "`":
            if script:
                end = template(i + 1)
                if s[end - 1] != "`" or end - 1 == i:
                    depth += 1
                    templates.append(depth)
                add("string", end)
            else:
                end = s.find("`", i + 1)
                add("string", n if end < 0 else end + 1)
        elif c in "\"'":
            end = i + 1
            while end < n and s[end] != c and s[end] != "\n":
                end += 2 if s[end] == "\\" else 1
            add("string", min(n, end + 1))
        elif c == "}" and templates and templates[-1] == depth:
            end = template(i + 1)
            if s[end - 1] == "`":
                templates.pop()
                depth -= 1
            add("string", end)
        elif (c.isdigit() or c == "." and i + 1 < n and s[i + 1].isdigit()) and (m := _NUMBER.match(s, i)):
            add("number", m.end())
        elif m := _NAME.match(s, i):
            add("name", m.end())
        elif script and c == "/" and (last is None or last.kind == "punct" and last.text not in (")", "]", "}") or last.kind == "name" and last.text in _BEFORE_EXPRESSION):
            end, klass = i + 1, False
            while end < n and s[end] != "\n" and (s[end] != "/" or klass):
                klass = s[end] == "[" or klass and s[end] != "]"
                end += 2 if s[end] == "\\" else 1
            end = min(n, end + 1)
            while end < n and s[end].isalpha():
                end += 1
            add("regex", end)
        else:
            m = _PUNCT.match(s, i)
            depth += (c == "{") - (c == "}")
            add("punct", m.end())
    return out


def pairs(tokens: list[Token]) -> dict[int, int]:
    """Index of the closing bracket for each opening one (and the end for one that never closes)."""
    out, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for k, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in "([{" and len(t.text) == 1:
            stack.append((t.text, k))
        elif t.text in close:
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] == close[t.text]:
                    for _, open_ in stack[j + 1 :]:
                        out[open_] = k
                    out[stack[j][1]] = k
                    del stack[j:]
                    break
    for _, open_ in stack:
        out[open_] = len(tokens) - 1
    return out
