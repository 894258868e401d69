"""Walking a source tree on the driver: built-in exclusions, the root's ignore file, supported suffixes."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loomdex.functions.text import LANGUAGES, language_of

# Folders and files that are never indexed.
IGNORED_FOLDERS = frozenset(".git .hg .svn node_modules __pycache__ .venv venv env .tox .mypy_cache .pytest_cache .ruff_cache dist build target .loomdex".split())
IGNORED_FILES = frozenset(".gitignore .gitattributes uv.lock poetry.lock package-lock.json yarn.lock pnpm-lock.yaml".split())


@lru_cache(maxsize=4096)
def glob(pattern: str) -> re.Pattern:
    """A pattern of an ignore file as an expression for whole paths: ``*`` stays within a part, ``**`` does not."""
    anchored = "/" in pattern.rstrip("/")[:-1] or pattern.startswith("/")
    body = pattern.strip("/") if anchored else pattern.rstrip("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(body):
                i += 1
            out.append(re.escape(body[i]))
            i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z")


class IgnoreRules:
    """Ordered patterns; the last that matches decides, and nothing comes back from inside a folder that is out."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\r\n")
            line = line if line.endswith("\\ ") else line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            if line.strip("/"):
                self.rules.append((glob(line), line.endswith("/"), not keep))

    def _decide(self, path: str, folder: bool) -> bool:
        for pattern, folders_only, out in reversed(self.rules):
            if (folder or not folders_only) and pattern.match(path):
                return out
        return False

    def ignores(self, path: str, folder: bool = False) -> bool:
        parts = path.split("/")
        return any(self._decide("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._decide(path, folder)


def ignore_rules(root: Path) -> IgnoreRules | None:
    """The rules of the root's ignore file; None without one, or where it says nothing."""
    try:
        lines = (root / ".gitignore").read_text("utf-8", "replace").splitlines()
    except OSError:
        return None
    rules = IgnoreRules(lines)
    return rules if rules.rules else None


def source_files(root: str | Path) -> list[str]:
    """Paths of the supported files below ``root``, relative and with slashes, sorted; ignored folders are not entered."""
    root = Path(root).resolve()
    if not root.is_dir():
        raise NotADirectoryError(f"not a directory: {root}")
    rules, found = ignore_rules(root), []
    for folder, folders, names in os.walk(root):
        at = Path(folder).relative_to(root).as_posix()
        under = "" if at == "." else at + "/"
        folders[:] = sorted(x for x in folders if x not in IGNORED_FOLDERS and not (rules and rules.ignores(under + x, True)))
        found += [f"{under}{n}" for n in names if n not in IGNORED_FILES and Path(n).suffix.lower() in LANGUAGES and not (rules and rules.ignores(under + n))]
    return sorted(found)


def indexable(path: Column) -> Column:
    """Whether a path has a known suffix and neither it nor a folder of it is always left out."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, sorted(IGNORED_FOLDERS)))) | name.isin(*sorted(IGNORED_FILES))
    return language_of(path).isNotNull() & ~out


def kept(paths: DataFrame, lines: list[str], column: str = "path") -> DataFrame:
    """The rows of a listing (of a store that has no folders to enter) that an ignore file's lines leave."""
    rules = IgnoreRules(lines)

    @F.pandas_udf(BooleanType())
    def stays(own: pd.Series) -> pd.Series:
        return own.map(lambda p: p is not None and not rules.ignores(p)).astype(bool)

    return paths.where(stays(F.col(column)))
