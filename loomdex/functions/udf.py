"""The few functions that the JVM lacks, as Arrow-batched UDFs: line differences, canonical JSON, byte-capped text."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def line_difference(old: str, new: str, faithful: bool = False) -> str:
    """``+n/-m`` lines; ``faithful`` gives m as 0."""
    added = removed = 0
    matcher = difflib.SequenceMatcher(None, old.splitlines(), new.splitlines(), autojunk=True)
    for op, a, b, c, d in matcher.get_opcodes():
        if op != "equal":
            removed += b - a
            added += d - c
    return f"+{added}/-{0 if faithful else removed}"


def canonical_json(value) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def capped(text: str, most: int, note: str = "") -> str:
    """At most ``most`` UTF-8 bytes of text, cut between characters, and then the note."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= most else data[:most].decode("utf-8", "ignore") + note


@F.pandas_udf(StringType())
def body_difference(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else line_difference(a, b) for a, b in zip(old, new)])


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """JSON text rewritten in canonical form."""
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def byte_cap(most: int, note: str = ""):
    @F.pandas_udf(StringType())
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else capped(t, most, note))

    return cut
