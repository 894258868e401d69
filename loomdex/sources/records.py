"""What an extractor gives for a file, and helpers that the languages share."""

from __future__ import annotations

from dataclasses import dataclass, field

from loomdex.functions.text import BODY_BYTES
from loomdex.functions.udf import capped


@dataclass
class Symbol:
    qualified_name: str
    name: str
    kind: str
    signature: str
    params: str = ""
    returns: str = ""
    docstring: str = ""
    line: int = 0
    end_line: int = 0
    bases: list[str] = field(default_factory=list)
    body: str = ""


@dataclass
class Extract:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, list[str]]] = field(default_factory=list)
    calls: list[tuple[str, str, int]] = field(default_factory=list)


def flat(s: str) -> str:
    return " ".join(s.split())


def body(s: str) -> str:
    """A body as it is stored: line feeds, at most ``BODY_BYTES``."""
    return capped(s.replace("\r\n", "\n").replace("\r", "\n"), BODY_BYTES)
