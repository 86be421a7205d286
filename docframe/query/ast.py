"""Compiled queries: a small immutable tree."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Nor:
    parts: tuple


@dataclass(frozen=True)
class Test:
    """One operator on one top-level field; ``op`` has no dollar sign."""

    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Not:
    """Negates the conjunction of ``tests`` on one field."""

    tests: tuple


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str = ""
