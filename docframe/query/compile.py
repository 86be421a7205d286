"""Query dictionaries to trees.  All validation of queries happens here."""

from __future__ import annotations

import re
from typing import Any

from docframe.errors import DocframeError
from docframe.query.ast import And, Nor, Not, Or, Regex, Test
from docframe.query.regex import to_python

COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
OPERATORS = {*COMPARISONS, "in", "nin", "exists", "regex", "options", "type", "not"}
LOGICAL = {"$and": And, "$or": Or, "$nor": Nor}
TYPES = ("null", "boolean", "number", "string", "array", "object")
#: Letters of flags that a regular expression may have.
FLAGS = "imsu"


def compile_query(query: dict | None) -> And:
    """Compile ``query``; ``None`` and ``{}`` match every document."""
    if query is not None and not isinstance(query, dict):
        raise DocframeError("A query must be an object.")
    parts: list = []
    for key, value in (query or {}).items():
        if key in LOGICAL:
            if not isinstance(value, (list, tuple)):
                raise DocframeError(f"{key} must be an array of queries.")
            inner = tuple(compile_query(q) for q in value)
            if key == "$and":
                parts += [p for q in inner for p in q.parts]
            else:
                parts.append(LOGICAL[key](inner))
        elif key.startswith("$"):
            raise DocframeError(f"Unsupported query operator: {key}.")
        else:
            parts += field_tests(key, value)
    return And(tuple(parts))


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and any(isinstance(k, str) and k.startswith("$") for k in value)


def field_tests(field: str, value: Any) -> list:
    """Tests of one field: operators, a bare regular expression, or equality."""
    if isinstance(value, re.Pattern):
        return [Test(field, "regex", from_pattern(value))]
    return operator_tests(field, value) if is_operators(value) else [Test(field, "eq", value)]


def operator_tests(field: str, spec: dict) -> list:
    for key in spec:
        if not (key.startswith("$") and key[1:] in OPERATORS):
            raise DocframeError(f"Unsupported query operator: {key}.")
    out: list = []
    for key, value in spec.items():
        op = key[1:]
        if op in COMPARISONS:
            out.append(Test(field, op, value))
        elif op in ("in", "nin"):
            if not isinstance(value, (list, tuple)):
                raise DocframeError(f"{key} must be an array.")
            out.append(Test(field, op, tuple(value)))
        elif op == "exists":
            if not isinstance(value, bool):
                raise DocframeError("$exists must be a boolean.")
            out.append(Test(field, op, value))
        elif op == "regex":
            out.append(Test(field, op, regex_of(spec)))
        elif op == "options":
            if "$regex" not in spec:
                raise DocframeError("$options requires a $regex operator.")
        elif op == "type":
            out.append(Test(field, op, type_names(value)))
        else:
            if not isinstance(value, dict):
                raise DocframeError("$not requires an operator expression object.")
            if not value:
                raise DocframeError("$not requires at least one operator.")
            out.append(Not(tuple(field_tests(field, value))))
    return out


def from_pattern(value: re.Pattern) -> Regex:
    flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if value.flags & bit)
    return Regex(value.pattern, flags)


def regex_of(spec: dict) -> Regex:
    pattern, flags = spec["$regex"], spec.get("$options", "")
    if isinstance(pattern, re.Pattern):
        if "$options" in spec:
            raise DocframeError("$options cannot be combined with a RegExp $regex value; set flags on the RegExp instead.")
        return from_pattern(pattern)
    if not isinstance(pattern, str):
        raise DocframeError("$regex must be a string or a RegExp.")
    if not isinstance(flags, str):
        raise DocframeError("$options must be a string of regex flags.")
    for flag in flags:
        if flag not in FLAGS:
            raise DocframeError(f'Unsupported $regex flag "{flag}". Allowed flags: i, m, s, u.')
    if len(set(flags)) != len(flags):
        raise DocframeError(f"Invalid $regex pattern: repeated flag in {flags}")
    try:
        to_python(pattern, flags)
    except re.error as e:
        raise DocframeError(f"Invalid $regex pattern: {e}") from e
    return Regex(pattern, flags)


def type_names(value: Any) -> tuple:
    names = list(value) if isinstance(value, (list, tuple)) else [value]
    if not names:
        raise DocframeError("$type must specify at least one type.")
    out = []
    for name in names:
        if not isinstance(name, str):
            raise DocframeError("$type must be a type name string or an array of them.")
        full = "boolean" if name == "bool" else name
        if full not in TYPES:
            raise DocframeError(f'Unsupported $type name "{name}". Allowed: null, boolean (bool), number, string, array, object.')
        out.append(full)
    return tuple(out)
