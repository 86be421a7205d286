"""Update dictionaries to operations, with all checks that need no document."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from docframe.errors import DocframeError
from docframe.query.compile import field_tests, is_operators

OPERATORS = ("$set", "$unset", "$min", "$max", "$inc", "$mul", "$rename", "$currentDate", "$push", "$addToSet", "$pop", "$pull", "$pullAll")
NUMERIC = ("$min", "$max", "$inc", "$mul")
ARRAYS = ("$push", "$addToSet", "$pop", "$pull", "$pullAll")
ID = "_id"


@dataclass(frozen=True)
class Change:
    """One operator on one field; ``tests`` are the operators of a ``$pull``."""

    op: str
    field: str
    value: Any = None
    tests: tuple = ()


def cannot(op: str, field: str, why: str) -> str:
    return f'Cannot apply {op} to "{field}": {why}.'


def compile_update(update: dict) -> list[Change]:
    """Operations in the order of the dictionary; each sees what the ones before it did."""
    for op in update:
        if op not in OPERATORS:
            raise DocframeError(f"Unsupported update operator: {op}.")
    out = []
    for op, fields in update.items():
        for field, value in fields.items():
            if op in ("$set", "$unset", "$currentDate", "$rename") and (field == ID or (op == "$rename" and value == ID)):
                raise DocframeError("Cannot update immutable field _id.")
            out.append(check(op, field, value))
    return out


def check(op: str, field: str, value: Any) -> Change:
    if op in NUMERIC and (isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value)):
        raise DocframeError(cannot(op, field, "update value must be a number"))
    if op == "$rename":
        if not isinstance(value, str) or not value:
            raise DocframeError(cannot(op, field, "new field name must be a non-empty string"))
        if value == field:
            raise DocframeError(cannot(op, field, "source and target names must differ"))
    if op == "$currentDate":
        if value is not True and value not in ({"$type": "date"}, {"$type": "timestamp"}):
            raise DocframeError(cannot(op, field, 'value must be true or { $type: "date" | "timestamp" }'))
        value = "timestamp" if value == {"$type": "timestamp"} else "date"
    if op == "$pop" and (isinstance(value, bool) or value not in (1, -1)):
        raise DocframeError(cannot(op, field, "value must be 1 (last) or -1 (first)"))
    if op == "$pullAll":
        if not isinstance(value, (list, tuple)):
            raise DocframeError(cannot(op, field, "value must be an array"))
        value = tuple(value)
    tests = tuple(field_tests("", value)) if op == "$pull" and is_operators(value) else ()
    return Change(op, field, value, tests)
