"""One document against a query, in plain Python.

The oracle for the Spark lowering, and the API for single documents.
"""

from __future__ import annotations

import json
import math
from typing import Any

from docframe.missing import MISSING
from docframe.query.ast import And, Nor, Not, Or
from docframe.query.compile import compile_query
from docframe.query.regex import to_python


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, (list, tuple)) else "object"


def plain(value: Any) -> Any:
    """Inside arrays and objects: NaN and infinities are null, integral floats are integers."""
    if isinstance(value, float):
        return None if math.isnan(value) or math.isinf(value) else int(value) if value.is_integer() else value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not MISSING}
    return value


def canonical(value: Any) -> str:
    """A text equal for equal values and different for different ones; key order is ignored."""
    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def equal(a: Any, b: Any) -> bool:
    """Deep equality without coercion; NaN equals nothing."""
    if a is MISSING or b is MISSING:
        return False
    kind = json_type(a)
    if kind != json_type(b):
        return False
    return canonical(a) == canonical(b) if kind in ("array", "object") else a == b


def collation_key(text: str) -> tuple:
    """Approximates locale order: letters first without case, lower case before upper."""
    return text.casefold(), text.swapcase()


def compare(a: Any, b: Any, op: str, string_order: str = "binary") -> bool:
    kind = json_type(a)
    if a is MISSING or kind != json_type(b) or kind not in ("number", "string"):
        return False
    if kind == "string" and string_order != "binary":
        a, b = collation_key(a), collation_key(b)
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def test(value: Any, op: str, wanted: Any) -> bool:
    if op == "eq":
        return equal(value, wanted)
    if op == "ne":
        return not equal(value, wanted)
    if op in ("gt", "gte", "lt", "lte"):
        return compare(value, wanted, op)
    if op == "in":
        return any(equal(value, w) for w in wanted)
    if op == "nin":
        return not any(equal(value, w) for w in wanted)
    if op == "exists":
        return (value is not MISSING) == wanted
    if op == "regex":
        return isinstance(value, str) and to_python(wanted.pattern, wanted.flags).search(value) is not None
    return value is not MISSING and json_type(value) in wanted


def evaluate(document: dict, node) -> bool:
    if isinstance(node, And):
        return all(evaluate(document, p) for p in node.parts)
    if isinstance(node, Or):
        return any(evaluate(document, p) for p in node.parts)
    if isinstance(node, Nor):
        return not any(evaluate(document, p) for p in node.parts)
    if isinstance(node, Not):
        return not all(evaluate(document, p) for p in node.tests)
    return test(document.get(node.field, MISSING), node.op, node.value)


def matches(document: dict, query: dict | None) -> bool:
    """Whether ``document`` matches ``query``."""
    return evaluate(document, compile_query(query))
