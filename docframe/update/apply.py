"""Updates of one document in plain Python; the oracle for the Spark lowering."""

from __future__ import annotations

import datetime
from typing import Any

from docframe.errors import DocframeError
from docframe.missing import MISSING
from docframe.query.ast import Not
from docframe.query.evaluate import equal, json_type, test
from docframe.update.compile import ARRAYS, ID, NUMERIC, cannot, compile_update


def holds(value: Any, tests: tuple) -> bool:
    return all(not holds(value, t.tests) if isinstance(t, Not) else test(value, t.op, t.value) for t in tests)


def update_document(document: dict, update: dict, now: datetime.datetime | None = None) -> dict:
    """A changed copy of ``document``."""
    out = dict(document)
    now = now or datetime.datetime.now(datetime.timezone.utc)
    for c in compile_update(update):
        old = out.get(c.field, MISSING)
        if c.op in NUMERIC and (old is MISSING or json_type(old) != "number"):
            raise DocframeError(cannot(c.op, c.field, "expected an existing number field"))
        if c.op in ARRAYS and (old is MISSING or json_type(old) != "array"):
            raise DocframeError(cannot(c.op, c.field, "expected an existing array field"))
        if c.op == "$unset":
            out.pop(c.field, None)
        elif c.op == "$rename":
            if old is not MISSING:
                del out[c.field]
                out[c.value] = old
        else:
            out[c.field] = changed(c, old, now)
    if ID in document:
        out[ID] = document[ID]
    return out


def changed(c, old: Any, now: datetime.datetime) -> Any:
    if c.op == "$set":
        return c.value
    if c.op == "$min":
        return min(old, c.value)
    if c.op == "$max":
        return max(old, c.value)
    if c.op == "$inc":
        return old + c.value
    if c.op == "$mul":
        return old * c.value
    if c.op == "$currentDate":
        if c.value == "timestamp":
            return int(now.timestamp() * 1000)
        return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"
    if c.op == "$push":
        return [*old, c.value]
    if c.op == "$addToSet":
        return list(old) if any(equal(x, c.value) for x in old) else [*old, c.value]
    if c.op == "$pop":
        return list(old[:-1] if c.value == 1 else old[1:])
    if c.op == "$pull":
        return [x for x in old if not (holds(x, c.tests) if c.tests else equal(x, c.value))]
    return [x for x in old if not any(equal(x, v) for v in c.value)]
