"""Column functions for JSON values in VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.resolve import VariantValue, path_of

KINDS = ("null", "boolean", "number", "string", "array", "object")


def field(doc: str, name: str) -> Column:
    """A top-level field; NULL if it is missing.  The name is literal, never a path."""
    return F.try_variant_get(F.col(doc), path_of(name), "variant")


def type_of(value: Column) -> Column:
    """JSON type name of a VARIANT value, NULL if it is missing."""
    v = VariantValue(value)
    out = F.when(v.is_kind(KINDS[0]), KINDS[0])
    for kind in KINDS[1:]:
        out = out.when(v.is_kind(kind), kind)
    return out


def equality_key(value: Column) -> Column:
    """Text equal exactly for equal values, to group and join on."""
    return VariantValue(value).key()
