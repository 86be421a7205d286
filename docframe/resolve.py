"""Fields of a DataFrame as JSON values: typed columns, or paths into a VARIANT column.

``resolver.field(name)`` gives an object with ``test(op, value, positive)``, the column (or
known boolean) that is TRUE where the test holds, or where it fails with ``positive=False``.
"""

from __future__ import annotations

import datetime
import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import DocframeError
from docframe.query.ast import Regex
from docframe.query.evaluate import canonical, json_type
from docframe.query.regex import literal_prefix, to_java

LOCALE = "UNICODE"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "object"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def value_kind(value: Any) -> str:
    return "time" if isinstance(value, (datetime.date, datetime.datetime)) else json_type(value)


def conforms(value: Any, data_type: T.DataType) -> bool:
    """Whether a literal can equal a value of ``data_type`` at all."""
    if value is None:
        return True
    kind = kind_of(data_type)
    if kind != value_kind(value):
        return False
    if isinstance(data_type, T.ArrayType):
        return all(conforms(v, data_type.elementType) for v in value)
    if isinstance(data_type, T.StructType):
        return set(value) <= set(data_type.names) and all(conforms(value.get(f.name), f.dataType) for f in data_type)
    if isinstance(data_type, T.MapType):
        return all(conforms(v, data_type.valueType) for v in value.values())
    if isinstance(data_type, T.IntegralType):
        return float(value).is_integer() if not isinstance(value, int) else True
    return True


def same(value: Column, wanted: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.MapType):
        order = lambda m: F.array_sort(F.map_entries(m))
        return order(value) == order(wanted)
    return value == wanted


def literal(value: Any, data_type: T.DataType) -> Column:
    if kind_of(data_type) in ("array", "object"):
        return F.from_json(F.lit(json.dumps(value)), data_type)
    return F.lit(value)


class TypedField:
    """A typed column; SQL NULL means that the field is missing, or null if so declared."""

    def __init__(self, value: Column | None, data_type: T.DataType | None, null_is_value: bool, string_order: str):
        self.value, self.type = value, data_type
        self.null_is_value, self.string_order = null_is_value, string_order
        self.kind = kind_of(data_type) if data_type is not None else "missing"
        self.has_nan = isinstance(data_type, (T.DoubleType, T.FloatType))

    def test(self, op: str, wanted: Any, positive: bool) -> Column | bool:
        if self.value is None:
            return (wanted is False) == positive if op == "exists" else not positive
        return getattr(self, f"_{op}" if op in ("exists", "regex", "type", "in", "eq") else "_range")(wanted, positive, *([op] if op in ("gt", "gte", "lt", "lte") else []))

    def _exists(self, wanted: bool, positive: bool):
        wanted = wanted == positive
        if self.null_is_value:
            return wanted
        return self.value.isNotNull() if wanted else self.value.isNull()

    def _eq(self, wanted: Any, positive: bool):
        if wanted is None:
            if not self.null_is_value:
                return not positive
            return self.value.isNull() if positive else self.value.isNotNull()
        if not conforms(wanted, self.type) or (isinstance(wanted, float) and math.isnan(wanted)):
            return not positive
        target = literal(wanted, self.type)
        if isinstance(self.type, T.MapType):
            found = same(self.value, target, self.type)
            return found if positive else self.value.isNull() | ~found
        return self.value == target if positive else ~self.value.eqNullSafe(target)

    def _in(self, wanted: tuple, positive: bool):
        if self.kind in ("array", "object"):
            parts = [self._eq(w, positive) for w in wanted]
            known = [p for p in parts if isinstance(p, bool)]
            if positive in known:
                if positive:
                    return True
            columns = [p for p in parts if not isinstance(p, bool)]
            if not positive and False in known:
                return False
            if not columns:
                return not positive
            out = columns[0]
            for c in columns[1:]:
                out = out | c if positive else out & c
            return out
        values = [w for w in wanted if w is not None and conforms(w, self.type) and not (isinstance(w, float) and math.isnan(w))]
        null = self.null_is_value and any(w is None for w in wanted)
        if not values:
            return self._eq(None, positive) if null else not positive
        inside = self.value.isin(*values)
        if positive:
            return inside | self.value.isNull() if null else inside
        return self.value.isNotNull() & ~inside if null else self.value.isNull() | ~inside

    def _range(self, wanted: Any, positive: bool, op: str):
        if self.kind != value_kind(wanted) or self.kind not in ("number", "string", "time") or (isinstance(wanted, float) and math.isnan(wanted)):
            return not positive
        value = F.collate(self.value, LOCALE) if self.kind == "string" and self.string_order == "locale" else self.value
        target = F.lit(wanted)
        found = {"gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target}[op]
        nan = self.has_nan and op in ("gt", "gte")  # Spark's NaN exceeds all numbers; here it compares with none
        if positive:
            return found & ~F.isnan(self.value) if nan else found
        lost = self.value.isNull() | ~found
        return lost | F.isnan(self.value) if nan else lost

    def _regex(self, wanted: Regex, positive: bool):
        if self.kind != "string":
            return not positive
        found = self.value.rlike(to_java(wanted.pattern, wanted.flags))
        if not positive:
            return self.value.isNull() | ~found
        begin = literal_prefix(wanted.pattern, wanted.flags)
        return self.value.startswith(begin) & found if begin else found

    def _type(self, names: tuple, positive: bool):
        if self.null_is_value and "null" in names:
            if self.kind in names:
                return positive
            return self.value.isNull() if positive else self.value.isNotNull()
        if self.kind not in names:
            return not positive
        return self.value.isNotNull() if positive else self.value.isNull()

    def sort_keys(self, name: str) -> list[Column]:
        if self.value is None:
            return []
        if self.kind in ("array", "object"):
            raise DocframeError(f"Cannot sort on {self.kind} values: {self.kind} sort is not supported.")
        return [F.nanvl(self.value, F.lit(None).cast(self.type)) if self.has_nan else self.value]

    def distinct_key(self) -> Column | None:
        if self.value is None:
            return None
        return F.array_sort(F.map_entries(self.value)) if isinstance(self.type, T.MapType) else self.value


class TypedResolver:
    """Top-level columns of ``df``; names are literal, never paths."""

    def __init__(self, schema: T.StructType, null_means: str = "missing", string_order: str = "locale"):
        if null_means not in ("missing", "null") or string_order not in ("locale", "binary"):
            raise DocframeError("null_means is missing or null; string_order is locale or binary.")
        self.types = {f.name: f.dataType for f in schema}
        self.null_is_value, self.string_order = null_means == "null", string_order

    def field(self, name: str) -> TypedField:
        data_type = self.types.get(name)
        value = F.col("`" + name.replace("`", "``") + "`") if data_type is not None else None
        return TypedField(value, data_type, self.null_is_value, self.string_order)


# -- VARIANT ----------------------------------------------------------------------------------


def path_of(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


class VariantValue:
    """A variant expression; SQL NULL means missing, a variant null is JSON null."""

    def __init__(self, value: Column, string_order: str = "locale"):
        self.value, self.string_order = value, string_order
        self.schema = F.schema_of_variant(value)

    def is_kind(self, kind: str) -> Column:
        if kind == "number":
            return self.schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        return {"null": self.schema == "VOID", "boolean": self.schema == "BOOLEAN", "string": self.schema == "STRING",
                "array": self.schema.startswith("ARRAY<"), "object": self.schema.startswith("OBJECT<")}[kind]

    def as_kind(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", {"number": "double", "string": "string", "boolean": "boolean"}[kind])

    def key(self) -> Column:
        """Text that is equal exactly for equal values."""
        return F.when(self.is_kind("number"), number_key(self.as_kind("number"))).otherwise(F.to_json(self.value))

    def equals(self, wanted: Any) -> Column | bool:
        kind = json_type(wanted)
        if kind == "null":
            return self.is_kind("null")
        if isinstance(wanted, float) and math.isnan(wanted):
            return False
        if kind in ("array", "object"):
            return self.is_kind(kind) & (F.to_json(self.value) == F.to_json(F.parse_json(F.lit(canonical(wanted)))))
        return self.is_kind(kind) & (self.as_kind(kind) == F.lit(float(wanted) if kind == "number" else wanted))

    def test(self, op: str, wanted: Any, positive: bool) -> Column | bool:
        found = self._test(op, wanted)
        if isinstance(found, bool):
            return found == positive
        return found if positive else ~F.coalesce(found, F.lit(False))

    def _test(self, op: str, wanted: Any) -> Column | bool:
        if op == "eq":
            return self.equals(wanted)
        if op == "in":
            parts = [p for p in map(self.equals, wanted) if not isinstance(p, bool)]
            out = None
            for p in parts:
                p = F.coalesce(p, F.lit(False))
                out = p if out is None else out | p
            return False if out is None else out
        if op == "exists":
            return self.value.isNotNull() if wanted else self.value.isNull()
        if op == "regex":
            return self.is_kind("string") & self.as_kind("string").rlike(to_java(wanted.pattern, wanted.flags))
        if op == "type":
            out = self.is_kind(wanted[0])
            for name in wanted[1:]:
                out = out | self.is_kind(name)
            return out
        kind = json_type(wanted)
        if kind not in ("number", "string") or (isinstance(wanted, float) and math.isnan(wanted)):
            return False
        value = self.as_kind(kind)
        if kind == "string" and self.string_order == "locale":
            value = F.collate(value, LOCALE)
        target = F.lit(float(wanted) if kind == "number" else wanted)
        return self.is_kind(kind) & {"gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target}[op]

    def sort_keys(self, name: str) -> list[Column]:
        def refuse(kind: str) -> Column:
            return F.raise_error(F.lit(f"Cannot sort on {kind} values: {kind} sort is not supported.")).cast("int")

        rank = F.when(self.is_kind("boolean"), 1).when(self.is_kind("number"), 2).when(self.is_kind("string"), 3).when(self.is_kind("array"), refuse("array")).when(self.is_kind("object"), refuse("object"))
        number = F.when(self.is_kind("number"), self.as_kind("number")).when(self.is_kind("boolean"), self.as_kind("boolean").cast("double"))
        return [rank, number, F.when(self.is_kind("string"), self.as_kind("string"))]

    def distinct_key(self) -> Column:
        return self.key()


def number_key(number: Column) -> Column:
    """Text of a double, the same however the number was written."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


class VariantResolver:
    """Top-level fields of a VARIANT column."""

    def __init__(self, column: str = "doc", string_order: str = "locale"):
        self.column, self.string_order = column, string_order

    def field(self, name: str) -> VariantValue:
        return VariantValue(F.try_variant_get(F.col(self.column), path_of(name), "variant"), self.string_order)


def resolver_for(df: DataFrame, doc_column: str | None = None, null_means: str = "missing", string_order: str = "locale"):
    return VariantResolver(doc_column, string_order) if doc_column else TypedResolver(df.schema, null_means, string_order)
