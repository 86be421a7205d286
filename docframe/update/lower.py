"""Updates as Spark columns: every row that matches gets new values, all others keep theirs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import DocframeError
from docframe.query.ast import Not
from docframe.query.compile import compile_query
from docframe.query.evaluate import canonical
from docframe.query.lower import all_of, any_of, column
from docframe.resolve import TypedField, VariantValue, conforms, kind_of, literal, resolver_for
from docframe.update.compile import ARRAYS, NUMERIC, cannot, compile_update

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def now_of(kind: str) -> Column:
    if kind == "timestamp":
        return F.unix_millis(F.current_timestamp())
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), ISO)


def element_test(field, tests: tuple, positive: bool = True):
    """The tests of a ``$pull`` on an array's element."""
    parts = []
    for t in tests:
        if isinstance(t, Not):
            parts.append(element_test(field, t.tests, not positive))
        else:
            flip = t.op in ("ne", "nin")
            parts.append(field.test({"ne": "eq", "nin": "in"}.get(t.op, t.op), t.value, positive != flip))
    return all_of(parts) if positive else any_of(parts)


def without(value: Column, element, c) -> Column:
    """The array without the elements that a ``$pull`` or ``$pullAll`` names."""

    def keep(x: Column) -> Column:
        field = element(x)
        if c.tests:
            found = element_test(field, c.tests)
        elif c.op == "$pull":
            found = field.test("eq", c.value, True)
        else:
            found = field.test("in", c.value, True)
        if isinstance(found, bool):
            return F.lit(not found)
        return ~F.coalesce(found, F.lit(False))

    return F.filter(value, keep)


# -- typed columns ----------------------------------------------------------------------------


def typed_update(df: DataFrame, changes: list, matched: Column, null_means: str) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    now: dict[str, Column | None] = {n: F.col("`" + n.replace("`", "``") + "`") for n in types}
    original = dict(now)
    first_types = dict(types)
    null_is_value = null_means == "null"

    def guarded(c, kind: str) -> Column:
        value = now.get(c.field)
        if value is None or kind_of(types[c.field]) != kind:
            raise DocframeError(cannot(c.op, c.field, f"expected an existing {kind} field"))
        error = F.raise_error(F.lit(cannot(c.op, c.field, f"expected an existing {kind} field"))).cast(types[c.field])
        return F.when(value.isNull(), error).otherwise(value)

    for c in changes:
        if c.op in NUMERIC:
            old, v = guarded(c, "number"), F.lit(c.value)
            wide = T.DoubleType() if isinstance(c.value, float) and not c.value.is_integer() and isinstance(types[c.field], T.IntegralType) else types[c.field]
            new = {"$min": F.when(v < old, v).otherwise(old), "$max": F.when(v > old, v).otherwise(old), "$inc": old + v, "$mul": old * v}[c.op]
            now[c.field], types[c.field] = new.cast(wide), wide
        elif c.op in ARRAYS:
            old, data_type = guarded(c, "array"), types[c.field]
            inner = data_type.elementType
            element = lambda x, t=inner: TypedField(x, t, True, "locale")  # noqa: E731  an element is always present
            if c.op in ("$push", "$addToSet"):
                if not conforms(c.value, inner):
                    raise DocframeError(cannot(c.op, c.field, "the column's elements have another type"))
                item = literal(c.value, inner).cast(inner)
                new = F.array_append(old, item)
                if c.op == "$addToSet":
                    same = element_equal(element, c.value)
                    new = F.when(F.exists(old, same), old).otherwise(new)
            elif c.op == "$pop":
                rest = F.greatest(F.size(old) - 1, F.lit(0))
                new = F.slice(old, F.lit(1) if c.value == 1 else F.lit(2), rest)
            else:
                new = without(old, element, c)
            now[c.field] = new
        elif c.op == "$set":
            known = types.get(c.field)
            if known is not None and not conforms(c.value, known):
                raise DocframeError(cannot(c.op, c.field, "the column has another type"))
            if known is None:
                types[c.field] = known = type_of(c.value)
            now[c.field] = literal(c.value, known).cast(known)
        elif c.op == "$unset":
            if c.field in types:
                now[c.field] = F.lit(None).cast(types[c.field])
        elif c.op == "$currentDate":
            new = now_of(c.value)
            types.setdefault(c.field, T.LongType() if c.value == "timestamp" else T.StringType())
            now[c.field] = new.cast(types[c.field])
        elif c.op == "$rename" and now.get(c.field) is not None:
            source, target = now[c.field], now.get(c.value)
            if null_is_value:
                moved = source
            else:
                moved = F.when(source.isNotNull(), source).otherwise(target) if target is not None else source
            if target is not None and types[c.value] != types[c.field]:
                raise DocframeError(cannot(c.op, c.field, "the target column has another type"))
            types[c.value] = types[c.field]
            now[c.value], now[c.field] = moved, F.lit(None).cast(types[c.field])
    out = []
    for name, value in now.items():
        old = original.get(name)
        if old is value:
            out.append(old.alias(name))
            continue
        if old is None:
            old = F.lit(None).cast(types[name])
        elif first_types[name] != types[name]:
            old = old.cast(types[name])
        out.append(F.when(matched, value).otherwise(old).alias(name))
    return df.select(*out)


def element_equal(element, value: Any):
    def same(x: Column) -> Column:
        found = element(x).test("eq", value, True)
        return F.lit(found) if isinstance(found, bool) else F.coalesce(found, F.lit(False))

    return same


def type_of(value: Any) -> T.DataType:
    """Column type for a field that the table does not have yet."""
    if value is None:
        return T.StringType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (list, tuple)):
        return T.ArrayType(type_of(value[0]) if value else T.StringType())
    return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])


# -- VARIANT ----------------------------------------------------------------------------------


def variant(value: Any) -> Column:
    return F.parse_json(F.lit(canonical(value)))


def other_keys(*names: str):
    """Filter of a map's entries that leaves out ``names``."""
    return lambda key, _: ~key.isin(*names)


def bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` planned and computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def variant_update(doc: Column, changes: list) -> Column:
    """The changed document: fields as a map of variants, edited, and made one object again.

    Every step is bound before the next one, so the plan grows with the number of operators;
    consecutive operators that set values of different fields are one step.
    """
    steps: list[list] = []
    for c in changes:
        alone = c.op in ("$unset", "$rename")
        if alone or not steps or steps[-1][0].op in ("$unset", "$rename") or c.field in {x.field for x in steps[-1]}:
            steps.append([])
        steps[-1].append(c)

    def run(fields: Column, rest: list[list]) -> Column:
        if not rest:
            return F.to_variant_object(fields)
        return bound(changed(fields, rest[0]), lambda m: run(m, rest[1:]))

    return bound(doc.cast("map<string,variant>"), lambda m: run(m, steps))


def changed(fields: Column, step: list) -> Column:
    """The fields after one step."""
    c, names = step[0], [c.field for c in step]
    old = F.try_element_at(fields, F.lit(c.field))
    if c.op == "$unset":
        return F.map_filter(fields, other_keys(c.field))
    if c.op == "$rename":
        rest = F.map_filter(fields, other_keys(c.field, c.value))
        return F.when(old.isNotNull(), F.map_concat(rest, F.create_map(F.lit(c.value), old))).otherwise(fields)
    entries = [x for c in step for x in (F.lit(c.field), value_after(F.try_element_at(fields, F.lit(c.field)), c))]
    return F.map_concat(F.map_filter(fields, other_keys(*names)), F.create_map(*entries))


def value_after(old: Column, c) -> Column:
    """A field's value after an operator that gives it one."""
    if c.op == "$set":
        return variant(c.value)
    if c.op == "$currentDate":
        return now_of(c.value).cast("variant")

    def guard(kind: str, old: Column, value: Column) -> Column:
        error = F.raise_error(F.lit(cannot(c.op, c.field, f"expected an existing {kind} field"))).cast("variant")
        return F.when(F.coalesce(VariantValue(old).is_kind(kind), F.lit(False)), value).otherwise(error)

    def number(old: Column) -> Column:
        v = F.lit(float(c.value))
        new = {"$min": F.least, "$max": F.greatest, "$inc": lambda a, b: a + b, "$mul": lambda a, b: a * b}[c.op](VariantValue(old).as_kind("number"), v)

        def written(x: Column) -> Column:
            whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
            return F.when(whole, x.cast("long").cast("variant")).otherwise(x.cast("variant"))

        return guard("number", old, bound(new, written))

    def array(old: Column) -> Column:
        def edited(items: Column) -> Column:
            if c.op == "$push":
                return F.array_append(items, variant(c.value))
            if c.op == "$addToSet":
                return F.when(F.exists(items, element_equal(VariantValue, c.value)), items).otherwise(F.array_append(items, variant(c.value)))
            if c.op == "$pop":
                return F.slice(items, F.lit(1) if c.value == 1 else F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
            return without(items, VariantValue, c)

        return guard("array", old, edited(old.cast("array<variant>")).cast("variant"))

    return bound(old, number if c.op in NUMERIC else array)


def apply_update(df: DataFrame, query: dict | None, update: dict, *, doc_column: str | None = None, null_means: str = "missing", string_order: str = "locale") -> DataFrame:
    """All rows of ``df``, with ``update`` applied to those that match ``query``.

    Data that an operator cannot be applied to raises when the rows are computed.
    """
    changes = compile_update(update)
    matched = F.coalesce(column(compile_query(query), resolver_for(df, doc_column, null_means, string_order)), F.lit(False))
    if doc_column:
        return df.withColumn(doc_column, F.when(matched, variant_update(F.col(doc_column), changes)).otherwise(F.col(doc_column)))
    return typed_update(df, changes, matched, null_means)
