"""Queries: truth tables, rejections, and the Spark lowering against the plain evaluator."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docframe import cursor, sort
from docframe.errors import DocframeError
from docframe.missing import MISSING
from docframe.operators import frames
from docframe.query.compile import compile_query
from docframe.query.evaluate import equal, matches
from docframe.query.regex import literal_prefix, to_java

ADA = {"name": "Ada", "age": 37, "role": "admin", "active": True}
TYPED = {"str": "hello", "num": 42, "bool": True, "nul": None, "arr": [1, 2, 3], "obj": {"nested": 1}}


@pytest.mark.parametrize(
    "query, expected",
    [
        ({}, True), (None, True), ({"name": "Ada"}, True), ({"age": "37"}, False), ({"age": {"$gt": 36}}, True), ({"age": {"$gte": 37, "$lt": 38}}, True),
        ({"name": {"$gt": "Aba"}}, True), ({"name": {"$gt": 1}}, False), ({"age": {"$gte": None}}, False), ({"gone": {"$ne": 1}}, True), ({"gone": None}, False),
        ({"gone": {"$nin": [None]}}, True), ({"role": {"$in": []}}, False), ({"role": {"$nin": []}}, True), ({"role": {"$exists": True}}, True), ({"gone": {"$exists": False}}, True),
        ({"name": {"$regex": "^a", "$options": "i"}}, True), ({"name": re.compile("^A")}, True), ({"age": {"$regex": "3"}}, False), ({"age": {"$not": {"$gt": 40, "$lt": 50}}}, True),
        ({"age": {"$not": {"$not": {"$gt": 36}}}}, True), ({"$or": []}, False), ({"$nor": []}, True), ({"$and": []}, True), ({"$or": [{"age": 1}, {"role": "admin"}]}, True),
        ({"$nor": [{"age": 37}]}, False), ({"active": 1}, False), ({"active": True}, True),
    ],
)
def test_truth_table(query, expected):
    assert matches(ADA, query) is expected


@pytest.mark.parametrize("field, name", [("str", "string"), ("num", "number"), ("bool", "bool"), ("bool", "boolean"), ("nul", "null"), ("arr", "array"), ("obj", "object")])
def test_types(field, name):
    assert matches(TYPED, {field: {"$type": name}}) and not matches(TYPED, {"gone": {"$type": name}})
    assert matches(TYPED, {field: {"$type": ["null", name]}})


@pytest.mark.parametrize(
    "query, text",
    [
        ({"a": {"$foo": 1}}, "Unsupported query operator: $foo."), ({"$foo": 1}, "Unsupported query operator: $foo."), ({"a": {"$gt": 1, "b": 2}}, "Unsupported query operator: b."),
        ({"$or": {}}, "$or must be an array of queries."), ({"a": {"$in": 1}}, "$in must be an array."), ({"a": {"$nin": "x"}}, "$nin must be an array."),
        ({"a": {"$exists": 1}}, "$exists must be a boolean."), ({"a": {"$options": "i"}}, "$options requires a $regex operator."), ({"a": {"$not": 1}}, "$not requires an operator expression object."),
        ({"a": {"$not": {}}}, "$not requires at least one operator."), ({"a": {"$type": []}}, "$type must specify at least one type."), ({"a": {"$type": 1}}, "$type must be a type name string or an array of them."),
        ({"a": {"$type": "int"}}, 'Unsupported $type name "int". Allowed: null, boolean (bool), number, string, array, object.'), ({"a": {"$regex": 1}}, "$regex must be a string or a RegExp."),
        ({"a": {"$regex": "a", "$options": "g"}}, 'Unsupported $regex flag "g". Allowed flags: i, m, s, u.'), ({"a": {"$regex": "a", "$options": 1}}, "$options must be a string of regex flags."),
        ({"a": {"$regex": re.compile("a"), "$options": "i"}}, "$options cannot be combined with a RegExp $regex value; set flags on the RegExp instead."), ({"a": {"$where": "x"}}, "Unsupported query operator: $where."),
    ],
)
def test_rejections(query, text):
    with pytest.raises(DocframeError, match=re.escape(text)):
        compile_query(query)


def test_invalid_pattern():
    with pytest.raises(DocframeError, match="Invalid \\$regex pattern"):
        compile_query({"a": {"$regex": "("}})


def test_equality():
    assert equal(0, -0.0) and not equal(1, True) and not equal(float("nan"), float("nan")) and not equal(None, MISSING)
    assert equal({"a": [1.0, 2]}, {"a": [1, 2]}) and not equal([1, 2], [2, 1]) and equal({"a": 1, "b": 2}, {"b": 2, "a": 1})


def test_patterns_for_java():
    assert to_java("a$") == r"a\z" and to_java("a$", "m") == "(?m)a$" and to_java("[^]/\\/[]", "i") == r"(?iu)[\s\S]//(?!)"
    assert literal_prefix("^abc.*") == "abc" and literal_prefix("^abc*") == "ab" and literal_prefix("abc") == "" and literal_prefix("^a|b") == "" and literal_prefix("^a", "i") == ""


VALUES = [0, 1, -1, 2.5, 1e20, 37, "", "a", "B", "b\n", "é", "x1", True, False, None, [], [1], [1, "a"], ["a"], {}, {"k": 1}, {"k": None}, {"k": [1]}]


def random_query(rng, depth=0):
    field = rng.choice(["f", "g", "h"])
    v = lambda: rng.choice(VALUES)
    if depth < 2 and rng.random() < 0.35:
        return {rng.choice(["$and", "$or", "$nor"]): [random_query(rng, depth + 1) for _ in range(rng.randint(0, 3))]}

    def ops(level=0):
        out = {}
        for _ in range(rng.randint(1, 2)):
            op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$type", "$not"])
            if op == "$not":
                out[op] = ops(level + 1) if level < 2 else {"$eq": v()}
            elif op in ("$in", "$nin"):
                out[op] = [v() for _ in range(rng.randint(0, 3))]
            elif op == "$exists":
                out[op] = rng.random() < 0.5
            elif op == "$regex":
                out[op] = rng.choice(["^a", "b$", "[a-z]", "1", "."])
            elif op == "$type":
                out[op] = rng.sample(["null", "bool", "number", "string", "array", "object"], rng.randint(1, 2))
            else:
                out[op] = v()
        return out

    return {field: ops() if rng.random() < 0.8 else v()}


def evaluated(df, queries, **options):
    """Ids matched by each query, in one pass."""
    out = df.select("_id")
    for i, q in enumerate(queries):
        df = frames.matching(df, q, f"m{i}", **options)
    out = df.select("_id", *(f"m{i}" for i in range(len(queries)))).collect()
    return [{r["_id"] for r in out if r[f"m{i}"]} for i in range(len(queries))]


def test_variant_lowering_equals_the_evaluator(spark):
    rng = random.Random(1)
    docs = [{k: rng.choice(VALUES) for k in ("f", "g", "h") if rng.random() < 0.8} for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "_id int, j string").select("_id", F.parse_json("j").alias("doc"))
    queries = [random_query(rng) for _ in range(60)]
    for lo in range(0, 60, 20):
        some = queries[lo : lo + 20]
        for q, got in zip(some, evaluated(df, some, doc_column="doc", string_order="binary")):
            assert got == {i for i, d in enumerate(docs) if matches(d, q)}, q


@pytest.mark.parametrize("null_means", ["missing", "null"])
def test_typed_lowering_equals_the_evaluator(spark, null_means):
    rng = random.Random(2)
    pools = {"f": [0.0, 1.0, 2.5, float("nan"), None], "g": ["a", "B", "x1", "", None], "h": [[1], [1, 2], [], None]}
    rows = [(i, *(rng.choice(pools[k]) for k in "fgh")) for i in range(100)]
    df = spark.createDataFrame(rows, "_id int, f double, g string, h array<int>")
    docs = [{k: v for k, v in zip("fgh", r[1:]) if v is not None or null_means == "null"} for r in rows]
    queries = [random_query(rng) for _ in range(60)]
    for lo in range(0, 60, 20):
        some = queries[lo : lo + 20]
        for q, got in zip(some, evaluated(df, some, null_means=null_means, string_order="binary")):
            assert got == {i for i, d in enumerate(docs) if matches(d, q)}, (q, null_means)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "query, pushed",
    [
        ({"l_quantity": {"$gt": 45}}, "GreaterThan(l_quantity,45.0)"), ({"l_returnflag": {"$ne": "R"}}, "Not(EqualNullSafe(l_returnflag,R))"),
        ({"l_returnflag": {"$in": ["R", "A"]}}, "In(l_returnflag, [A,R])"), ({"$or": [{"l_returnflag": "R"}, {"l_linenumber": {"$lt": 2}}]}, "Or(EqualTo(l_returnflag,R),LessThan(l_linenumber,2))"),
        ({"l_linenumber": {"$not": {"$gt": 2}}}, "Or(IsNull(l_linenumber),LessThanOrEqual(l_linenumber,2))"), ({"l_returnflag": {"$regex": "^R"}}, "StringStartsWith(l_returnflag,R)"),
    ],
)
def test_conditions_reach_the_scan(spark, query, pushed):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert pushed in plan(frames.find(df, query).to_df().select("l_orderkey"))


def test_sorted_slice_is_one_top_k(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(frames.find(df).sort({"l_extendedprice": -1}).skip(5).limit(10).to_df())
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("skip", [10, 5000])
def test_a_skip_without_limit_does_not_send_all_rows_through_one_task(spark, monkeypatch, skip):
    monkeypatch.setattr(sort, "TOP", 100)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = frames.find(df).sort({"l_orderkey": -1, "l_linenumber": 1}).skip(skip).to_df()
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(tuple, df.collect()), key=lambda r: (-r[0], r[1]))[skip:]
    assert sum(parts) == len(got) and max(parts) < len(got) / 2


@pytest.mark.parametrize("top", [0, 10_000])
@pytest.mark.parametrize("dealt", [False, True])
def test_skips_among_missing_and_equal_keys(spark, monkeypatch, top, dealt):
    monkeypatch.setattr(sort, "TOP", top)
    monkeypatch.setattr(cursor, "TOP", top)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "B", "", None]), rng.choice([-1.0, -0.0, 0.0, 2.5, float("nan"), None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "f string, g double, place int").repartition(5)
    if dealt:
        df = df.repartitionByRange(7, F.col("f").desc_nulls_last(), F.col("g").asc_nulls_first(), F.col("place"))

    def place(f, g):
        missing = g is None or g != g
        return f is None, [-ord(c) for c in f or ""] + [1], not missing, 0 if missing else g

    want = sorted(place(f, g) for f, g, _ in rows)
    for skip in (37, 150, 200, 300):
        out = frames.find(df).sort({"f": -1, "g": 1}).skip(skip).to_df().collect()
        assert [place(r["f"], r["g"]) for r in out] == want[skip:], skip
        assert len({r["place"] for r in out}) == len(out) and all(set(r.asDict()) == {"f", "g", "place"} for r in out)
        assert [place(r["f"], r["g"]) for r in frames.find(df).sort({"f": -1, "g": 1}).skip(skip).limit(20).to_df().collect()] == want[skip : skip + 20]
    assert [r["f"] for r in frames.find(df).sort({"f": 1}).skip(90).to_df().collect()] == sorted((f for f, _, _ in rows), key=lambda f: (f is not None, f or ""))[90:]
    assert frames.find(df.limit(0)).sort({"f": 1}).skip(3).to_df().collect() == []


def test_white_space_and_ampersands_mean_the_same_in_both_dialects(spark):
    values = ["a\u00a0b", "a b", "a\ufeffb", "a&b", "ab", "a\x1cb"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for pattern in (r"a\sb", r"a\Sb", r"a[\s]b", r"[a&&b]{3}"):
        got = {r["v"] for r in frames.find(df, {"v": {"$regex": pattern}}).to_df().collect()}
        assert got == {v for v in values if matches({"v": v}, {"v": {"$regex": pattern}})}, pattern
    for pattern in ("a++b", "(?>a)"):
        with pytest.raises(DocframeError):
            frames.find(df, {"v": {"$regex": pattern}}).to_df()
