"""Updates: operators one by one, rejections, and both lowerings against the plain version."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from docframe.errors import DocframeError
from docframe.update.apply import update_document
from docframe.update.compile import compile_update
from docframe.update.lower import apply_update

CASES = [
    {"$set": {"n": 5, "new": [1, {"a": None}]}}, {"$unset": {"s": 1, "gone": 1}}, {"$min": {"n": 3}}, {"$max": {"n": 30}}, {"$inc": {"n": 2}}, {"$mul": {"n": -2}}, {"$rename": {"s": "t"}},
    {"$rename": {"gone": "t"}}, {"$rename": {"s": "n"}}, {"$push": {"a": 9}}, {"$addToSet": {"a": 1}}, {"$addToSet": {"a": 7}}, {"$pop": {"a": 1}}, {"$pop": {"a": -1}}, {"$pull": {"a": 1}},
    {"$pull": {"a": {"$gte": 2, "$ne": 3}}}, {"$pull": {"a": {"$in": [1, 3], "$not": {"$gt": 2}}}}, {"$pullAll": {"a": [1, 2, "x"]}}, {"$inc": {"n": 1}, "$mul": {"n": 10}, "$set": {"s": "q"}},
]
DOC = {"n": 10, "s": "x", "a": [1, 2, 3, 1]}


@pytest.mark.parametrize("update", CASES, ids=lambda u: json.dumps(u))
def test_variant_update_equals_the_plain_one(spark, update):
    df = spark.range(1).select(F.parse_json(F.lit(json.dumps(DOC))).alias("doc"))
    got = apply_update(df, {}, update, doc_column="doc").select(F.to_json("doc")).first()[0]
    assert json.loads(got) == update_document(DOC, update)


@pytest.mark.parametrize("update", [u for u in CASES if u not in (CASES[0], CASES[8])], ids=lambda u: json.dumps(u))
def test_typed_update_equals_the_plain_one(spark, update):
    df = spark.createDataFrame([(1, 10, "x", [1, 2, 3, 1]), (2, 10, "x", [5])], "k int, n int, s string, a array<int>")
    got = {r["k"]: r.asDict() for r in apply_update(df, {"k": 1}, update).collect()}
    want = update_document({"k": 1, **DOC}, update)
    assert {k: v for k, v in got[1].items() if v is not None} == want
    assert {k: v for k, v in got[2].items() if v is not None} == {"k": 2, "n": 10, "s": "x", "a": [5]}


@pytest.mark.parametrize(
    "update, text",
    [
        ({"$bit": {"a": 1}}, "Unsupported update operator: $bit."), ({"$inc": {"n": "1"}}, 'Cannot apply $inc to "n": update value must be a number.'), ({"$inc": {"n": float("nan")}}, "update value must be a number"),
        ({"$rename": {"a": ""}}, "new field name must be a non-empty string"), ({"$rename": {"a": "a"}}, "source and target names must differ"), ({"$pop": {"a": 2}}, "value must be 1 (last) or -1 (first)"),
        ({"$pullAll": {"a": 1}}, "value must be an array"), ({"$currentDate": {"a": 1}}, 'value must be true or { $type: "date" | "timestamp" }'), ({"$set": {"_id": 1}}, "Cannot update immutable field _id."),
        ({"$rename": {"a": "_id"}}, "Cannot update immutable field _id."),
    ],
)
def test_rejections(update, text):
    with pytest.raises(DocframeError, match=re.escape(text)):
        compile_update(update)


@pytest.mark.parametrize("update, text", [({"$inc": {"s": 1}}, "expected an existing number field"), ({"$push": {"n": 1}}, "expected an existing array field"), ({"$pull": {"gone": 1}}, "expected an existing array field")])
def test_guards(spark, update, text):
    with pytest.raises(DocframeError, match=text):
        update_document(DOC, update)
    df = spark.range(1).select(F.parse_json(F.lit(json.dumps(DOC))).alias("doc"))
    with pytest.raises(Exception, match=text):
        apply_update(df, {}, update, doc_column="doc").select(F.to_json("doc")).collect()
    typed = spark.createDataFrame([(10, "x", [1])], "n int, s string, a array<int>")
    with pytest.raises(Exception, match=text):
        apply_update(typed, {}, update).collect()


def test_current_date(spark):
    df = spark.range(1).select(F.parse_json(F.lit("{}")).alias("doc"))
    got = json.loads(apply_update(df, {}, {"$currentDate": {"d": True, "t": {"$type": "timestamp"}}}, doc_column="doc").select(F.to_json("doc")).first()[0])
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", got["d"]) and got["t"] > 1_600_000_000_000
