"""Sources, streams, column functions and tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docframe.database import open_db
from docframe.functions.json import equality_key, field, type_of
from docframe.sources.documents import read_json, write_json
from docframe.streaming.feed import ingest
from docframe.table import Table

LINES = [{"v": 1}, {"v": "1"}, {"v": [1, {"a": None}]}, {"w": True}, {"v": None}]


def test_json_lines_keep_their_types(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, LINES)))
    docs = read_json(spark, str(tmp_path / "in.json"))
    write_json(docs, str(tmp_path / "out"))
    assert sorted(json.dumps(json.loads(r["value"])) for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(map(json.dumps, LINES))
    kinds = docs.select(type_of(field("doc", "v")).alias("k")).collect()
    assert sorted(str(r["k"]) for r in kinds) == ["None", "array", "null", "number", "string"]


def test_equality_keys(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("1e0",), ('"1"',), ("[1]",), ("true",)], "j string").select(equality_key(F.parse_json("j")).alias("k"))
    assert df.distinct().count() == 4


def test_stream_into_a_collection(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, LINES)))
    db = open_db(spark, str(tmp_path / "db"))
    stream = spark.readStream.text(str(tmp_path / "in")).select(F.col("value").alias("doc"))
    ingest(stream, db.collection("c"), str(tmp_path / "cp")).awaitTermination()
    assert db.collection("c").count_documents({"v": {"$exists": True}}) == 4
    db.close()


def test_table(spark):
    t = Table(spark.createDataFrame([(2, "b"), (1, "a"), (3, "b")], "k int, v string"), order_by=["k"])
    assert t.find_one() == {"k": 1, "v": "a"} and t.count_documents({"v": "b"}) == 2 and t.distinct("v") == ["a", "b"]
    assert [d["k"] for d in t.find({"v": "b"}).to_list()] == [2, 3]
