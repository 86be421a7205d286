"""The store: writes, uniqueness, snapshots, recovery, compaction, cache, codecs, import."""

from __future__ import annotations

import json
import struct
import time
import zlib

import pytest

from docframe.codecs import amf3, bson, legacy
from docframe.collection import side_column
from docframe.database import open_db
from docframe.errors import DocframeError
from docframe.objectid import check_id, new_id
from docframe.operators import frames
from docframe.sources.documents import import_framed
from docframe.store.cache import DocumentCache

PEOPLE = [{"name": "Ada", "age": 37, "role": "admin"}, {"name": "Grace", "age": 85, "role": "admin"}, {"name": "Margaret", "role": "reader"}]


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "db")


@pytest.fixture()
def db(spark, path):
    opened = open_db(spark, path)
    yield opened
    opened.close()


def names(cursor):
    return [d["name"] for d in cursor.to_list()]


def test_round_of_writes(spark, db, path):
    c = db.collection("people")
    got = c.insert_many(PEOPLE)
    assert got["insertedCount"] == 3 and all(check_id(i) for i in got["insertedIds"])
    assert names(c.find()) == ["Ada", "Grace", "Margaret"]
    assert c.update_many({"role": "admin"}, {"$inc": {"age": 1}}) == {"acknowledged": True, "matchedCount": 2, "modifiedCount": 2}
    assert [d.get("age") for d in c.find().to_list()] == [38, 86, None]
    assert c.update_one({"role": "nobody"}, {"$set": {"x": 1}})["matchedCount"] == 0
    first = got["insertedIds"][0]
    assert c.replace_one(first, {"name": "Countess"})["modifiedCount"] == 1
    assert c.find_one(first) == {"_id": first, "name": "Countess"}
    assert c.delete_one({"name": "Grace"})["deletedCount"] == 1 and names(c.find()) == ["Countess", "Margaret"]
    assert c.count_documents({"role": "reader"}) == 1 and c.document_count == 2
    db.close()
    again = open_db(spark, path)
    assert names(again.collection("people").find()) == ["Countess", "Margaret"] and not again.recovered
    assert again.collection("people").delete_many()["deletedCount"] == 2
    again.close()


def test_rejected_writes_leave_no_trace(db):
    c = db.collection("people")
    key = c.insert_one(PEOPLE[0])["insertedId"]
    version = db.manifest.version
    for write, text in (
        (lambda: c.insert_one({"_id": key}), "duplicate _id"), (lambda: c.insert_many([{"_id": "a" * 24}, {"_id": "a" * 24}]), "in batch"), (lambda: c.insert_one({"_id": 5}), "must be a string"),
        (lambda: c.insert_one({"_id": "XYZ"}), "24-character"), (lambda: c.replace_one("b" * 24, {}), "unknown _id"), (lambda: c.replace_one(key, None), "Replacement document"),
        (lambda: c.update_many({}, {"$inc": {"name": 1}}), "expected an existing number field"),
    ):
        with pytest.raises(DocframeError, match=text):
            write()
    assert db.manifest.version == version and len(db.folder.names(f"_log/{c.id}")) == 1
    assert c.insert_many([])["insertedCount"] == 0 and c.update_many({}, {})["matchedCount"] == 0


def test_unique_indexes(db):
    c = db.collection("u")
    c.insert_many([{"e": "a"}, {"e": "b"}, {}, {"e": 42}, {"e": 42}])
    assert c.create_index("e", "string", True)["unique"] and c.create_index("e", "string", True)["acknowledged"]
    assert c.get_indexes() == [{"name": "e", "type": "string", "unique": True}]
    for bad in (lambda: c.insert_one({"e": "a"}), lambda: c.insert_many([{"e": "z"}, {"e": "z"}]), lambda: c.update_many({}, {"$set": {"e": "q"}}), lambda: c.update_one({"e": "a"}, {"$set": {"e": "b"}})):
        with pytest.raises(DocframeError, match="unique index"):
            bad()
    assert c.update_one({"e": "a"}, {"$set": {"x": 1}})["modifiedCount"] == 1
    with pytest.raises(DocframeError, match='with type "string"'):
        c.create_index("e", "number")
    with pytest.raises(DocframeError, match="share the same value"):
        c.create_index("e", "number", True) if c.drop_index("e") else None
    with pytest.raises(DocframeError, match="No index exists"):
        c.drop_index("e")
    with pytest.raises(DocframeError, match="Unsupported index type"):
        c.create_index("e", "date")


def test_index_never_changes_results(db):
    c = db.collection("i")
    c.insert_many([{"role": "admin"}, {"role": 42}, {"role": None}, {}])
    before = [c.count_documents(q) for q in ({"role": 42}, {"role": None}, {"role": {"$in": ["admin", 42]}})]
    c.create_index("role")
    assert before == [1, 1, 2] == [c.count_documents(q) for q in ({"role": 42}, {"role": None}, {"role": {"$in": ["admin", 42]}})]


def test_distinct(db):
    c = db.collection("d")
    c.insert_many([{"v": 1}, {"v": "1"}, {"v": True}, {"v": None}, {}, {"v": 1.0}, {"v": ["a"]}, {"v": ["a"]}, {"v": {}}])
    assert c.distinct("v") == [1, "1", True, None, ["a"], {}]
    with pytest.raises(DocframeError, match=r'Too many distinct values for field "v" \(limit: 5\)'):
        c.distinct("v", limit=5)
    with pytest.raises(DocframeError, match="positive integer"):
        c.distinct("v", limit=0)


def test_sort_and_slices(db):
    c = db.collection("s")
    c.insert_many([{"v": "hello"}, {"v": 42}, {"v": True}, {}, {"v": None}])
    assert [d.get("v") for d in c.find().sort({"v": 1}).to_list()] == [None, None, True, 42, "hello"]
    assert [d.get("v") for d in c.find().sort({"v": -1}).skip(1).limit(2).to_list()] == [42, True]
    cursor = c.find({"v": {"$exists": True}})
    assert cursor.next()["v"] == "hello" and len(cursor.to_list()) == 3 and cursor.next() is None
    assert c.find().skip(2).limit(1).count() == 5 and c.find().limit(0).to_list() == []
    for bad, text in (({}, "at least one field"), ({c: 1 for c in "abcde"}, "cannot exceed 4 fields"), ({"": 1}, "cannot be empty"), ({"a": 2}, "must be 1")):
        with pytest.raises(DocframeError, match=text):
            c.find().sort(bad)
    with pytest.raises(DocframeError, match="Cursor limit must be a positive integer or zero"):
        c.find().limit(-1)
    c.insert_one({"v": [1]})
    with pytest.raises(Exception, match="Cannot sort on array values"):
        c.find().sort({"v": 1}).to_list()


def test_snapshot_cursor(db):
    c = db.collection("people")
    c.insert_many(PEOPLE)
    cursor = c.find()
    c.delete_many()
    assert names(cursor) == ["Ada", "Grace", "Margaret"] and c.document_count == 0


def test_crash_recovery(spark, db, path):
    c = db.collection("people")
    c.insert_many(PEOPLE)
    stray = c._write(c._rows([{"_id": new_id(), "name": "Ghost"}], 99))  # a batch without its commit
    db.folder.create(f"_manifests/{db.manifest.version + 1:012d}.json", b'{"version": 9')  # and a torn one
    db.close()
    again = open_db(spark, path)
    assert again.recovered and names(again.collection("people").find()) == ["Ada", "Grace", "Margaret"] and stray.split("/")[-1] not in again.folder.names(f"_log/{c.id}")
    again.collection("people").insert_one({"name": "Hedy"})
    again.close()
    third = open_db(spark, path)
    assert not third.recovered and third.collection("people").document_count == 4
    third.close()


def test_lock_and_read_only(spark, db, path):
    with pytest.raises(DocframeError, match="already in use by process"):
        open_db(spark, path)
    db.collection("a").insert_one({"x": 1})
    reader = open_db(spark, path, read_only=True)
    assert reader.collection("a").document_count == 1
    with pytest.raises(DocframeError, match="reading only"):
        reader.collection("a").insert_one({})


def test_compaction_and_stats(db):
    c = db.collection("people")
    c.insert_many(PEOPLE)
    c.create_index("name")
    c.update_many({"role": "admin"}, {"$set": {"role": "chief"}})
    c.delete_one({"name": "Ada"})
    s = c.stats()
    assert (s["documentCount"], s["operationCount"], s["tombstoneCount"], s["indexCount"]) == (2, 6, 1, 1) and s["liveBytes"] + s["deadBytes"] == s["sizeOnDisk"]
    db.compact()
    s = db.stats()
    assert (s["documentCount"], s["operationCount"], s["tombstoneCount"], s["collectionCount"]) == (2, 2, 0, 1)
    assert names(c.find()) == ["Grace", "Margaret"] and c.get_indexes()[0]["name"] == "name"


def test_drop(db):
    c = db.collection("gone")
    c.insert_one({"a": 1})
    c.drop()
    assert not db.exists_collection("gone") and c.find().to_list() == []
    with pytest.raises(DocframeError, match='Collection "gone" has been dropped.'):
        c.insert_one({})
    assert db.collection("gone").document_count == 0


def test_cache(db):
    c = db.collection("people")
    key = c.insert_one(PEOPLE[0])["insertedId"]
    c.enable_cache(10_000)
    c.find_one(key)
    c.find_one(key)["name"] = "changed"
    assert c.find_one(key)["name"] == "Ada" and c.cache_stats()["hits"] == 2
    c.update_one(key, {"$set": {"name": "B"}})
    assert c.find_one(key)["name"] == "B"
    c.disable_cache()
    assert c.cache_stats() is None
    small = DocumentCache(60)
    for i in range(4):
        small.put(str(i), 1, {"x": i})
    assert small.stats()["documentCount"] == 3 and small.stats()["evictions"] == 1
    with pytest.raises(DocframeError):
        DocumentCache(0)


def test_change_feed(spark, db, tmp_path):
    c = db.collection("people")
    c.insert_many(PEOPLE)
    query = c.changes().selectExpr("op", "_id").writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        c.delete_one({"name": "Ada"})
        query.processAllAvailable()
        assert sorted(r["op"] for r in spark.table("feed").collect()) == ["del", "put", "put", "put"]
    finally:
        query.stop()


SAMPLES = [{}, {"a": None, "b": True, "c": [1, [2, {"d": "é\U0001f600"}]], "e": {"f": -1.5}}, {"i": 2**31 - 1, "j": -(2**31), "k": 2**40, "l": 0.1, "m": 2**28, "n": -(2**28) - 1, "": 1 if False else "x"}]


@pytest.mark.parametrize("document", SAMPLES[:2] + [{k: v for k, v in SAMPLES[2].items() if k}])
@pytest.mark.parametrize("codec", [bson, amf3])
def test_codecs(codec, document):
    assert codec.decode(codec.encode(document)) == document


def test_u29_bounds():
    for n in (0, 0x7F, 0x80, 0x3FFF, 0x4000, 0x1FFFFF, 0x200000, 2**29 - 1):
        assert amf3.read_u29(amf3.u29(n), 0) == (n, len(amf3.u29(n)))
    with pytest.raises(ValueError):
        amf3.u29(2**29)


def record(name, payload):
    body = name.encode() + struct.pack(">I", len(payload) + -len(payload) % 4) + payload + b"\0" * (-len(payload) % 4)
    return body + struct.pack(">I", zlib.crc32(body))


def test_import_of_framed_files(spark, tmp_path):
    put = lambda k, d: record("put1", b"cccc" + bytes([k] * 12) + amf3.u29(len(json.dumps(d))) + json.dumps(d).encode())
    data = b"........" + b"\0\1j\0" + record("ncl1", b"cccc\4name") + put(1, {"a": 1}) + record("txnb", b"") + put(2, {"a": 2}) + record("txnc", b"") + record("del1", b"cccc" + bytes([1] * 12)) + record("txnb", b"") + put(3, {})
    (tmp_path / "old.bin").write_bytes(data + b"torn")
    got = [(r["op"], (r["_id"] or "")[:2], r["json"]) for r in legacy.import_files(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("new", "", '{"name": "name"}'), ("put", "01", '{"a": 1}'), ("put", "02", '{"a": 2}'), ("del", "01", None)]


def test_import_into_a_database(spark, db, tmp_path):
    put = lambda c, k, d: record("put1", c + bytes([k] * 12) + amf3.u29(len(bson.encode(d))) + bson.encode(d))
    one, two = b"\0\0\0\1", b"\0\0\0\2"
    data = b"anything" + b"\0\1b\0" + record("ncl1", one + b"\5first") + record("ncl1", two + b"\4gone") + put(one, 1, {"a": "x"}) + put(two, 2, {"a": 1})
    data += record("idx1", one + b"\1\1\1a") + record("idx1", one + b"\2\0\1n") + record("dix1", one + b"\1n") + record("hol0", b"\0" * 8)
    data += put(one, 3, {"a": "y"}) + record("del1", one + bytes([1] * 12)) + put(one, 1, {"a": "z"}) + record("dco1", two)
    source = tmp_path / "old.bin"
    source.write_bytes(data)
    assert import_framed(db, str(source)) == {"first": 2} and db.get_collections() == ["first"]
    c = db.collection("first")
    assert [(d["_id"][:2], d["a"]) for d in c.find().to_list()] == [("03", "y"), ("01", "z")]
    assert c.get_indexes() == [{"name": "a", "type": "string", "unique": True}]
    with pytest.raises(Exception, match="expected b'wrongmag' header"):
        import_framed(db, str(source), b"wrongmag")


@pytest.mark.parametrize(("data", "text"), [
    (b"12345678\0\1j", "header too short"), (b"12345678\1\1j\0", "Unsupported format version: 1"), (b"12345678\0\1z\0", "Unsupported serialization format: z"),
    (b"12345678\0\1j\1", "Unsupported serialization version: 1"), (b"12345678\0\1j\0" + record("wrt1", b""), "Unsupported operation identifier: wrt1"),
    (b"12345678\0\1j\0" + record("put1", b"cccc" + b"\1" * 12 + b"\2{}"), "Invalid put document operation: unknown collection identifier"),
    (b"12345678\0\1j\0" + record("ncl1", b"cccc\4name") + record("ncl1", b"cccd\1ax"), "non-zero padding"),
    (b"12345678\0\1j\0" + record("ncl1", b"cccc\4name") + record("idx1", b"cccc\3\0\1a"), "unknown index type"),
    (b"12345678\0\1j\0" + record("ncl1", b"cccc\4name") + record("dco1", b"cccc\0\0\0\0"), "payload must be 4 bytes"),
    (b"12345678\0\1j\0" + record("txnc", b""), "commit without begin"),
])
def test_files_that_import_refuses(data, text):
    with pytest.raises(DocframeError, match=text):
        list(legacy.operations_of(data))


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_index_prunes_and_keeps_results(spark, db):
    c = db.collection("p")
    c.insert_many([{"age": i, "name": f"n{i}", "odd": True if i % 2 else "no"} for i in range(40)])
    c.create_index("age", "number")
    c.create_index("name")
    c.insert_many([{"age": 7.0, "name": 7}, {"age": "7", "name": "n7"}, {"name": "n8"}])
    wanted = [({"age": 7}, 2), ({"age": {"$in": [7, 39]}}, 3), ({"age": {"$in": [7, "7"]}}, 3), ({"age": {"$gte": 30, "$lt": 35}}, 5), ({"name": "n7"}, 2), ({"name": {"$gt": "n38"}}, 9), ({"age": {"$ne": 7}}, 41), ({"$or": [{"age": 1}, {"name": "n2"}]}, 2)]
    assert [c.count_documents(q) for q, _ in wanted] == [n for _, n in wanted]
    c.update_many({"age": 7}, {"$set": {"age": 70}})
    c.delete_many({"age": 1})
    moved = [({"age": 7}, 0), ({"age": 70}, 2), ({"age": 1}, 0), ({"name": "n7"}, 2)]
    assert [c.count_documents(q) for q, _ in moved] == [n for _, n in moved]
    db.compact()
    assert [c.count_documents(q) for q, _ in moved] == [n for _, n in moved]
    plan = plan_of(c.find({"age": {"$gte": 30, "$lt": 35}}).to_df())
    side = side_column({"name": "age", "type": "number"})
    assert f"GreaterThanOrEqual({side},30.0)" in plan and f"LessThan({side},35.0)" in plan and "Exchange" not in plan


def test_live_view_does_not_shuffle_documents(db):
    c = db.collection("l")
    c.insert_many([{"a": i} for i in range(20)])
    c.insert_many([{"a": i} for i in range(20, 30)])
    assert "Exchange" not in plan_of(c.live()) and "Join" not in plan_of(c.live())
    key = c.find_one({"a": 3})["_id"]
    c.update_one(key, {"$set": {"a": 300}})
    c.delete_one({"a": 4})
    plan = plan_of(c.find({"_id": key}).to_df())
    assert "BroadcastHashJoin" in plan and f"EqualTo(_id,{key})" in plan and "SortMergeJoin" not in plan
    assert c.find_one(key)["a"] == 300 and c.count_documents({"a": 3}) == 0 and c.document_count == 29
    c.delete_one(key)
    c.insert_one({"_id": key, "a": 5000})
    assert c.find_one(key)["a"] == 5000 and c.document_count == 29


def test_lock_of_another_machine(spark, db, path):
    c = db.collection("people")
    stray = c._write(c._rows([{"_id": new_id(), "name": "Ghost"}], 99))
    db.folder.touch("_lock", b'{"machine": "elsewhere", "pid": 4242, "token": "t"}')
    with pytest.raises(DocframeError, match="already in use by process 4242"):
        open_db(spark, path)
    with pytest.raises(DocframeError, match="lock was lost"):
        c.insert_one({"a": 1})
    time.sleep(0.3)
    heir = open_db(spark, path, lease=0.2)
    heir.close()
    assert stray.split("/")[-1] not in db.folder.names(f"_log/{c.id}") and not db.folder.names("_lock")


def test_young_batches_of_a_lost_holder_stay(spark, db, path):
    c = db.collection("people")
    db.folder.touch("_lock", b'{"machine": "elsewhere", "pid": 4242, "token": "t"}')
    time.sleep(1.2)
    young = c._write(c._rows([{"_id": new_id(), "name": "Ghost"}], 99))
    age = db.folder.age("_lock")
    assert age > 1
    heir = open_db(spark, path, lease=age)
    assert heir.recovered and young.split("/")[-1] in db.folder.names(f"_log/{c.id}") and heir.collection("people").document_count == 0
    heir.close()


def test_options(spark, tmp_path):
    made = open_db(spark, str(tmp_path / "o"), durability="relaxed", serialization="bson")
    made.collection("c").insert_one({"a": 1})
    made.close()
    with pytest.raises(DocframeError, match="the database is closed"):
        made.collection("c").insert_one({"a": 1})
    again = open_db(spark, str(tmp_path / "o"))
    assert again.manifest.serialization == "bson" and again.collection("c").find_one()["a"] == 1
    again.close()
    with pytest.raises(DocframeError, match="Unsupported serialization format"):
        open_db(spark, str(tmp_path / "x"), serialization="xml")


def test_frames_of_tables(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, v string")
    assert [r["k"] for r in frames.find(df).sort({"v": 1}).to_list()] == [3, 2, 1]
    assert frames.distinct_limited(df, "v", order_by=["k"]) == ["b", "a"]
    with pytest.raises(DocframeError, match="Too many"):
        frames.distinct_limited(df, "v", limit=1)


def test_insert_frame_keeps_ids_and_takes_a_batch_once(spark, tmp_path):
    db = open_db(spark, str(tmp_path / "ids"))
    try:
        c = db.collection("c")
        given = "0123456789abcdef01234567"
        frame = spark.createDataFrame([(f'{{"_id": "{given}", "a": 1}}',), ('{"a": 2}',)], "doc string")
        assert c.insert_frame(frame, source=("feed", 4)) == 2
        assert c.find_one(given)["a"] == 1 and c.document_count == 2
        assert c.insert_frame(frame, source=("feed", 4)) == 0 and c.document_count == 2
        with pytest.raises(DocframeError, match="duplicate _id"):
            c.insert_frame(frame)
        with pytest.raises(DocframeError, match="in batch"):
            c.insert_frame(spark.createDataFrame([('{"_id": "aaaaaaaaaaaaaaaaaaaaaaaa"}',)] * 2, "doc string"))
        with pytest.raises(DocframeError, match="Invalid _id"):
            c.insert_frame(spark.createDataFrame([('{"_id": "short"}',)], "doc string"))
        assert db.manifest.next_seq < 1 << 45
    finally:
        db.close()
