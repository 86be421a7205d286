"""Collections of JSON documents over the operation log."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.cursor import Cursor
from docframe.errors import DocframeError
from docframe.objectid import check_id, new_id
from docframe.operators import frames
from docframe.query.ast import And, Test
from docframe.query.compile import compile_query
from docframe.query.evaluate import canonical, json_type
from docframe.query.lower import lower
from docframe.resolve import TypedField, VariantResolver, VariantValue
from docframe.store.cache import DocumentCache
from docframe.update.compile import compile_update
from docframe.update.lower import variant_update

LOG = "_seq long, _first long, _id string, op string, doc variant"
COLUMNS = ("_seq", "_first", "_id", "op", "doc")
INDEX_TYPES = ("string", "number")
#: Changed ids up to which they are sent to all executors; an id is always 24 characters.
BROADCAST_IDS = 500_000


class StoredResolver(VariantResolver):
    """Fields of stored documents; ``_id`` is a column of its own and prunes files."""

    def field(self, name: str):
        if name == "_id":
            from pyspark.sql.types import StringType

            return TypedField(F.col("_id"), StringType(), False, self.string_order)
        return super().field(name)


def index_key(index: dict) -> Column:
    """The value that takes part in a unique index, else NULL."""
    value = StoredResolver("doc").field(index["name"])
    if isinstance(value, TypedField):
        return value.value
    number = value.as_kind("number")
    if index["type"] == "number":
        return F.when(value.is_kind("number") & ~F.isnan(number) & (F.abs(number) < float("inf")), value.key())
    return F.when(value.is_kind("string"), value.as_kind("string"))


def side_column(index: dict) -> str:
    """The column beside the documents that holds an index's values, whatever its field is called."""
    return f"_ix_{index['type']}_{hashlib.sha256(index['name'].encode()).hexdigest()[:16]}"


def side_value(index: dict) -> Column:
    """The field's value if it is of the index's type; files keep statistics of it, as of no VARIANT path."""
    value = StoredResolver("doc").field(index["name"])
    if isinstance(value, TypedField):
        return value.value if index["type"] == "string" else F.lit(None).cast("double")
    return F.when(value.is_kind(index["type"]), value.as_kind(index["type"]))


def side_type(column: str) -> str:
    return "double" if column.startswith("_ix_number") else "string"


def side_test(test: Test, index: dict) -> Column | None:
    """What holds for the side column of every document that meets ``test``, if anything is known."""
    name, kind = side_column(index), index["type"]
    values = list(test.value) if test.op == "in" else [test.value]
    if any(json_type(v) != kind or (kind == "number" and math.isnan(v)) for v in values) or not values:
        return None
    values = [F.lit(float(v) if kind == "number" else v) for v in values]
    side = F.col(name)
    if test.op in ("eq", "in"):
        return side.isin(*values) if len(values) > 1 else side == values[0]
    if kind == "number":  # strings are ordered by collation, which files know nothing of
        return {"gt": side > values[0], "gte": side >= values[0], "lt": side < values[0], "lte": side <= values[0]}[test.op]
    return None


def side_tests(node, indexes: list[dict]) -> list[tuple[str, Column]]:
    """Side columns and conditions that follow from a query."""
    if isinstance(node, And):
        return [t for p in node.parts for t in side_tests(p, indexes)]
    if not isinstance(node, Test) or node.op not in ("eq", "in", "gt", "gte", "lt", "lte"):
        return []
    found = [(side_column(i), side_test(node, i)) for i in indexes if i["name"] == node.field]
    return [(name, test) for name, test in found if test is not None]


class Collection:
    def __init__(self, db, name: str):
        self._db, self.name = db, name
        self.id = db.manifest.collections[name]["id"]
        self._cache: DocumentCache | None = None
        self._dropped = False

    # -- views ---------------------------------------------------------------------------------

    def _entry(self) -> dict:
        entry = self._db.manifest.collections.get(self.name)
        return entry if entry and entry["id"] == self.id else {"files": [], "indexes": []}

    def _check(self) -> None:
        if self._dropped:
            raise DocframeError(f'Collection "{self.name}" has been dropped.')

    def log(self, tests: list[tuple[str, Column]] = ()) -> DataFrame:
        """All operations of the version in force.

        Files that have a side column leave out what its ``tests`` rule out; others are read whole.
        """
        entry, spark = self._entry(), self._db.spark
        alike: dict[tuple, list[str]] = {}
        for f in entry["files"]:
            alike.setdefault(tuple(entry.get("sides", {}).get(f, ())), []).append(self._db.folder.uri(f))
        parts = []
        for sides, files in alike.items():
            part = spark.read.schema(", ".join([LOG, *(f"{c} {side_type(c)}" for c in sides)])).parquet(*files)
            for name, test in tests:
                part = part.where(test) if name in sides else part
            parts.append(part.select(*COLUMNS))
        return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "_seq long").selectExpr(
            "_seq", "_seq AS _first", "'' AS _id", "'' AS op", "parse_json('null') AS doc")

    def live(self, tests: list[tuple[str, Column]] = ()) -> DataFrame:
        """The latest version of every document that is not deleted.

        ``_first`` is where the document was first inserted and orders the collection.  Inserted ids
        are new, so only batches of changes can outdate a row.  Their ids, without the documents, are
        matched against the log; filters of the reader apply before that.
        """
        rows = self.log(tests).where("op = 'put'").select("_seq", "_first", "_id", "doc")
        entry = self._entry()
        changes = entry.get("changes", entry["files"])
        if not changes:
            return rows
        newer = self._db.spark.read.schema(LOG).parquet(*map(self._db.folder.uri, changes)).groupBy(F.col("_id").alias("changed")).agg(F.max("_seq").alias("last"))
        if entry.get("changed", BROADCAST_IDS + 1) <= BROADCAST_IDS:
            newer = F.broadcast(newer)
        return rows.join(newer, (F.col("_id") == F.col("changed")) & (F.col("_seq") < F.col("last")), "left_anti")

    def to_df(self) -> DataFrame:
        return self.live().select("_id", "doc")

    def find(self, query: dict | None = None) -> Cursor:
        resolver, tree = StoredResolver("doc"), compile_query(query)
        found = lower(tree, resolver)
        rows = self.live(side_tests(tree, self._entry()["indexes"]))
        if found is not True:
            rows = rows.where(F.lit(False) if found is False else found)
        return Cursor(rows, resolver, [F.col("_first")], lambda d: d.select(F.to_json("doc").alias("json")), lambda r: json.loads(r["json"]))

    def find_one(self, query: dict | str | None = None) -> dict | None:
        query = {"_id": query} if isinstance(query, str) else query
        key = query.get("_id") if query and set(query) == {"_id"} else None
        if self._cache is None or not isinstance(key, str):
            return self.find(query).limit(1).next()
        found = self._cache.get(key, self._db.manifest.version)
        if found is None:
            found = self.find(query).limit(1).next()
            if found is not None:
                self._cache.put(key, self._db.manifest.version, found)
        return found

    def count_documents(self, query: dict | None = None) -> int:
        return self.find(query).count()

    @property
    def document_count(self) -> int:
        return self.count_documents()

    def distinct(self, field: str, query: dict | None = None, limit: int = frames.DISTINCT_LIMIT) -> list:
        self._check()
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise DocframeError("distinct() limit must be a positive integer.")
        target = StoredResolver("doc").field(field)
        rows = self.find(query)._df.where(target.value.isNotNull())
        text = F.to_json(target.value) if isinstance(target, VariantValue) else F.to_json(F.parse_json(F.to_json(target.value)))
        key = target.distinct_key()
        found = rows.groupBy(key.alias("key")).agg(F.min("_first").alias("first"), F.first(text).alias("value")).orderBy("first").limit(limit + 1).collect()
        if len(found) > limit:
            raise DocframeError(f'Too many distinct values for field "{field}" (limit: {limit}).')
        return [json.loads(r["value"]) for r in found]

    # -- writes --------------------------------------------------------------------------------

    def _sides(self) -> list[str]:
        return [side_column(i) for i in self._entry()["indexes"]]

    def _write(self, rows: DataFrame, **options: Any) -> str:
        """Write a batch that no reader sees yet, with the side columns of the indexes.

        All errors in the data surface here.
        """
        name = f"_log/{self.id}/{uuid.uuid4().hex}"
        sides = [side_value(i).alias(side_column(i)) for i in self._entry()["indexes"]]
        try:
            rows.select(*COLUMNS, *sides).write.options(**options).parquet(self._db.folder.uri(name))
        except Exception as e:
            self._db.folder.delete(name)
            text = str(e)
            at = text.find("[USER_RAISED_EXCEPTION]")
            if at >= 0:
                raise DocframeError(text[at + 23 :].strip().split(" SQLSTATE")[0].split("\n")[0]) from None
            raise
        return name

    def _commit(self, name: str, count: int, source: tuple[str, int] | None = None, changed: int = 0) -> None:
        """Make a batch visible; ``changed`` of its operations are on documents known before."""

        def add(m):
            entry = m.collections[self.name]
            if changed:
                entry["changes"] = [*entry.get("changes", entry["files"]), name]
                entry["changed"] = entry.get("changed", BROADCAST_IDS) + changed
            entry["files"].append(name)
            entry.setdefault("sides", {})[name] = self._sides()
            if source:
                entry.setdefault("sources", {})[source[0]] = source[1]
            m.next_seq += count

        self._db.commit(add)

    def _unique(self, name: str) -> None:
        """Check a written batch against the live documents and itself."""
        for index in self._entry()["indexes"]:
            if not index["unique"]:
                continue
            batch = self._db.spark.read.schema(LOG).parquet(self._db.folder.uri(name)).where("op = 'put'")
            key = index_key(index)
            mine = batch.select("_seq", F.col("_id").alias("me"), key.alias("key")).where("key IS NOT NULL")
            theirs = self.live().select("_id", key.alias("key"))
            clash = mine.join(theirs, "key").where("me != _id").select("key", "me", "_id").limit(1).collect()
            twice = mine.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("me", "_seq").alias("me"), F.max_by("me", "_seq").alias("_id")).where("n > 1").limit(1).collect()
            if clash or twice:
                r = (clash or twice)[0]
                self._db.folder.delete(name)
                value = json.dumps(r["key"]) if index["type"] == "string" else r["key"]
                # The texts of the two conflicts.
                if clash:
                    raise DocframeError(f'Cannot write document "{r["me"]}": value {value} for unique index "{index["name"]}" is already used by document "{r["_id"]}".')
                raise DocframeError(f'Cannot write documents "{r["me"]}" and "{r["_id"]}": both use value {value} for unique index "{index["name"]}".')

    def _append(self, rows: DataFrame, count: int = 1, change: bool = True) -> int:
        """Write, check and commit a batch of changes or of new documents; the number of its operations."""
        name = self._write(rows)
        self._unique(name)
        written = self._db.spark.read.parquet(self._db.folder.uri(name)).count()
        if written:
            self._commit(name, count, changed=written if change else 0)
        else:
            self._db.folder.delete(name)
        return written

    def _rows(self, documents: list[dict], first: int) -> DataFrame:
        data = [(first + i, d["_id"], canonical(d)) for i, d in enumerate(documents)]
        return self._db.spark.createDataFrame(data, "_seq long, _id string, json string").select(
            "_seq", F.col("_seq").alias("_first"), "_id", F.lit("put").alias("op"), F.parse_json("json").alias("doc"))

    def insert_one(self, document: dict) -> dict:
        return {"acknowledged": True, "insertedId": self.insert_many([document])["insertedIds"][0]}

    def insert_many(self, documents: list[dict]) -> dict:
        self._check()
        ready, seen = [], set()
        for d in documents:
            key = check_id(d["_id"]) if "_id" in d else new_id()
            if key in seen:
                raise DocframeError(f'Cannot insert documents: duplicate _id "{key}" in batch.')
            seen.add(key)
            ready.append({"_id": key, **{k: v for k, v in d.items() if k != "_id"}})
        given = [d["_id"] for d in documents if "_id" in d]
        if given:
            known = self.live().where(F.col("_id").isin(given)).select("_id").limit(1).collect()
            if known:
                raise DocframeError(f'Cannot insert document: duplicate _id "{known[0][0]}".')
        if ready:
            self._append(self._rows(ready, self._db.manifest.next_seq), len(ready), change=False)
        return {"acknowledged": True, "insertedCount": len(ready), "insertedIds": [d["_id"] for d in ready]}

    def insert_frame(self, df: DataFrame, doc_column: str = "doc", source: tuple[str, int] | None = None) -> int:
        """Insert a distributed table of documents (a VARIANT or JSON string column) without collecting it.

        A document keeps its ``_id`` if it has one; ids must be new and differ.  ``source`` names a
        feed and the number of its batch: a batch that was committed before is not inserted again.
        """
        self._check()
        if source and self._entry().get("sources", {}).get(source[0], -1) >= source[1]:
            return 0
        base = self._db.manifest.next_seq
        doc = F.col(doc_column) if dict(df.dtypes)[doc_column] == "variant" else F.parse_json(doc_column)
        seq = F.lit(base) + F.monotonically_increasing_id()
        made = F.substring(F.sha2(F.concat_ws(":", F.lit(uuid.uuid4().hex), seq), 256), 1, 24)
        rows = df.select(seq.alias("_seq"), made.alias("made"), doc.alias("d")).withColumn("given", F.variant_get("d", "$._id", "string"))
        wrong = F.raise_error(F.concat(F.lit('Invalid _id "'), F.col("given"), F.lit('".'))).cast("string")
        key = F.when(F.col("given").isNull(), F.col("made")).when(F.col("given").rlike("^[0-9a-fA-F]{24}$"), F.lower("given")).otherwise(wrong)
        rows = rows.withColumn("_id", key)
        fields = F.map_concat(F.map_filter(F.col("d").cast("map<string,variant>"), lambda k, _: k != "_id"), F.create_map(F.lit("_id"), F.col("_id").cast("variant")))
        name = self._write(rows.select("_seq", F.col("_seq").alias("_first"), "_id", F.lit("put").alias("op"), F.to_variant_object(fields).alias("doc")))
        batch = self._db.spark.read.schema(LOG).parquet(self._db.folder.uri(name))
        twice = batch.groupBy("_id").count().where("count > 1").select("_id").limit(1).collect()
        known = twice or (batch.select("_id").join(self.live().select("_id"), "_id", "left_semi").limit(1).collect() if self._entry()["files"] else [])
        if known:
            self._db.folder.delete(name)
            raise DocframeError(f'Cannot insert document: duplicate _id "{known[0][0]}".' if not twice else f'Cannot insert documents: duplicate _id "{known[0][0]}" in batch.')
        self._unique(name)
        written = batch.agg(F.count(F.lit(1)).alias("n"), F.max("_seq").alias("last")).first()
        if not written["n"]:
            self._db.folder.delete(name)
            return 0
        self._commit(name, written["last"] - base + 1, source)
        return written["n"]

    def _changed(self, rows: DataFrame, doc: Column | None) -> DataFrame:
        seq = F.lit(self._db.manifest.next_seq)
        if doc is None:
            return rows.select(seq.alias("_seq"), "_first", "_id", F.lit("del").alias("op"), F.lit(None).cast("variant").alias("doc"))
        return rows.select(seq.alias("_seq"), "_first", "_id", F.lit("put").alias("op"), doc.alias("doc"))

    def _first_match(self, query: dict | str | None) -> DataFrame:
        return self.find({"_id": query} if isinstance(query, str) else query)._df.orderBy("_first").limit(1)

    def replace_one(self, target: str | dict, document: dict | None = None) -> dict:
        """``replace_one(id, document)`` or ``replace_one(document)`` with its ``_id``."""
        self._check()
        if isinstance(target, dict):
            target, document = target.get("_id"), target
        if document is None:
            raise DocframeError("Replacement document is required.")
        key = check_id(target)
        text = canonical({"_id": key, **{k: v for k, v in document.items() if k != "_id"}})
        if not self._append(self._changed(self.live().where(F.col("_id") == key), F.parse_json(F.lit(text)))):
            raise DocframeError(f'Cannot replace document: unknown _id "{key}".')
        return {"acknowledged": True, "matchedCount": 1, "modifiedCount": 1}

    def _update(self, rows: DataFrame, update: dict) -> dict:
        self._check()
        n = 0
        if update:
            n = self._append(self._changed(rows, variant_update(F.col("doc"), compile_update(update))))
        return {"acknowledged": True, "matchedCount": n, "modifiedCount": n}

    def update_one(self, query: dict | str | None, update: dict) -> dict:
        return self._update(self._first_match(query), update)

    def update_many(self, query: dict | None, update: dict) -> dict:
        """Update all that match in one batch: all of it becomes visible, or none."""
        return self._update(self.find(query)._df, update)

    def delete_one(self, query: dict | str | None = None) -> dict:
        self._check()
        return {"acknowledged": True, "deletedCount": self._append(self._changed(self._first_match(query), None))}

    def delete_many(self, query: dict | None = None) -> dict:
        self._check()
        return {"acknowledged": True, "deletedCount": self._append(self._changed(self.find(query)._df, None))}

    # -- indexes -------------------------------------------------------------------------------

    def create_index(self, field: str, type: str = "string", unique: bool = False) -> dict:  # noqa: A002
        self._check()
        if not field:
            raise DocframeError("Index field cannot be empty.")
        if type not in INDEX_TYPES:
            raise DocframeError(f"Unsupported index type: {type}.")
        old = self.exists_index(field) and next(i for i in self.get_indexes() if i["name"] == field)
        if old and old["type"] != type:
            raise DocframeError(f'Index already exists on "{field}" with type "{old["type"]}".')
        if old and old["unique"] != unique:
            raise DocframeError(f'Index already exists on "{field}" with unique={str(old["unique"]).lower()}.')
        index = {"name": field, "type": type, "unique": unique}
        if unique:
            groups = self.live().groupBy(index_key(index).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("_id", "_first").alias("a"), F.max_by("_id", "_first").alias("b"))
            twice = groups.where("key IS NOT NULL AND n > 1").limit(1).collect()
            if twice:
                raise DocframeError(f'Cannot create unique index on "{field}": documents "{twice[0]["a"]}", "{twice[0]["b"]}" share the same value.')
        if not old:
            self._db.commit(lambda m: m.collections[self.name]["indexes"].append(index))
        return {"acknowledged": True, "field": field, "type": type, "unique": unique}

    def drop_index(self, field: str) -> dict:
        self._check()
        if not self.exists_index(field):
            raise DocframeError(f'No index exists on field "{field}".')

        def remove(m):
            entry = m.collections[self.name]
            entry["indexes"] = [i for i in entry["indexes"] if i["name"] != field]

        self._db.commit(remove)
        return {"acknowledged": True, "field": field}

    def get_indexes(self) -> list[dict]:
        return [dict(i) for i in self._entry()["indexes"]]

    indexes = property(get_indexes)

    def exists_index(self, field: str) -> bool:
        return any(i["name"] == field for i in self._entry()["indexes"])

    # -- administration --------------------------------------------------------------------------

    def drop(self) -> None:
        self._check()
        self._db.commit(lambda m: m.collections.pop(self.name))
        self._dropped = True
        self._db._open.pop(self.name, None)

    def snapshot(self) -> dict[str, list[str]]:
        """Write the live documents as one batch, in the order of the first index or else of the ids.

        Files know the least and the greatest value of every stretch of rows, so finds by that
        index read little; a find by id also asks a Bloom filter.
        """
        entry = self._entry()
        if not entry["files"]:
            return {}
        rows = self.live().select("_seq", "_first", "_id", F.lit("put").alias("op"), "doc")
        rows = rows.withColumn("k", side_value(entry["indexes"][0]) if entry["indexes"] else F.col("_id"))
        rows = rows.repartitionByRange("k", "_id").sortWithinPartitions("k", "_id")
        bloom = {"parquet.bloom.filter.enabled#_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        return {self._write(rows, **bloom): self._sides()}

    def stats(self) -> dict:
        self._check()
        length = F.coalesce(F.length(F.to_json("doc")), F.lit(0)) + 32
        ops = self.log().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "del").alias("dels"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
        live = self.live().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
        size = sum(self._db.folder.size(f) for f in self._entry()["files"])
        share = size * live["bytes"] // ops["bytes"] if ops["bytes"] else 0
        return {"name": self.name, "documentCount": live["n"], "operationCount": ops["n"], "tombstoneCount": ops["dels"], "indexCount": len(self.get_indexes()),
                "sizeOnDisk": size, "liveBytes": share, "deadBytes": size - share}

    def enable_cache(self, max_bytes: int) -> None:
        self._check()
        if self._cache is None:
            self._cache = DocumentCache(max_bytes)
        else:
            self._cache.resize(max_bytes)

    def disable_cache(self) -> None:
        self._cache = None

    def cache_stats(self) -> dict | None:
        return self._cache.stats() if self._cache else None

    def changes(self, **options: Any) -> DataFrame:
        """The operations as a stream: batches appear as they are committed to the log folder.

        An extension; a batch whose commit failed may be seen before its files are removed.
        """
        pattern = self._db.folder.uri(f"_log/{self.id}/*")
        return self._db.spark.readStream.schema(LOG).options(**options).parquet(pattern)
