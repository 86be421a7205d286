"""Registered queries of the document engine with their DuckDB oracles.

Every entry is one operator over the driver's tables; its SQL says the same independently.
"""

from __future__ import annotations

import json
import struct
import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.codecs import amf3, bson
from docframe.codecs import frames as codecs
from docframe.database import open_db
from docframe.errors import DocframeError
from docframe.operators import frames
from docframe.sources.documents import import_framed
from docframe.update.lower import apply_update

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINE_ORDER = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql is not None:
        ORACLES[name] = sql


def found(name: str, source: str, query: dict, where: str, prepare=None, columns: str = "*", base: str | None = None, **options) -> None:
    """A filter: the documents of a table that match, and the SQL condition."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        out = frames.find(prepare(df) if prepare else df, query, **options).to_df()
        return out.drop("doc") if "doc" in out.columns else out

    register(name, run, f"SELECT {columns} FROM {base or source} WHERE {where}")


# -- scans and predicates ---------------------------------------------------------------------

register("scan_lineitem", lambda s, d: frames.find(table(s, d, "lineitem")).to_df(), "SELECT * FROM lineitem")
register("scan_all", lambda s, d: frames.find(table(s, d, "nation")).to_df(), "SELECT * FROM nation")
found("eq_implicit", "lineitem", {"l_returnflag": "R"}, "l_returnflag = 'R'")
found("eq", "orders", {"o_orderkey": {"$eq": 7}}, "o_orderkey = 7")
found("ne", "lineitem", {"l_returnflag": {"$ne": "R"}}, "l_returnflag IS DISTINCT FROM 'R'")
found("gt", "lineitem", {"l_quantity": {"$gt": 45}}, "l_quantity > 45")
found("gte", "lineitem", {"l_quantity": {"$gte": 45}}, "l_quantity >= 45")
found("lt", "lineitem", {"l_quantity": {"$lt": 5}}, "l_quantity < 5")
found("lte", "lineitem", {"l_quantity": {"$lte": 5}}, "l_quantity <= 5")
found("range", "lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}}, "l_quantity >= 10 AND l_quantity < 20")
found("in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", 5, None]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')")
found("nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH", 5]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
found("in_empty", "nation", {"n_name": {"$in": []}}, "false")
found("nin_empty", "nation", {"n_name": {"$nin": []}}, "true")
found("or_empty", "nation", {"$or": []}, "false")
found("nor_empty", "nation", {"$nor": []}, "true")
found("and_empty", "nation", {"$and": []}, "true")
found("missing_field_eq", "nation", {"absent": 1}, "false")
found("missing_field_ne", "nation", {"absent": {"$ne": 1}}, "true")
found("missing_field_not", "nation", {"absent": {"$not": {"$gt": 1}}}, "true")
found("missing_field_nin", "nation", {"absent": {"$nin": [1, None]}}, "true")
found("missing_field_exists", "nation", {"absent": {"$exists": False}}, "true")
found("regex", "part", {"p_type": {"$regex": "^(?:STANDARD|PROMO).*[LR]$"}}, "regexp_matches(p_type, '^(?:STANDARD|PROMO).*[LR]$')")
found("regex_i", "customer", {"c_mktsegment": {"$regex": "^build", "$options": "i"}}, "regexp_matches(c_mktsegment, '^build', 'i')")
found("regex_prefix", "customer", {"c_mktsegment": {"$regex": "^BUILD"}}, "starts_with(c_mktsegment, 'BUILD')")
found("regex_not", "customer", {"c_mktsegment": {"$not": {"$regex": "ING$"}}}, "NOT regexp_matches(c_mktsegment, 'ING$')")
found("type_mismatch_no_coercion", "lineitem", {"l_returnflag": 5}, "false")
found("type_mismatch_range", "lineitem", {"l_returnflag": {"$gt": 5}}, "false")
found("type_typed", "orders", {"o_orderkey": {"$type": ["number", "bool"]}, "o_orderstatus": {"$type": "string"}}, "true")
found("not_conj", "lineitem", {"l_quantity": {"$not": {"$gte": 10, "$lte": 40}}}, "NOT (l_quantity >= 10 AND l_quantity <= 40)")
found("not_nested", "lineitem", {"l_quantity": {"$not": {"$not": {"$gt": 45}}}}, "l_quantity > 45")
found("and", "lineitem", {"$and": [{"l_returnflag": "R"}, {"l_quantity": {"$gt": 40}}]}, "l_returnflag = 'R' AND l_quantity > 40")
found("or", "lineitem", {"$or": [{"l_returnflag": "R"}, {"l_quantity": {"$gt": 45}}]}, "l_returnflag = 'R' OR l_quantity > 45")
found("nor", "lineitem", {"$nor": [{"l_returnflag": "R"}, {"l_quantity": {"$gt": 25}}]}, "NOT (l_returnflag = 'R' OR l_quantity > 25)")
found("nested", "orders", {"$or": [{"$and": [{"o_orderstatus": "F"}, {"$nor": [{"o_totalprice": {"$lt": 100000}}]}]}, {"o_orderpriority": {"$not": {"$in": ["5-LOW", "1-URGENT"]}}, "o_custkey": {"$lte": 100}}]},
      "(o_orderstatus = 'F' AND NOT o_totalprice < 100000) OR (o_orderpriority NOT IN ('5-LOW', '1-URGENT') AND o_custkey <= 100)")
found("string_range", "customer", {"c_mktsegment": {"$gte": "BUILDING", "$lt": "HOUSEHOLD"}}, "c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'")
found("string_range_binary", "customer", {"c_mktsegment": {"$gt": "BUILDING"}}, "c_mktsegment > 'BUILDING'", string_order="binary")


def holes(df: DataFrame) -> DataFrame:
    """Lines whose flag N is made missing."""
    return df.withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N"))).select("l_orderkey", "l_linenumber", "flag")


HOLES = "(SELECT l_orderkey, l_linenumber, NULLIF(l_returnflag, 'N') AS flag FROM lineitem)"
for _name, _query, _where in (
    ("eq", {"flag": "R"}, "flag = 'R'"),
    ("ne", {"flag": {"$ne": "R"}}, "flag IS DISTINCT FROM 'R'"),
    ("in", {"flag": {"$in": ["R", None]}}, "flag = 'R'"),
    ("nin", {"flag": {"$nin": ["R"]}}, "flag IS NULL OR flag <> 'R'"),
    ("exists", {"flag": {"$exists": True}}, "flag IS NOT NULL"),
    ("exists_false", {"flag": {"$exists": False}}, "flag IS NULL"),
    ("type", {"flag": {"$type": "string"}}, "flag IS NOT NULL"),
    ("not", {"flag": {"$not": {"$gt": "A"}}}, "flag IS NULL OR NOT flag > 'A'"),
    ("regex_not", {"flag": {"$not": {"$regex": "R"}}}, "flag IS NULL OR NOT regexp_matches(flag, 'R')"),
    ("null", {"flag": None}, "false"),
):
    found(f"missing_{_name}", "lineitem", _query, _where, prepare=holes, base=HOLES)
found("null_value_eq", "lineitem", {"flag": None}, "flag IS NULL", prepare=holes, base=HOLES, null_means="null")
found("null_value_type", "lineitem", {"flag": {"$type": ["null", "number"]}}, "flag IS NULL", prepare=holes, base=HOLES, null_means="null")


def with_nan(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("q"))


NAN = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_quantity END AS q FROM lineitem)"
for _name, _query, _where in (
    ("gt", {"q": {"$gt": 45}}, "NOT isnan(q) AND q > 45"),
    ("not_gt", {"q": {"$not": {"$gt": 45}}}, "isnan(q) OR NOT q > 45"),
    ("lt", {"q": {"$lt": 5}}, "NOT isnan(q) AND q < 5"),
    ("literal", {"q": {"$ne": float("nan")}}, "true"),
):
    found(f"nan_{_name}", "lineitem", _query, _where, prepare=with_nan, columns="l_orderkey, l_linenumber, CASE WHEN isnan(q) THEN NULL ELSE q END AS q", base=NAN)
    QUERIES[f"nan_{_name}"] = lambda s, d, f=QUERIES[f"nan_{_name}"]: f(s, d).withColumn("q", F.nanvl("q", F.lit(None).cast("double")))


# -- VARIANT documents ------------------------------------------------------------------------


def variants(df: DataFrame) -> DataFrame:
    """Events as schemaless documents of mixed types."""
    kind = F.pmod("event_id", F.lit(6))
    value = (F.when(kind == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(kind == 1, F.lit("null")).when(kind == 2, F.lit("true"))
             .when(kind == 3, F.concat(F.lit("["), F.pmod("event_id", F.lit(4)).cast("string"), F.lit(",1]"))).when(kind == 4, F.concat(F.lit('{"k":'), F.pmod("event_id", F.lit(3)).cast("string"), F.lit("}")))
             .otherwise(F.pmod("event_id", F.lit(100)).cast("string")))
    text = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(F.pmod("event_id", F.lit(7)) == 0, "").otherwise(F.concat(F.lit(',"v":'), value)), F.lit("}"))
    return df.select("event_id", F.parse_json(text).alias("doc"))


VARIANTS = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing' ELSE ['string', 'null', 'boolean', 'array', 'object', 'number'][event_id % 6 + 1] END AS kind,
 event_type, event_id % 100 AS num, event_id % 4 AS item, event_id % 3 AS k FROM events)"""
for _name, _query, _where in (
    ("eq_number", {"v": 17}, "kind = 'number' AND num = 17"),
    ("eq_string", {"v": "click"}, "kind = 'string' AND event_type = 'click'"),
    ("eq_boolean", {"v": True}, "kind = 'boolean'"),
    ("eq_null", {"v": None}, "kind = 'null'"),
    ("eq_array", {"v": [3, 1]}, "kind = 'array' AND item = 3"),
    ("eq_object", {"v": {"k": 1}}, "kind = 'object' AND k = 1"),
    ("ne", {"v": {"$ne": 17}}, "NOT (kind = 'number' AND num = 17)"),
    ("range", {"v": {"$gte": 10, "$lt": 50}}, "kind = 'number' AND num >= 10 AND num < 50"),
    ("not_range", {"v": {"$not": {"$gte": 10}}}, "NOT (kind = 'number' AND num >= 10)"),
    ("in", {"v": {"$in": [5, "view", None, [1, 1]]}}, "(kind = 'number' AND num = 5) OR (kind = 'string' AND event_type = 'view') OR kind = 'null' OR (kind = 'array' AND item = 1)"),
    ("nin", {"v": {"$nin": [5, None]}}, "NOT ((kind = 'number' AND num = 5) OR kind = 'null')"),
    ("exists", {"v": {"$exists": True}}, "kind <> 'missing'"),
    ("exists_false", {"v": {"$exists": False}}, "kind = 'missing'"),
    ("regex", {"v": {"$regex": "^(click|view)$"}}, "kind = 'string' AND event_type IN ('click', 'view')"),
    ("type_number", {"v": {"$type": "number"}}, "kind = 'number'"),
    ("type_any", {"v": {"$type": ["bool", "array", "object", "null"]}}, "kind IN ('boolean', 'array', 'object', 'null')"),
    ("nor", {"$nor": [{"v": {"$type": "string"}}, {"v": {"$exists": False}}]}, "kind NOT IN ('string', 'missing')"),
):
    found(f"variant_{_name}", "events", _query, _where, prepare=variants, columns="event_id", base=VARIANTS, doc_column="doc")

register("variant_sort", lambda s, d: frames.find(variants(table(s, d, "events")), {"v": {"$not": {"$type": ["array", "object"]}}}, doc_column="doc", order_by=["event_id"]).sort({"v": -1, "id": 1}).skip(5).limit(50).to_df().select("event_id"),
         f"SELECT event_id FROM {VARIANTS} WHERE kind NOT IN ('array', 'object') ORDER BY CASE kind WHEN 'string' THEN 3 WHEN 'number' THEN 2 WHEN 'boolean' THEN 1 ELSE 0 END DESC, "
         "CASE WHEN kind = 'string' THEN event_type END DESC NULLS LAST, CASE WHEN kind = 'number' THEN num END DESC NULLS LAST, event_id LIMIT 50 OFFSET 5")
register("variant_distinct", lambda s, d: frames.distinct(variants(table(s, d, "events")), "v", {"v": {"$type": ["array", "object", "boolean", "null"]}}, doc_column="doc", order_by=["event_id"]).select(F.to_json("value").alias("value")),
         f"""SELECT DISTINCT CASE kind WHEN 'array' THEN '[' || item || ',1]' WHEN 'object' THEN '{{"k":' || k || '}}' WHEN 'boolean' THEN 'true' ELSE 'null' END AS value FROM {VARIANTS} WHERE kind IN ('array', 'object', 'boolean', 'null')""")


# -- order, slices, aggregates ----------------------------------------------------------------


def cursor(source: str, query: dict, order: dict, skip: int = 0, limit: int | None = None, prepare=None):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        c = frames.find(prepare(df) if prepare else df, query).sort(order).skip(skip)
        return (c if limit is None else c.limit(limit)).to_df()

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest returned lines with a large quantity."""
    return QUERIES["sort_top"](spark, sf_dir)


register("sort_top", cursor("lineitem", {"l_returnflag": "R", "l_quantity": {"$gt": 45}}, {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}, limit=10),
         "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
register("sort_skip_limit", cursor("orders", {"o_orderstatus": "F"}, {"o_totalprice": 1, "o_orderkey": 1}, 20, 30),
         "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 20")
# Whole tables in order: no rows cut off, no ids picked.
register("sort_multi", cursor("customer", {}, {"c_mktsegment": 1, "c_acctbal": -1, "c_custkey": 1}),
         "SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
register("sort_nulls", cursor("lineitem", {}, {"flag": 1, "l_orderkey": -1, "l_linenumber": 1}, prepare=holes),
         f"SELECT * FROM {HOLES} ORDER BY flag ASC NULLS FIRST, l_orderkey DESC, l_linenumber")
register("sort_nulls_desc", cursor("lineitem", {}, {"flag": -1, "l_orderkey": 1, "l_linenumber": 1}, 10, prepare=holes),
         f"SELECT * FROM {HOLES} ORDER BY flag DESC NULLS LAST, l_orderkey, l_linenumber OFFSET 10")
register("find_one_sorted", cursor("part", {}, {"p_retailprice": -1, "p_partkey": 1}, limit=1), "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
register("limit_zero", cursor("part", {}, {"p_partkey": 1}, limit=0), "SELECT * FROM part LIMIT 0")
register("skip_past_end", cursor("nation", {}, {"n_nationkey": 1}, 1000), "SELECT * FROM nation LIMIT 0")
register("count_all", lambda s, d: frames.count_documents(table(s, d, "lineitem")), "SELECT count(*) AS n FROM lineitem")
register("count_filtered", lambda s, d: frames.count_documents(table(s, d, "lineitem"), {"l_returnflag": {"$ne": "N"}}), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'N'")
register("count_ignores_slice", lambda s, d: s.createDataFrame([(frames.find(table(s, d, "orders"), {"o_orderstatus": "O"}).sort({"o_orderkey": 1}).skip(3).limit(5).count(),)], "n long"),
         "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
register("distinct", lambda s, d: frames.distinct(table(s, d, "lineitem"), "l_returnflag"), "SELECT DISTINCT l_returnflag AS value FROM lineitem")
register("distinct_ordered", lambda s, d: frames.distinct(table(s, d, "orders"), "o_orderpriority", order_by=["o_orderkey"]), "SELECT DISTINCT o_orderpriority AS value FROM orders")
register("distinct_filtered", lambda s, d: frames.distinct(table(s, d, "lineitem"), "l_linestatus", {"l_returnflag": "A"}), "SELECT DISTINCT l_linestatus AS value FROM lineitem WHERE l_returnflag = 'A'")
register("distinct_missing", lambda s, d: frames.distinct(holes(table(s, d, "lineitem")), "flag"), "SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_returnflag <> 'N'")
register("distinct_null_kept", lambda s, d: frames.distinct(holes(table(s, d, "lineitem")), "flag", null_means="null"), f"SELECT DISTINCT flag AS value FROM {HOLES}")


# -- updates ----------------------------------------------------------------------------------


def lists(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.array("l_returnflag", "l_linestatus", F.lit("F")).alias("tags"), F.array("l_linenumber", F.lit(3), F.lit(5)).alias("nums"))


LISTS = "(SELECT l_orderkey, l_linenumber, l_quantity, [l_returnflag, l_linestatus, 'F'] AS tags, [l_linenumber, 3, 5] AS nums FROM lineitem)"


def updated(name: str, source: str, query: dict, update: dict, sql: str, prepare=None, pick: list | None = None) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        out = apply_update(prepare(df) if prepare else df, query, update)
        return out.select(*pick) if pick else out

    register(name, run, sql)


LARGE = {"l_quantity": {"$gt": 40}}
updated("upd_set", "nation", {"n_regionkey": 1}, {"$set": {"n_name": "X", "tag": 7}}, "SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 7::BIGINT END AS tag FROM nation")
updated("upd_unset", "nation", {"n_nationkey": {"$gte": 10}}, {"$unset": {"n_name": ""}}, "SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey >= 10 THEN NULL ELSE n_name END AS n_name FROM nation")
updated("upd_inc", "customer", {"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10}}, "SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal) FROM customer")
updated("upd_mul", "customer", {"c_custkey": {"$lte": 100}}, {"$mul": {"c_custkey": 3}}, "SELECT * REPLACE (CASE WHEN c_custkey <= 100 THEN c_custkey * 3 ELSE c_custkey END AS c_custkey) FROM customer")
updated("upd_min", "lineitem", LARGE, {"$min": {"l_quantity": 42}}, "SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN least(l_quantity, 42) ELSE l_quantity END AS l_quantity) FROM lineitem")
updated("upd_max", "lineitem", LARGE, {"$max": {"l_quantity": 48}}, "SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN greatest(l_quantity, 48) ELSE l_quantity END AS l_quantity) FROM lineitem")
updated("upd_rename", "nation", {"n_regionkey": 2}, {"$rename": {"n_name": "label"}}, "SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN n_name END AS label FROM nation")
updated("upd_push", "lineitem", LARGE, {"$push": {"tags": "Z"}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN list_append(tags, 'Z') ELSE tags END AS tags) FROM {LISTS}", lists)
updated("upd_add_to_set", "lineitem", LARGE, {"$addToSet": {"tags": "R"}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 AND NOT list_contains(tags, 'R') THEN list_append(tags, 'R') ELSE tags END AS tags) FROM {LISTS}", lists)
updated("upd_pop_last", "lineitem", LARGE, {"$pop": {"tags": 1}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN tags[1:2] ELSE tags END AS tags) FROM {LISTS}", lists)
updated("upd_pop_first", "lineitem", LARGE, {"$pop": {"tags": -1}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN tags[2:3] ELSE tags END AS tags) FROM {LISTS}", lists)
updated("upd_pull", "lineitem", LARGE, {"$pull": {"tags": "F"}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN list_filter(tags, lambda x: x <> 'F') ELSE tags END AS tags) FROM {LISTS}", lists)
updated("upd_pull_op", "lineitem", LARGE, {"$pull": {"nums": {"$gte": 3, "$ne": 5}}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN list_filter(nums, lambda x: NOT (x >= 3 AND x <> 5)) ELSE nums END AS nums) FROM {LISTS}", lists)
updated("upd_pull_all", "lineitem", LARGE, {"$pullAll": {"nums": [1, 5, "x"]}}, f"SELECT * REPLACE (CASE WHEN l_quantity > 40 THEN list_filter(nums, lambda x: x NOT IN (1, 5)) ELSE nums END AS nums) FROM {LISTS}", lists)
updated("upd_multi_op_order", "customer", {"c_acctbal": {"$lt": 0}}, {"$mul": {"c_acctbal": 2}, "$inc": {"c_acctbal": 5}, "$max": {"c_acctbal": -100}, "$set": {"c_mktsegment": "DEBT"}},
        "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN greatest(c_acctbal * 2 + 5, -100) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
register("upd_current_date", lambda s, d: apply_update(table(s, d, "nation"), {}, {"$currentDate": {"at": True, "ms": {"$type": "timestamp"}}}))
register("upd_variant", lambda s, d: apply_update(variants(table(s, d, "events")), {"v": {"$type": "number"}}, {"$inc": {"v": 1000}, "$set": {"w": "x"}, "$rename": {"id": "key"}}, doc_column="doc").select("event_id", F.to_json("doc").alias("json")).where(F.col("json").contains('"w"')).select("event_id", F.get_json_object("json", "$.v").cast("long").alias("v"), F.get_json_object("json", "$.key").cast("long").alias("key")),
         f"SELECT event_id, (num + 1000)::BIGINT AS v, event_id AS key FROM {VARIANTS} WHERE kind = 'number'")
EIGHT = [f"c{i}" for i in range(8)]
register("upd_variant_many", lambda s, d: apply_update(table(s, d, "events").select("event_id", F.parse_json(F.to_json(F.struct(*(F.pmod("user_id", F.lit(i + 2)).alias(c) for i, c in enumerate(EIGHT))))).alias("doc")), {}, {"$inc": {c: 10 * i for i, c in enumerate(EIGHT)}}, doc_column="doc").select("event_id", *(F.variant_get("doc", f"$.{c}", "long").alias(c) for c in EIGHT)),
         "SELECT event_id, " + ", ".join(f"(user_id % {i + 2} + {10 * i})::BIGINT AS {c}" for i, c in enumerate(EIGHT)) + " FROM events")
register("upd_variant_arrays", lambda s, d: apply_update(variants(table(s, d, "events")), {"v": {"$type": "array"}}, {"$push": {"v": "z"}, "$pull": {"v": {"$lt": 2}}, "$addToSet": {"v": 3}}, doc_column="doc").where(F.schema_of_variant(F.variant_get("doc", "$.v", "variant")).startswith("ARRAY")).select("event_id", F.to_json(F.variant_get("doc", "$.v", "variant")).alias("v")),
         f"""SELECT event_id, CASE item WHEN 2 THEN '[2,"z",3]' WHEN 3 THEN '[3,"z"]' ELSE '["z",3]' END AS v FROM {VARIANTS} WHERE kind = 'array'""")
register("duplicate_keys", lambda s, d: frames.duplicates(table(s, d, "nation"), "n_regionkey", "number"), "SELECT n_regionkey AS value, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")


# -- codecs and the store -----------------------------------------------------------------------

for _codec in ("json", "bson", "amf3"):
    register(f"codec_roundtrip_{_codec}", lambda s, d, c=_codec: codecs.round_trip(table(s, d, "customer"), c),
             "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")


def store_of(spark: SparkSession, sf_dir: str):
    """A fresh database in the shared folder with the nations as documents."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docframe_")
    db = open_db(spark, f"{base}/store_{spark.range(1).select(F.expr('uuid()')).first()[0]}")
    docs = table(spark, sf_dir, "nation").select(F.to_json(F.struct("*")).alias("doc"))
    nations = db.collection("nations")
    nations.insert_frame(docs)
    return db, nations


def fields(df: DataFrame) -> DataFrame:
    get = lambda name, kind: F.try_variant_get("doc", f"$.{name}", kind).alias(name)
    return df.select(get("n_nationkey", "int"), get("n_name", "string"), get("n_regionkey", "int"))


def stored(change):
    def run(spark, sf_dir):
        db, nations = store_of(spark, sf_dir)
        try:
            return change(db, nations)
        finally:
            db.close()

    return run


def after(*steps):
    """The nations after some writes."""

    def change(db, nations):
        for step in steps:
            step(db, nations)
        return fields(nations.to_df())

    return stored(change)


register("store_insert_many", after(lambda _, c: c.insert_many([{"n_nationkey": 100, "n_name": "NEW", "n_regionkey": 9}, {"n_nationkey": 101}])),
         "SELECT * FROM nation UNION ALL VALUES (100, 'NEW', 9), (101, NULL, NULL)")
register("store_update_many", after(lambda _, c: c.update_many({"n_regionkey": 3}, {"$inc": {"n_nationkey": 500}, "$set": {"n_name": "EU"}})),
         "SELECT CASE WHEN n_regionkey = 3 THEN n_nationkey + 500 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey = 3 THEN 'EU' ELSE n_name END AS n_name, n_regionkey FROM nation")
register("store_update_one", after(lambda _, c: c.update_one({"n_nationkey": 4}, {"$set": {"n_regionkey": 77}})), "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 4 THEN 77 ELSE n_regionkey END AS n_regionkey FROM nation")
register("store_delete_many", after(lambda _, c: c.delete_many({"n_regionkey": {"$in": [0, 4]}})), "SELECT * FROM nation WHERE n_regionkey NOT IN (0, 4)")
register("store_delete_one", after(lambda _, c: c.delete_one({"n_nationkey": 7})), "SELECT * FROM nation WHERE n_nationkey <> 7")
register("store_replace_one", after(lambda _, c: c.replace_one(c.find_one({"n_nationkey": 5})["_id"], {"n_nationkey": 5, "n_name": "REPLACED"})),
         "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'REPLACED' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 5 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
register("store_compact", after(lambda _, c: c.delete_many({"n_regionkey": 1}), lambda _, c: c.create_index("n_name"), lambda db, _: db.compact()), "SELECT * FROM nation WHERE n_regionkey <> 1")


def refused(step, text: str):
    """A step that must fail with ``text`` in its message."""

    def run(db, nations):
        try:
            step(db, nations)
        except DocframeError as e:
            if text not in str(e):
                raise
        else:
            raise AssertionError(f"not refused: {text}")

    return run


register("store_insert_one", after(lambda _, c: c.insert_one({"n_nationkey": 200, "n_name": "ONE", "n_regionkey": 1})), "SELECT * FROM nation UNION ALL VALUES (200, 'ONE', 1)")
register("store_unique_conflict", after(lambda _, c: c.create_index("n_name", unique=True), refused(lambda _, c: c.insert_one({"n_nationkey": 300, "n_name": c.find_one({"n_nationkey": 3})["n_name"]}), "is already used by document"),
                                        refused(lambda _, c: c.insert_many([{"n_name": "TWICE"}, {"n_name": "TWICE"}]), "both use value"), refused(lambda _, c: c.update_many({"n_regionkey": 2}, {"$set": {"n_name": "SAME"}}), "both use value")), "SELECT * FROM nation")
def found(cursor) -> DataFrame:
    return fields(cursor.to_df().select(F.parse_json("json").alias("doc")))


register("store_find_by_id", stored(lambda _, c: found(c.find({"_id": c.find_one({"n_nationkey": 9})["_id"]}))), "SELECT * FROM nation WHERE n_nationkey = 9")
register("store_drop", stored(lambda db, c: (c.drop(), db.collection("nations").insert_one({"n_nationkey": 1}), fields(db.collection("nations").to_df()))[2]), "SELECT 1::INT AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INT AS n_regionkey")
register("store_indexed_find", stored(lambda _, c: (c.create_index("n_regionkey", "number"), c.create_index("n_name"), c.drop_index("n_name"), found(c.find({"n_regionkey": 2})))[3]), "SELECT * FROM nation WHERE n_regionkey = 2")


register("store_find_after_compact", stored(lambda db, c: (c.create_index("n_nationkey", "number"), c.update_many({"n_regionkey": 2}, {"$inc": {"n_nationkey": 100}}), db.compact(), found(c.find({"n_nationkey": {"$gte": 10, "$lt": 110}})))[3]),
         "SELECT * FROM (SELECT CASE WHEN n_regionkey = 2 THEN n_nationkey + 100 ELSE n_nationkey END::INT AS n_nationkey, n_name, n_regionkey FROM nation) WHERE n_nationkey >= 10 AND n_nationkey < 110")
register("store_natural_order", stored(lambda _, c: (c.insert_one({"n_nationkey": 500}), c.update_many({"n_nationkey": {"$lt": 5}}, {"$set": {"n_regionkey": 50}}), found(c.find().skip(25)))[2]), "SELECT 500::INT AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INT AS n_regionkey")


def _recover(db, nations):
    """A batch without its commit is gone after the next opening."""
    nations._write(nations._rows([{"_id": "a" * 24, "n_nationkey": 900}], 10_000))
    db.close()
    again = open_db(db.spark, db.path)
    try:
        assert again.recovered
        return fields(again.collection("nations").to_df())
    finally:
        again.close()


def _import(db, nations):
    """The nations through a file of the older format; the first is deleted there, a second collection dropped."""
    def record(name: str, payload: bytes) -> bytes:
        payload += b"\0" * (-len(payload) % 4)
        body = name.encode() + struct.pack(">I", len(payload)) + payload
        return body + struct.pack(">I", zlib.crc32(body))

    def put(collection: bytes, number: int, document: dict) -> bytes:
        raw = bson.encode(document)
        return record("put1", collection + number.to_bytes(12, "big") + amf3.u29(len(raw)) + raw)

    rows = [json.loads(r["json"]) for r in nations.find().to_df().collect()]
    data = b"........\0\1b\0" + record("ncl1", b"0001\3all") + record("ncl1", b"0002\4gone")
    for d in rows:
        data += put(b"0001", d["n_nationkey"], {k: v for k, v in d.items() if k != "_id"}) + put(b"0002", d["n_nationkey"], {"n_nationkey": 1})
    data += record("del1", b"0001" + (0).to_bytes(12, "big")) + record("idx1", b"0001\2\1\13n_nationkey") + record("dco1", b"0002")
    db.folder.create("old.bin", data)
    import_framed(db, db.folder.uri("old.bin"))
    return fields(db.collection("all").to_df())


register("store_recover", stored(_recover), "SELECT * FROM nation")
register("store_import", stored(_import), "SELECT * FROM nation WHERE n_nationkey <> 0")


def _stats(db, nations):
    nations.delete_many({"n_regionkey": 1})
    s = db.stats()
    return db.spark.createDataFrame([(s["collectionCount"], s["documentCount"], s["operationCount"], s["tombstoneCount"])], "collections long, documents long, operations long, tombstones long")


register("store_stats", stored(_stats), "SELECT 1::BIGINT AS collections, count(*) FILTER (n_regionkey <> 1) AS documents, count(*) + count(*) FILTER (n_regionkey = 1) AS operations, count(*) FILTER (n_regionkey = 1) AS tombstones FROM nation")
