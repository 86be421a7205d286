"""Documents from files: JSON lines as VARIANT, and single-file databases of the older format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.codecs.legacy import import_files


def read_json(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One VARIANT column from JSON lines; types may differ from line to line."""
    return spark.read.option("singleVariantColumn", column).json(path)


def write_json(df: DataFrame, path: str, column: str = "doc") -> None:
    """JSON lines from a VARIANT column."""
    df.select(F.to_json(column).alias("value")).write.text(path)


def read_framed(spark: SparkSession, path: str, magic: bytes | None = None) -> DataFrame:
    """Live documents ``file, collection, name, _id, doc, first`` of files in the older framed format.

    ``collection`` is the number that a file gives the collection called ``name``, ``first`` the place
    where the document was inserted; what was dropped is gone.
    """
    operations, keys = import_files(spark, path, magic), ["file", "collection", "_id"]
    deleted = operations.where("op = 'del'").groupBy(*keys).agg(F.max("seq").alias("gone"))
    puts = operations.where("op = 'put'").join(deleted, keys, "left").where("gone IS NULL OR seq > gone").join(collections_of(operations), ["file", "collection"])
    kept = puts.where("seq > begun").groupBy(*keys, "name").agg(F.min("seq").alias("first"), F.max_by("json", "seq").alias("json"))
    return kept.select("file", "collection", "name", "_id", F.parse_json("json").alias("doc"), "first")


def collections_of(operations: DataFrame) -> DataFrame:
    """``file, collection, name, begun`` of the collections in force; ``begun`` is where they were made."""
    of_one = operations.where("op IN ('new', 'dro')").groupBy("file", "collection").agg(F.max_by(F.struct("op", "json", "seq"), "seq").alias("r"))
    return of_one.where("r.op = 'new'").select("file", "collection", F.get_json_object("r.json", "$.name").alias("name"), F.col("r.seq").alias("begun"))


def framed_indexes(spark: SparkSession, path: str, magic: bytes | None = None) -> DataFrame:
    """Indexes ``file, collection, name, field, type, unique`` in force in such files."""
    operations = import_files(spark, path, magic)
    field = F.get_json_object("json", "$.field")
    last = operations.where("op IN ('idx', 'dix')").groupBy("file", "collection", field.alias("field")).agg(F.max_by(F.struct("op", "json", "seq"), "seq").alias("r"))
    kept = last.where("r.op = 'idx'").join(collections_of(operations), ["file", "collection"]).where("r.seq > begun")
    return kept.select("file", "collection", "name", "field", F.get_json_object("r.json", "$.type").alias("type"), (F.get_json_object("r.json", "$.unique") == "true").alias("unique"))


def import_framed(db, path: str, magic: bytes | None = None) -> dict[str, int]:
    """Insert the documents of one such file into ``db`` with their ids and indexes; documents by collection.

    Only the names of collections and the definitions of indexes come to the driver.
    """
    spark = db.spark
    documents, indexes = read_framed(spark, path, magic), framed_indexes(spark, path, magic).collect()
    counts = {}
    for row in collections_of(import_files(spark, path, magic)).orderBy("file", "begun").collect():
        target = db.collection(row["name"])
        mine = documents.where((F.col("file") == row["file"]) & (F.col("collection") == row["collection"])).orderBy("first")
        fields = F.map_filter(F.col("doc").cast("map<string,variant>"), lambda k, _: k != "_id")
        whole = F.to_variant_object(F.map_concat(fields, F.create_map(F.lit("_id"), F.col("_id").cast("variant"))))
        counts[row["name"]] = counts.get(row["name"], 0) + target.insert_frame(mine.select(whole.alias("doc")))
        for index in indexes:
            if (index["file"], index["collection"]) == (row["file"], row["collection"]):
                target.create_index(index["field"], index["type"], index["unique"])
    return counts
