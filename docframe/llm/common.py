"""What the corpus operators share: tables in the shared folder, ``let`` bindings, input columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import rolling

#: White space that separates words: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


#: Rows and bytes to an Arrow batch, where the session sets nothing: texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only on one machine may that be unset; a local folder is made then, once a session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docframe_")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def modest_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, unless the session already says how much."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def release(result=None):
    """``result``, after giving back to the system what a Python worker has freed.

    Workers live on from stage to stage, next to others; the end of a partition or of a group is
    where their memory is let go.
    """
    rolling.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)
    return result


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends in files that outlive any executor, and later uses scan only the columns
    they need.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave, once all that reads them has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_hashes(counted: DataFrame, key: str, n: str, part: int = 1000) -> list[int]:
    """Hashes of the keys that hold more than one row in ``part``, fewer than ``part`` of them.

    ``counted`` has a row per ``key``, with its number of rows ``n``.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counted.where(F.col(n) > total // part).select(F.xxhash64(key)).collect()]


def salt_of(key: str, hot: list[int], salts: int, by: Column) -> Column:
    """The copy of its key that a row looks up: one of ``salts`` for hot keys, else the only one."""
    return F.when(F.xxhash64(key).isin(hot), F.pmod(by, F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salts_of(key: str, hot: list[int], salts: int) -> Column:
    """All copies that a key needs, as an array."""
    return F.when(F.xxhash64(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A column used inside a lambda may be inlined by the optimizer and recomputed for every
    element; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; all-ASCII texts take the fast built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
