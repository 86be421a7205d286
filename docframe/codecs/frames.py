"""Codecs over columns.  JSON stays in the JVM; the binary formats run on Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.codecs import amf3, bson

#: Serialization byte of a stored file and the module that reads it.
BINARY = {"bson": bson, "amf3": amf3}
BYTES = {"j": "json", "b": "bson", "a": "amf3"}


def encode(value: Column, codec: str) -> Column:
    """JSON text to the codec's bytes."""
    if codec == "json":
        return F.encode(value, "UTF-8")
    module = BINARY[codec]

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else module.encode(json.loads(t)))

    return run(value)


def decode(value: Column, codec: str) -> Column:
    """The codec's bytes to JSON text."""
    if codec == "json":
        return F.decode(value, "UTF-8")
    module = BINARY[codec]

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else json.dumps(module.decode(bytes(b)), ensure_ascii=False))

    return run(value)


def round_trip(df: DataFrame, codec: str) -> DataFrame:
    """Rows encoded as documents and decoded again."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    back = df.select(decode(encode(text, codec), codec).alias("json"))
    return back.select(F.from_json("json", df.schema).alias("d")).select("d.*")
