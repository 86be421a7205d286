"""Reader for single-file databases in the older framed format.

A file is a 12-byte header and records: identifier, length, payload padded to four bytes,
checksum.  The file is read on executors as one value, so this is for import, not for queries.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from docframe.codecs import amf3, bson
from docframe.codecs.frames import BYTES
from docframe.errors import DocframeError

# Sizes of the header and of a record's head, the versions of the format and of its
# payloads, the numbers of the index types, and the identifiers of operations.
HEADER, HEAD = 12, 8
FORMAT_VERSION, PAYLOAD_VERSION = 0, 0
INDEX_KINDS = {1: "string", 2: "number"}
OPERATIONS = ("ncl1", "dco1", "idx1", "dix1", "put1", "del1", "txnb", "txnc", "hol0")
#: What import calls an operation, and errors.
KINDS = {"ncl1": ("new", "new collection"), "dco1": ("dro", "drop collection"), "idx1": ("idx", "create index"), "dix1": ("dix", "drop index"),
         "put1": ("put", "put document"), "del1": ("del", "delete document")}


def codec_of_header(data: bytes, magic: bytes | None = None) -> str:
    """Checks a file's header and tells its codec; ``magic`` is what the first eight bytes must be.

    Of the format's two version bytes only the first must agree.
    """
    if len(data) < HEADER:
        raise DocframeError("Invalid file: header too short.")
    if magic is not None and data[:8] != magic:
        raise DocframeError(f"Invalid file: expected {magic!r} header.")
    if data[8] != FORMAT_VERSION:
        raise DocframeError(f"Unsupported format version: {data[8]}.")
    if chr(data[10]) not in BYTES:
        raise DocframeError(f"Unsupported serialization format: {chr(data[10])}.")
    if data[11] != PAYLOAD_VERSION:
        raise DocframeError(f"Unsupported serialization version: {data[11]}.")
    return BYTES[chr(data[10])]


def short_text(payload: bytes, at: int, what: str) -> str:
    """A text behind its length, up to the zeros that pad the payload."""
    size, begin = amf3.read_u29(payload, at)
    if begin + size > len(payload):
        raise DocframeError(f"Invalid {what} operation: text exceeds payload length.")
    if any(payload[begin + size :]):
        raise DocframeError(f"Invalid {what} operation: non-zero padding.")
    return payload[begin : begin + size].decode()


def definition(op: str, payload: bytes) -> dict:
    """What a record on a collection or an index says."""
    if op == "ncl1":
        return {"name": short_text(payload, 4, "new collection")}
    if op == "dix1":
        return {"field": short_text(payload, 4, "drop index")}
    if payload[4] not in INDEX_KINDS:
        raise DocframeError("Invalid create index operation: unknown index type.")
    if payload[5] > 1:
        raise DocframeError("Invalid create index operation: unrecognized payload layout.")
    return {"field": short_text(payload, 6, "create index"), "type": INDEX_KINDS[payload[4]], "unique": payload[5] == 1}


def records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Identifier and payload of each whole record; a torn last record ends the file."""
    at = HEADER
    while at + HEAD <= len(data):
        name, (size,) = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I", data, at + 4)
        end = at + HEAD + size
        if end + 4 > len(data):
            return
        payload = data[at + HEAD : end]
        if zlib.crc32(data[at:end]) != struct.unpack_from(">I", data, end)[0]:
            if end + 4 >= len(data):
                return
            raise DocframeError("Operation record CRC mismatch.")
        yield name, payload
        at = end + 4


def committed(found: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Records outside batches, and those of batches that were committed."""
    batch: list | None = None
    for name, payload in found:
        if name == "txnb":
            if batch is not None:
                raise DocframeError("Nested transaction begin.")
            batch = []
        elif name == "txnc":
            if batch is None:
                raise DocframeError("Transaction commit without begin.")
            yield from batch
            batch = None
        elif batch is not None:
            batch.append((name, payload))
        else:
            yield name, payload


def parse_payload(payload: bytes, codec: str) -> tuple[str, str, dict | None]:
    """Collection id, document id and document of a put or delete."""
    collection, key, rest = payload[:4].hex(), payload[4:16].hex(), payload[16:]
    if not rest.strip(b"\0"):
        return collection, key, None
    size, at = amf3.read_u29(rest, 0)
    body = rest[at : at + size]
    document = json.loads(body) if codec == "json" else (bson if codec == "bson" else amf3).decode(body)
    return collection, key, document


def operations_of(data: bytes, magic: bytes | None = None) -> Iterator[tuple[int, str, str, str | None, str | None]]:
    """``seq, op, collection, _id, json`` of a file, in the order of its records."""
    codec, known = codec_of_header(data, magic), set()
    for seq, (op, payload) in enumerate(committed(records(data))):
        if op not in OPERATIONS:
            raise DocframeError(f"Unsupported operation identifier: {op}.")
        if op == "hol0":
            continue
        collection = payload[:4].hex()
        if op == "ncl1":
            known.add(collection)
        elif collection not in known:
            raise DocframeError(f"Invalid {KINDS[op][1]} operation: unknown collection identifier.")
        key, document = None, None
        if op in ("put1", "del1"):
            _, key, document = parse_payload(payload, codec)
        elif op == "dco1":
            if len(payload) != 4:
                raise DocframeError("Invalid drop collection operation: payload must be 4 bytes.")
            known.discard(collection)
        else:
            document = definition(op, payload)
        yield seq, KINDS[op][0], collection, key, None if document is None else json.dumps(document)


def import_files(spark: SparkSession, path: str, magic: bytes | None = None) -> DataFrame:
    """Operations ``file, seq, op, collection, _id, json`` of all files that ``path`` matches.

    ``op`` is ``put`` or ``del`` of a document; ``new`` or ``dro`` of a collection, with its name in
    ``json``; ``idx`` or ``dix`` of an index, with its definition there.
    """

    def read(batches):
        for batch in batches:
            out = [(name, *operation) for name, data in zip(batch["path"], batch["content"]) for operation in operations_of(bytes(data), magic)]
            yield pd.DataFrame(out, columns=["file", "seq", "op", "collection", "_id", "json"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, seq long, op string, collection string, _id string, json string")
