"""BSON documents of JSON values: double, string, document, array, boolean, null, int32, int64."""

from __future__ import annotations

import math
import struct
from typing import Any

# Element types of the format.
DOUBLE, STRING, DOCUMENT, ARRAY, BOOLEAN, NULL, INT32, INT64 = 0x01, 0x02, 0x03, 0x04, 0x08, 0x0A, 0x10, 0x12


def encode(document: dict) -> bytes:
    return _document(document.items())


def _document(items) -> bytes:
    body = b"".join(_element(str(k), v) for k, v in items)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _element(name: str, value: Any) -> bytes:
    if "\0" in name:
        raise ValueError("a BSON field name cannot hold a zero byte")
    kind, body = _value(value)
    return bytes([kind]) + name.encode() + b"\0" + body


def _value(value: Any) -> tuple[int, bytes]:
    if value is None:
        return NULL, b""
    if isinstance(value, bool):
        return BOOLEAN, bytes([value])
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 and math.copysign(1, value) > 0:
        value = int(value)
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return INT32, struct.pack("<i", value)
        if -(2**63) <= value < 2**63:
            return INT64, struct.pack("<q", value)
        value = float(value)
    if isinstance(value, float):
        return DOUBLE, struct.pack("<d", value)
    if isinstance(value, str):
        text = value.encode()
        return STRING, struct.pack("<i", len(text) + 1) + text + b"\0"
    if isinstance(value, (list, tuple)):
        return ARRAY, _document(enumerate(value))
    return DOCUMENT, encode(value)


def decode(data: bytes) -> dict:
    found, at = _read_document(data, 0)
    if at != len(data):
        raise ValueError("bytes after the BSON document")
    return dict(found)


def _read_document(data: bytes, at: int) -> tuple[list, int]:
    (size,) = struct.unpack_from("<i", data, at)
    end = at + size
    if size < 5 or end > len(data) or data[end - 1] != 0:
        raise ValueError("a BSON document is cut off")
    out, at = [], at + 4
    while at < end - 1:
        kind, stop = data[at], data.index(b"\0", at + 1)
        value, at2 = _read_value(kind, data, stop + 1)
        out.append((data[at + 1 : stop].decode(), value))
        at = at2
    return out, end


def _read_value(kind: int, data: bytes, at: int) -> tuple[Any, int]:
    if kind == NULL:
        return None, at
    if kind == BOOLEAN:
        return data[at] == 1, at + 1
    if kind in (DOUBLE, INT32, INT64):
        form = {DOUBLE: "<d", INT32: "<i", INT64: "<q"}[kind]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if kind == STRING:
        (size,) = struct.unpack_from("<i", data, at)
        return data[at + 4 : at + 3 + size].decode(), at + 4 + size
    if kind in (DOCUMENT, ARRAY):
        items, at = _read_document(data, at)
        return (dict(items) if kind == DOCUMENT else [v for _, v in items]), at
    raise ValueError(f"unsupported BSON type 0x{kind:02x}")
