"""AMF3 of JSON values, without reference tables; the outermost value is an object."""

from __future__ import annotations

import struct
from typing import Any

# Markers of the format.
UNDEFINED, NULL, FALSE, TRUE, INTEGER, DOUBLE, STRING, ARRAY, OBJECT = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x09, 0x0A
DYNAMIC_OBJECT = 0x0B  # inline traits, dynamic members, none sealed
INT_MIN, INT_MAX = -(2**28), 2**28 - 1
U29_MAX = 2**29 - 1


def u29(n: int) -> bytes:
    """A number of up to 29 bits in one to four bytes; the fourth carries eight bits."""
    if not 0 <= n <= U29_MAX:
        raise ValueError("a U29 number has at most 29 bits")
    if n < 0x80:
        return bytes([n])
    if n < 0x4000:
        return bytes([n >> 7 | 0x80, n & 0x7F])
    if n < 0x200000:
        return bytes([n >> 14 | 0x80, n >> 7 & 0x7F | 0x80, n & 0x7F])
    return bytes([n >> 22 | 0x80, n >> 15 & 0x7F | 0x80, n >> 8 & 0x7F | 0x80, n & 0xFF])


def read_u29(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for _ in range(3):
        byte = data[at]
        at += 1
        n = n << 7 | byte & 0x7F
        if byte < 0x80:
            return n, at
    return n << 8 | data[at], at + 1


def _text(value: str) -> bytes:
    raw = value.encode()
    return u29(len(raw) << 1 | 1) + raw


def _write(value: Any) -> bytes:
    if value is None:
        return bytes([NULL])
    if isinstance(value, bool):
        return bytes([TRUE if value else FALSE])
    if isinstance(value, int) and INT_MIN <= value <= INT_MAX:
        return bytes([INTEGER]) + u29(value & U29_MAX)
    if isinstance(value, (int, float)):
        return bytes([DOUBLE]) + struct.pack(">d", float(value))
    if isinstance(value, str):
        return bytes([STRING]) + _text(value)
    if isinstance(value, (list, tuple)):
        return bytes([ARRAY]) + u29(len(value) << 1 | 1) + _text("") + b"".join(map(_write, value))
    out = bytes([OBJECT, DYNAMIC_OBJECT]) + _text("")
    for k, v in value.items():
        if k == "":
            raise ValueError("AMF3 cannot hold an empty member name")
        out += _text(k) + _write(v)
    return out + _text("")


def encode(document: dict) -> bytes:
    if not isinstance(document, dict):
        raise ValueError("the outermost AMF3 value must be an object")
    return _write(document)


def decode(data: bytes) -> dict:
    value, at = _read(data, 0)
    if not isinstance(value, dict) or at != len(data):
        raise ValueError("not one AMF3 object")
    return value


def _inline(data: bytes, at: int) -> tuple[int, int]:
    n, at = read_u29(data, at)
    if not n & 1:
        raise ValueError("AMF3 references are not supported")
    return n >> 1, at


def _read_text(data: bytes, at: int) -> tuple[str, int]:
    size, at = _inline(data, at)
    return data[at : at + size].decode(), at + size


def _read(data: bytes, at: int) -> tuple[Any, int]:
    marker, at = data[at], at + 1
    if marker in (UNDEFINED, NULL):
        return None, at
    if marker in (FALSE, TRUE):
        return marker == TRUE, at
    if marker == INTEGER:
        n, at = read_u29(data, at)
        return (n - (1 << 29) if n > INT_MAX else n), at
    if marker == DOUBLE:
        return struct.unpack_from(">d", data, at)[0], at + 8
    if marker == STRING:
        return _read_text(data, at)
    if marker == ARRAY:
        size, at = _inline(data, at)
        _, at = _read_text(data, at)
        out = []
        for _ in range(size):
            value, at = _read(data, at)
            out.append(value)
        return out, at
    if marker == OBJECT:
        traits, at = read_u29(data, at)
        if traits != DYNAMIC_OBJECT:
            raise ValueError("only dynamic AMF3 objects are supported")
        _, at = _read_text(data, at)
        out = {}
        while True:
            name, at = _read_text(data, at)
            if not name:
                return out, at
            out[name], at = _read(data, at)
    raise ValueError(f"unsupported AMF3 marker 0x{marker:02x}")
