"""Avro object container files, decoded in plain Python by the schema they carry (codecs null, deflate, zstandard)."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

MAGIC = b"Obj\x01"


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the Avro data ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        """A zigzag number of seven bits a byte."""
        out = shift = 0
        while True:
            byte = self.take(1)[0]
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())


def _blocks(c: Cursor) -> Iterator[int]:
    while n := c.long():
        if n < 0:
            c.long()  # the size of the block
            n = -n
        yield from range(n)


_PLAIN = {
    "null": lambda c: None,
    "boolean": lambda c: c.take(1) != b"\x00",
    "int": Cursor.long,
    "long": Cursor.long,
    "float": lambda c: struct.unpack("<f", c.take(4))[0],
    "double": lambda c: struct.unpack("<d", c.take(8))[0],
    "bytes": Cursor.bytes,
    "string": lambda c: c.bytes().decode("utf-8"),
}


def read_value(schema: Any, c: Cursor, named: dict[str, Any]) -> Any:
    """One value. Unions give the value of their branch, enums their symbol, logical types the plain value."""
    if isinstance(schema, list):
        return read_value(schema[c.long()], c, named)
    if isinstance(schema, str):
        return _PLAIN[schema](c) if schema in _PLAIN else read_value(named[schema], c, named)
    kind = schema["type"]
    if kind == "record":
        return {f["name"]: read_value(f["type"], c, named) for f in schema["fields"]}
    if kind == "array":
        return [read_value(schema["items"], c, named) for _ in _blocks(c)]
    if kind == "map":
        return {c.bytes().decode("utf-8"): read_value(schema["values"], c, named) for _ in _blocks(c)}
    if kind == "enum":
        return schema["symbols"][c.long()]
    if kind == "fixed":
        return c.take(schema["size"])
    return read_value(kind, c, named)


def _name_types(schema: Any, named: dict[str, Any]) -> None:
    if isinstance(schema, list):
        for s in schema:
            _name_types(s, named)
    elif isinstance(schema, dict):
        if "name" in schema and schema.get("type") in ("record", "enum", "fixed"):
            named[schema["name"]] = schema
            if space := schema.get("namespace"):
                named[f"{space}.{schema['name']}"] = schema
        for part in [schema.get("items"), schema.get("values"), *([f["type"] for f in schema.get("fields", [])])]:
            _name_types(part, named)
        if isinstance(schema.get("type"), (dict, list)):
            _name_types(schema["type"], named)


def _inflate(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"Avro codec {codec} is not supported")


def read_container(data: bytes) -> Iterator[dict]:
    """The records of a container file."""
    c = Cursor(data)
    if c.take(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = {}
    for _ in _blocks(c):
        key = c.bytes().decode()
        meta[key] = c.bytes()
    sync = c.take(16)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    named: dict[str, Any] = {}
    _name_types(schema, named)
    while c.at < len(data):
        n = c.long()
        block = Cursor(_inflate(codec, c.bytes()))
        if c.take(16) != sync:
            raise ValueError("a block of the Avro file is damaged")
        for _ in range(n):
            yield read_value(schema, block, named)
