"""A small codec for Avro container files: header, blocks, and values by schema. No library of that kind is needed."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

MAGIC = b"Obj\x01"
PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}


class Names:
    """Named types by full name."""

    def __init__(self, schema: Any):
        self.types: dict[str, Any] = {}
        self._collect(schema)

    def _collect(self, s: Any) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x)
        elif isinstance(s, dict):
            kind = s["type"]
            if kind in ("record", "enum", "fixed"):
                self.types[s["name"]] = s
            for f in s.get("fields", []):
                self._collect(f["type"])
            for key in ("items", "values"):
                if key in s:
                    self._collect(s[key])
            if isinstance(kind, (dict, list)):
                self._collect(kind)

    def of(self, s: Any) -> Any:
        while isinstance(s, dict) and isinstance(s["type"], (dict, list)):
            s = s["type"]
        return self.types[s] if isinstance(s, str) and s not in PRIMITIVES else s


def read_long(f: BinaryIO) -> int:
    out = shift = 0
    while True:
        byte = f.read(1)
        if not byte:
            raise EOFError
        out |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def write_long(f: BinaryIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        f.write(bytes([(n & 0x7F) | 0x80]))
        n >>= 7
    f.write(bytes([n]))


def read_value(f: BinaryIO, s: Any, names: Names) -> Any:
    s = names.of(s)
    if isinstance(s, list):
        return read_value(f, s[read_long(f)], names)
    kind = s if isinstance(s, str) else s["type"]
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return read_long(f)
    if kind == "float":
        return struct.unpack("<f", f.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", f.read(8))[0]
    if kind in ("bytes", "string"):
        data = f.read(read_long(f))
        return data.decode() if kind == "string" else data
    if kind == "fixed":
        return f.read(s["size"])
    if kind == "enum":
        return s["symbols"][read_long(f)]
    if kind == "record":
        return {x["name"]: read_value(f, x["type"], names) for x in s["fields"]}
    out: Any = [] if kind == "array" else {}
    while n := read_long(f):
        if n < 0:
            n = -n
            read_long(f)
        for _ in range(n):
            if kind == "array":
                out.append(read_value(f, s["items"], names))
            else:
                key = read_value(f, "string", names)
                out[key] = read_value(f, s["values"], names)
    return out


def _fits(value: Any, s: Any, names: Names) -> bool:
    s = names.of(s)
    kind = s if isinstance(s, str) else s["type"]
    return {
        "null": lambda: value is None,
        "boolean": lambda: isinstance(value, bool),
        "int": lambda: isinstance(value, int) and not isinstance(value, bool),
        "long": lambda: isinstance(value, int) and not isinstance(value, bool),
        "float": lambda: isinstance(value, (int, float)) and not isinstance(value, bool),
        "double": lambda: isinstance(value, (int, float)) and not isinstance(value, bool),
        "string": lambda: isinstance(value, str),
        "bytes": lambda: isinstance(value, bytes),
        "fixed": lambda: isinstance(value, bytes) and len(value) == s["size"],
        "enum": lambda: value in s["symbols"],
        "array": lambda: isinstance(value, (list, tuple)),
        "map": lambda: isinstance(value, dict),
        "record": lambda: isinstance(value, dict),
    }[kind]()


def write_value(f: BinaryIO, value: Any, s: Any, names: Names, branch: str | None = None) -> None:
    """branch: the name of the union's record to write."""
    s = names.of(s)
    if isinstance(s, list):
        for i, b in enumerate(s):
            of = names.of(b)
            if (isinstance(of, dict) and of.get("name") == branch) if branch else _fits(value, b, names):
                write_long(f, i)
                return write_value(f, value, b, names)
        raise ValueError(f"no branch of the union for {value!r:.80}")
    kind = s if isinstance(s, str) else s["type"]
    if kind == "boolean":
        f.write(b"\x01" if value else b"\x00")
    elif kind in ("int", "long"):
        write_long(f, int(value))
    elif kind in ("float", "double"):
        f.write(struct.pack("<f" if kind == "float" else "<d", value))
    elif kind in ("bytes", "string"):
        data = value.encode() if kind == "string" else value
        write_long(f, len(data))
        f.write(data)
    elif kind == "fixed":
        f.write(value)
    elif kind == "enum":
        write_long(f, s["symbols"].index(value))
    elif kind == "record":
        for x in s["fields"]:
            if x["name"] not in value and "default" not in x:
                write_value(f, None, x["type"], names)
            else:
                write_value(f, value.get(x["name"], x.get("default")), x["type"], names)
    elif kind in ("array", "map"):
        if value:
            write_long(f, len(value))
            for x in value.items() if kind == "map" else value:
                if kind == "map":
                    write_value(f, x[0], "string", names)
                write_value(f, x[1] if kind == "map" else x, s["values" if kind == "map" else "items"], names)
        write_long(f, 0)
    return None


_META = {"type": "map", "values": "bytes"}


def read_header(f: BinaryIO) -> tuple[Any, str, bytes]:
    """Schema, compression, sync marker."""
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = read_value(f, _META, Names("null"))
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def write_header(f: BinaryIO, schema: Any, codec: str = "deflate") -> bytes:
    sync = os.urandom(16)
    f.write(MAGIC)
    write_value(f, {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}, _META, Names("null"))
    f.write(sync)
    return sync


def blocks(f: BinaryIO, sync: bytes) -> Iterator[tuple[int, bytes]]:
    """Number of records and the compressed bytes of each block."""
    while True:
        try:
            n = read_long(f)
        except EOFError:
            return
        data = f.read(read_long(f))
        if f.read(16) != sync:
            raise ValueError("a block doesn't end with the sync marker")
        yield n, data


def unpack(data: bytes, codec: str) -> io.BytesIO:
    if codec not in ("null", "deflate"):
        raise ValueError(f"compression {codec} is not supported")
    return io.BytesIO(zlib.decompress(data, -15) if codec == "deflate" else data)


def pack(data: bytes, codec: str = "deflate") -> bytes:
    if codec == "null":
        return data
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def write_block(f: BinaryIO, n: int, packed: bytes, sync: bytes) -> None:
    write_long(f, n)
    write_long(f, len(packed))
    f.write(packed)
    f.write(sync)
