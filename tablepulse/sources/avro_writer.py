"""A small Avro container writer, for fixtures."""

import json
import struct
import zlib


def long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def text(s) -> bytes:
    b = s.encode() if isinstance(s, str) else s
    return long(len(b)) + b


def value(schema, v) -> bytes:
    if isinstance(schema, list):
        k = 0 if v is None else next(i for i, s in enumerate(schema) if s != "null")
        return long(k) + value(schema[k], v)
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "record":
        return b"".join(value(f["type"], v.get(f["name"])) for f in schema["fields"])
    if kind == "array":
        return (long(len(v)) + b"".join(value(schema["items"], x) for x in v) if v else b"") + long(0)
    if kind == "map":
        return (long(len(v)) + b"".join(text(k) + value(schema["values"], x) for k, x in v.items()) if v else b"") + long(0)
    if kind == "enum":
        return long(schema["symbols"].index(v))
    return {"null": lambda: b"", "boolean": lambda: bytes([v]), "int": lambda: long(v), "long": lambda: long(v), "double": lambda: struct.pack("<d", v), "float": lambda: struct.pack("<f", v), "string": lambda: text(v), "bytes": lambda: text(v)}[kind]()


def container(schema, rows, codec="null") -> bytes:
    sync = bytes(range(16))
    block = b"".join(value(schema, r) for r in rows)
    if codec == "deflate":
        z = zlib.compressobj(wbits=-15)
        block = z.compress(block) + z.flush()
    meta = long(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text(codec) + long(0)
    return b"Obj\x01" + meta + sync + long(len(rows)) + long(len(block)) + block + sync


def pair_map(name, key, val):
    return ["null", {"type": "array", "items": {"type": "record", "name": name, "fields": [{"name": "key", "type": key}, {"name": "value", "type": val}]}}]


def field(name, kind):
    return {"name": name, "type": kind}


MANIFEST = {
    "type": "record",
    "name": "manifest_entry",
    "fields": [
        field("status", "int"),
        field("snapshot_id", ["null", "long"]),
        field(
            "data_file",
            {
                "type": "record",
                "name": "r2",
                "fields": [
                    field("content", "int"),
                    field("file_path", "string"),
                    field("file_format", "string"),
                    field("partition", {"type": "record", "name": "r102", "fields": [field("day", ["null", "int"]), field("kind", ["null", "string"])]}),
                    field("record_count", "long"),
                    field("file_size_in_bytes", "long"),
                    field("column_sizes", pair_map("k1", "int", "long")),
                    field("value_counts", pair_map("k2", "int", "long")),
                    field("null_value_counts", ["null", {"type": "map", "values": "long"}]),
                    field("equality_ids", ["null", {"type": "array", "items": "int"}]),
                    field("sort_order_id", ["null", "int"]),
                ],
            },
        ),
    ],
}
LIST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [field("manifest_path", "string"), field("manifest_length", "long"), field("partition_spec_id", "int"), field("content", "int"), field("added_snapshot_id", "long"), field("added_files_count", "int")],
}


def entry(path, size, rows, status=1, content=0, partition=None, **more):
    return {"status": status, "snapshot_id": 1, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "partition": partition or {}, "record_count": rows, "file_size_in_bytes": size, **more}}


def write_table(folder, files, snapshots=None, schemas=None, extra=(), properties=None, codec="null", spec=(), top="s3://bucket/x"):
    """A table below ``folder``; ``files`` are manifest entries, ``extra`` names of unreferenced data files."""
    (folder / "metadata").mkdir(parents=True)
    (folder / "data").mkdir()
    data = container(MANIFEST, files, codec)
    (folder / "metadata/m1.avro").write_bytes(data)
    listed = {"manifest_path": f"{top}/metadata/m1.avro", "manifest_length": len(data), "partition_spec_id": 0, "content": 0, "added_snapshot_id": 1, "added_files_count": len(files)}
    (folder / "metadata/snap-1.avro").write_bytes(container(LIST, [listed], codec))
    snapshots = snapshots or [(1, 1_700_000_000_000)]
    schemas = schemas or [[("id", "long"), ("name", "string")]]
    doc = {
        "format-version": 2,
        "location": top,
        "current-snapshot-id": snapshots[0][0],
        "properties": properties or {},
        "schemas": [{"schema-id": k, "fields": [{"id": i + 1, "name": n, "type": t, "required": False} for i, (n, t) in enumerate(s)]} for k, s in enumerate(schemas)],
        "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 1, "field-id": 1000, "name": n, "transform": "identity"} for n in spec]}],
        "snapshots": [{"snapshot-id": i, "timestamp-ms": t, "summary": {"operation": "append"}, "manifest-list": f"{top}/metadata/snap-1.avro"} for i, t in snapshots],
        "refs": {"main": {"snapshot-id": snapshots[0][0], "type": "branch"}},
    }
    (folder / "metadata/v1.metadata.json").write_text(json.dumps(doc))
    (folder / "metadata/version-hint.text").write_text("1")
    for e in files:
        (folder / "data" / e["data_file"]["file_path"].rsplit("/", 1)[-1]).write_bytes(b"x")
    for name in extra:
        (folder / "data" / name).write_bytes(b"x")
