"""Rows of manifest lists and manifests, in the model's columns."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import Any

from .avro import read_container

log = logging.getLogger(__name__)

_COUNTERS = ("added_files_count", "existing_files_count", "deleted_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count")
DELETED = 2
FORMATS = ("parquet", "orc", "avro")


def _number(x: Any) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _text(x: Any) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return str(x).lower()
    return x.hex() if isinstance(x, bytes) else str(x)


def _numbers(x: Any) -> dict[int, int]:
    """A map of numbers: a list of key and value records, or a real map. Entries that are no numbers are left out."""
    pairs = ((e.get("key"), e.get("value")) for e in x) if isinstance(x, list) else (x or {}).items()
    return {int(k): int(v) for k, v in pairs if str(k).lstrip("-").isdigit() and _number(v) is not None}


def manifest_list_rows(data: bytes) -> Iterator[dict]:
    """Entries of a manifest list; counters that are missing are 0."""
    for r in read_container(data):
        yield {
            "manifest_path": r.get("manifest_path"),
            "manifest_length": _number(r.get("manifest_length")) or 0,
            "partition_spec_id": _number(r.get("partition_spec_id")) or 0,
            "content": _number(r.get("content")) or 0,
            "added_snapshot_id": _number(r.get("added_snapshot_id")),
            **{c: _number(r.get(c)) or 0 for c in _COUNTERS},
        }


def manifest_rows(data: bytes, spec_id: int | None = None) -> Iterator[tuple[str, dict]]:
    """('data_files' or 'delete_files', row) for each live entry of a manifest.

    Deleted entries (status 2) are dropped; content 0, 1 and 2 are data, position deletes and equality deletes;
    entries of other content are skipped with a warning. ``spec_id``, of the manifest, stands in for a file's own.
    """
    for entry in read_container(data):
        if _number(entry.get("status")) == DELETED:
            continue
        f = entry.get("data_file") or {}
        common = {"file_path": f.get("file_path"), "file_size_bytes": _number(f.get("file_size_in_bytes")) or 0, "record_count": _number(f.get("record_count")) or 0}
        content = f.get("content")
        content = {"DATA": 0, "POSITION_DELETES": 1, "EQUALITY_DELETES": 2}.get(content, -1) if isinstance(content, str) else (_number(content) or 0)
        if content in (1, 2):
            yield "delete_files", {**common, "delete_type": "position_delete" if content == 1 else "equality_delete", "equality_ids": [int(x) for x in f.get("equality_ids") or []]}
        elif content == 0:
            partition = {k: t for k, v in (f.get("partition") or {}).items() if (t := _text(v)) is not None}
            kind = str(f.get("file_format") or "").lower()
            sizes, values, nulls = (_numbers(f.get(k)) for k in ("column_sizes", "value_counts", "null_value_counts"))
            own = _number(f.get("spec_id"))
            yield (
                "data_files",
                {
                    **common,
                    "partition": partition,
                    "partition_key": "/".join(f"{k}={v}" for k, v in sorted(partition.items())) or "<unpartitioned>",
                    "file_format": kind if kind in FORMATS else "parquet",
                    "column_sizes": sizes,
                    "value_counts": values,
                    "null_value_counts": nulls,
                    "n_column_sizes": len(sizes),
                    "n_value_counts": len(values),
                    "n_null_counts": len(nulls),
                    "sort_order_id": _number(f.get("sort_order_id")),
                    "spec_id": own if own is not None else spec_id,
                },
            )
        else:
            log.warning("a manifest entry has content %s; it is skipped", content)
