"""The derived files and manifests as Avro, as a table's metadata has them, and decoded again by the reader."""

from __future__ import annotations

import copy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.avro_writer import LIST, MANIFEST, container, entry
from ..sources.manifests import manifest_list_rows, manifest_rows
from ..sources.reader import columns_of, decode_files
from ..shipping import ship
from .derived import view

#: Entries of a manifest, about.
ENTRIES = 20_000


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _pairs(n) -> list[dict]:
    return [{"key": k, "value": 1} for k in range(int(n))]


def _schema(partition: str | None) -> dict:
    """The schema of a manifest whose files are partitioned by one field."""
    out = copy.deepcopy(MANIFEST)
    fields = out["fields"][2]["type"]["fields"]
    fields[[f["name"] for f in fields].index("partition")]["type"]["fields"] = [{"name": partition, "type": ["null", "string"]}] if partition else []
    return out


def _manifest(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    entries = []
    for r in rows.to_dict("records"):
        if r["content"]:
            entries.append(entry(r["file_path"], r["file_size_bytes"], r["record_count"], content=r["content"]))
            continue
        name, _, value = r["partition_key"].partition("=")
        maps = {"column_sizes": _pairs(r["n_column_sizes"]), "value_counts": _pairs(r["n_value_counts"]), "null_value_counts": {str(k): 0 for k in range(int(r["n_null_counts"]))}}
        entries.append(entry(r["file_path"], r["file_size_bytes"], r["record_count"], partition={name: value}, sort_order_id=_number(r["sort_order_id"]), **maps))
    data = container(_schema(first["field"]), entries, "deflate")
    return pd.DataFrame({"table_id": [str(first["table_id"])], "path": ["m"], "partition_spec_id": [_number(first["spec_id"])], "content": [data], "missing": [None]})


_FILES = "table_id string, path string, partition_spec_id int, content binary, missing string"


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all manifests, with ``kind``: data_files or delete_files."""
    ship(spark)
    files, deletes = view(spark, sf_dir, "data_files"), view(spark, sf_dir, "delete_files")
    content = F.when(F.col("delete_type") == "position_delete", 1).when(F.col("delete_type") == "equality_delete", 2).otherwise(0)
    rows = files.unionByName(deletes, allowMissingColumns=True).withColumn("content", content).withColumn("field", F.substring_index("partition_key", "=", 1))
    n = max(1, rows.count() // ENTRIES)
    groups = rows.withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(n))).groupBy("table_id", "spec_id", "field", "part")
    live = lambda f, data: ({"kind": kind, **r} for kind, r in manifest_rows(data, _number(f["partition_spec_id"])))
    return decode_files(groups.applyInPandas(_manifest, _FILES), live, "kind string, " + columns_of("data_files", "delete_files", "unreadable"))


def decoded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the manifest lists, one list a table."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [{"manifest_path": p, "manifest_length": int(n), "partition_spec_id": 0, "content": 0, "added_snapshot_id": 1, "added_files_count": 3} for p, n in zip(rows["manifest_path"], rows["manifest_length"])]
        return pd.DataFrame({"table_id": [str(rows["table_id"].iloc[0])], "path": ["l"], "partition_spec_id": [None], "content": [container(LIST, entries)], "missing": [None]})

    ship(spark)
    lists = view(spark, sf_dir, "manifests").groupBy("table_id").applyInPandas(write, _FILES)
    return decode_files(lists, lambda f, data: manifest_list_rows(data), columns_of("manifests", "unreadable"))
