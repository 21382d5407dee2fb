"""From metadata documents to the relational model, all tables in one set of plans.

Documents are parsed by Spark; of each table only the manifest list of the current snapshot (else the last) is
read. Tasks decode manifests, one row each, once: both kinds of files come out of one pass, which is written to the
checkpoint folder. What lies on a local disk or behind http is fetched by the tasks; what only Hadoop's file systems
know (s3, hdfs and the like) is read by Spark. A table whose manifest list can't be read is not loaded; a manifest
that can't be read is a row of ``unreadable``. Data files are never opened.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, Relations
from ..operators.checkpoint import checkpointed
from ..shipping import ship
from . import metadata_json
from .catalog import Catalog, Document, resolve_path
from .manifests import manifest_list_rows, manifest_rows
from .store import HADOOP_SCHEMES, fetch_bytes, hadoop_files, scheme_of

log = logging.getLogger(__name__)


def _sources(files: DataFrame) -> DataFrame:
    """``files`` (table_id, path, folder, warehouse, ...) with ``content``, where Spark has to read it, and
    ``missing``: why that can't be. Paths of such files come to the driver: some 100 bytes for each manifest."""
    spark = files.sparkSession
    ship(spark)
    place = F.udf(lambda path, folder, warehouse: resolve_path(path, folder, warehouse) if path else path)
    files = checkpointed(files.withColumn("path", place("path", "folder", "warehouse")))
    kind = F.lower(F.regexp_extract("path", "^([A-Za-z0-9+.-]+)://", 1))
    remote = [r["path"] for r in files.where(kind.isin(*HADOOP_SCHEMES)).select("path").distinct().collect()]
    if not remote:
        return files.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("missing"))
    known, missing = hadoop_files(spark, remote)
    names = spark.createDataFrame([*((p, q, None) for p, q in known.items()), *((p, None, e) for p, e in missing.items())], "path string, place string, missing string")
    content = spark.createDataFrame([], "place string, content binary")
    if known:
        content = spark.read.format("binaryFile").load(sorted(set(known.values()))).select(F.col("path").alias("place"), "content")
    return files.join(names.join(content, "place", "left").select("path", "content", "missing"), "path", "left")


def decode_files(files: DataFrame, rows: Callable[[dict, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """``rows`` of the bytes of each file of ``_sources``. A file that can't be read gives one row with ``path`` and
    ``error``."""
    columns = [c.split()[0] for c in _split(schema)]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.to_dict("records"):
                try:
                    if f["missing"]:
                        raise FileNotFoundError(f["missing"])
                    got = [{"table_id": f["table_id"], **r} for r in rows(f, f["content"] if f["content"] is not None else fetch_bytes(f["path"]))]
                except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
                    log.warning("%s can't be read: %s", f["path"], e)
                    got = [{"table_id": f["table_id"], "path": f["path"], "error": f"{type(e).__name__}: {e}"}]
                if got:
                    yield pd.DataFrame({c: pd.Series([r.get(c) for r in got], dtype=object) for c in columns})

    ship(files.sparkSession)
    return checkpointed(files.mapInPandas(decode, schema))


def _split(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def columns_of(*names: str) -> str:
    """The columns of several relations as one list of columns."""
    found = dict(c.split(" ", 1) for n in names for c in _split(SCHEMAS[n]))
    return ", ".join(f"{k} {v}" for k, v in found.items())


def relations_of(spark: SparkSession, documents: Iterable[Document], failed: dict[str, str] | None = None) -> Relations:
    """Relations of ``documents``. Tables whose manifest list can't be read are left out, and told in ``failed``."""
    documents, failed = list(documents), {} if failed is None else failed
    rows = spark.createDataFrame([(d.table_id, d.table_id, d.text, d.metadata_size_bytes, d.folder, d.warehouse) for d in documents], "table_id string, table_name string, json string, metadata_size_bytes long, folder string, warehouse string")
    parsed = metadata_json.parse(rows)
    tables, snapshots = metadata_json.tables(parsed), metadata_json.snapshots(parsed)
    current = snapshots.join(tables.select("table_id", "current_snapshot_id"), "table_id")
    order = F.struct((F.col("snapshot_id") == F.col("current_snapshot_id")).alias("current"), "ts", "snapshot_id")
    lists = current.groupBy("table_id").agg(F.max_by("manifest_list", order).alias("path")).where("path is not null").join(rows.select("table_id", "folder", "warehouse"), "table_id")
    entries = decode_files(_sources(lists), lambda f, data: manifest_list_rows(data), columns_of("manifests", "unreadable"))
    bad = {r["table_id"]: f"its manifest list can't be read: {r['error']}" for r in entries.where("error is not null").collect()}  # a row per table
    if bad:
        failed.update(bad)
        return relations_of(spark, [d for d in documents if d.table_id not in bad], failed)
    manifests = entries.select(*(c.split()[0] for c in _split(SCHEMAS["manifests"])))
    files = manifests.join(rows.select("table_id", "folder", "warehouse"), "table_id").select("table_id", F.col("manifest_path").alias("path"), "folder", "warehouse", "partition_spec_id")
    live = lambda f, data: ({"kind": kind, **r} for kind, r in manifest_rows(data, f["partition_spec_id"]))
    found = decode_files(_sources(files.repartition(F.col("path"))), live, "kind string, " + columns_of("data_files", "delete_files", "unreadable"))
    of = lambda name: found.where(F.col("kind") == name).select(*(c.split()[0] for c in _split(SCHEMAS[name])))
    stored, unlisted = storage_paths(spark, documents, tables)
    rel = Relations.of(
        spark,
        tables=tables,
        schema_fields=lambda: metadata_json.schema_fields(parsed),
        snapshots=snapshots,
        refs=lambda: metadata_json.refs(parsed),
        partition_specs=lambda: metadata_json.partition_specs(parsed),
        partition_fields=lambda: metadata_json.partition_fields(parsed),
        sort_fields=lambda: metadata_json.sort_fields(parsed),
        manifests=manifests,
        data_files=of("data_files"),
        delete_files=of("delete_files"),
        storage_paths=stored,
        unreadable=found.where("error is not null").select("table_id", "path", "error").unionByName(spark.createDataFrame(unlisted, SCHEMAS["unreadable"])),
    )
    rel.memo["written"] = True
    return rel


def storage_paths(spark: SparkSession, documents: Iterable[Document], tables: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """All files below the ``data`` folders of the tables, and (table_id, path, error) of folders that can't be listed,
    of which nothing is known about orphans. Local folders are listed by tasks, others by Spark's own listing."""
    folders = [(d.table_id, d.folder) for d in documents if d.folder]
    away = [d.table_id for d in documents if not d.folder]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for table_id, folder in zip(batch["table_id"], batch["folder"]):
                found = [os.path.join(at, n) for at, _, names in os.walk(os.path.join(folder, "data")) for n in names]
                if found:
                    yield pd.DataFrame({"table_id": table_id, "path": found, "size": [os.path.getsize(p) for p in found]})

    out = spark.createDataFrame(folders, "table_id string, folder string").mapInPandas(walk, SCHEMAS["storage_paths"])
    unlisted = []
    for row in tables.where(F.col("table_id").isin(away)).select("table_id", "location").collect() if away else ():  # a row per table
        top = f"{(row['location'] or '').rstrip('/')}/data"
        try:
            if scheme_of(top) not in HADOOP_SCHEMES:
                raise ValueError("no listing of such locations")
            known, missing = hadoop_files(spark, [top])
            if missing:
                raise FileNotFoundError(missing[top])
        except (OSError, ValueError) as e:
            unlisted.append((row["table_id"], top, f"storage is not listed, orphans are not assessed: {e}"))
            continue
        place = known[top]
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place)
        # paths as the table writes them, whatever Hadoop calls the file system
        own = F.concat(F.lit(top), F.substr(F.col("path"), F.lit(len(place) + 1)))
        out = out.unionByName(listed.select(F.lit(row["table_id"]).alias("table_id"), own.alias("path"), F.col("length").alias("size")))
    return out, unlisted


def load(spark: SparkSession, catalog: Catalog, table_ids: Iterable[str]) -> tuple[Relations, dict[str, str]]:
    """Relations of all tables that can be loaded, and the errors of the others."""
    documents, failed = [], {}
    for t in table_ids:
        try:
            documents.append(catalog.document(t))
        except (OSError, LookupError, ValueError) as e:
            failed[t] = str(e) or type(e).__name__
    return relations_of(spark, documents, failed), failed
