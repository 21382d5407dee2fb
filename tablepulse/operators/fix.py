"""Maintenance commands and their estimated scope. Commands are made, never run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import quoted
from ..model import Relations
from .aggregates import wide

# fixed values
KEEP_SNAPSHOT_DAYS = 7
KEEP_ORPHAN_DAYS = 3
DEFAULT_TARGET_BYTES = 512 << 20


@dataclass(frozen=True)
class Fix:
    finding_id: str
    needs: tuple[str, ...]
    description: str
    warnings: tuple[str, ...]

    def command(self, as_of: datetime) -> Column:
        name = quoted(F.col("table_name"))
        call = lambda procedure, *rest: F.concat(F.lit(f"CALL catalog.system.{procedure}(table => '"), name, F.lit("'"), *(F.lit(f", {r}") if isinstance(r, str) else r for r in rest), F.lit(")"))
        older = lambda days: f"older_than => TIMESTAMP '{as_of - timedelta(days=days):%Y-%m-%d %H:%M:%S}'"
        pack, sort, everything = "strategy => 'binpack'", "strategy => 'sort'", "options => map('rewrite-all', 'true')"
        target = F.concat(F.lit(", options => map('target-file-size-bytes', '"), F.when(F.col("declared_target_bytes") > 0, F.col("declared_target_bytes")).otherwise(DEFAULT_TARGET_BYTES).cast("string"), F.lit("')"))
        return {
            "small_files": lambda: call("rewrite_data_files", pack),
            "snapshot_bloat": lambda: call("expire_snapshots", older(KEEP_SNAPSHOT_DAYS)),
            "orphan_files": lambda: call("remove_orphan_files", older(KEEP_ORPHAN_DAYS)),
            "delete_pressure": lambda: call("rewrite_data_files", pack),
            "metadata_size": lambda: call("rewrite_manifests"),
            "partition_skew": lambda: call("rewrite_data_files", sort),
            "format_v1": lambda: F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" SET TBLPROPERTIES ('format-version'='2')")),
            "properties_drift": lambda: call("rewrite_data_files", pack, target),
            "partition_spec_evolution": lambda: call("rewrite_data_files", everything),
            "sort_compliance": lambda: call("rewrite_data_files", sort),
            "stats_coverage": lambda: call("rewrite_data_files", pack, everything),
        }[self.finding_id]()

    def scope(self) -> tuple[Column, Column, Column, Column]:
        """Files, bytes, partitions, snapshots."""
        c, zero = F.col, F.lit(0)
        everything = (c("files"), c("bytes"), c("partitions"), zero)
        return {
            "small_files": lambda: (c("fix_small"), c("fix_small_bytes"), c("small_partitions"), zero),
            "snapshot_bloat": lambda: (zero, zero, zero, c("expired")),
            "orphan_files": lambda: (c("orphans"), zero, zero, zero),
            "delete_pressure": lambda: everything,
            "metadata_size": lambda: (c("manifests"), c("manifest_bytes"), zero, zero),
            "partition_skew": lambda: everything,
            "format_v1": lambda: (zero, zero, zero, zero),
            "properties_drift": lambda: everything,
            "partition_spec_evolution": lambda: (c("old_files"), c("old_bytes"), zero, zero),
            "sort_compliance": lambda: (c("unsorted_files"), c("unsorted_bytes"), c("unsorted_partitions"), zero),
            "stats_coverage": lambda: (c("without_stats"), c("without_counts_bytes"), c("bare_partitions"), zero),
        }[self.finding_id]()


_ALL = (
    Fix("small_files", ("files",), "Joins small files into files of the target size.", ("Rewrites data files; run it when writers are quiet.",)),
    Fix("snapshot_bloat", (), f"Expires snapshots older than {KEEP_SNAPSHOT_DAYS} days.", ("Expired snapshots can't be read or rolled back to.",)),
    Fix("orphan_files", ("orphans",), f"Removes unreferenced files older than {KEEP_ORPHAN_DAYS} days.", ("Files of writes that have not been committed may be removed.",)),
    Fix("delete_pressure", ("files",), "Rewrites data files so that deletes are applied.", ("Rewrites data files; run it when writers are quiet.",)),
    Fix("metadata_size", ("manifests",), "Rewrites manifests into fewer ones.", ()),
    Fix("partition_skew", ("files",), "Rewrites and sorts data files to even them out.", ("It can't change how rows are partitioned.",)),
    Fix("format_v1", (), "Moves the table to format version 2.", ("Old readers may not read version 2, and there is no way back.",)),
    Fix("properties_drift", ("files",), "Rewrites data files towards the declared size.", ("Check what size writers use in fact.",)),
    Fix("partition_spec_evolution", ("files",), "Rewrites files of old partition specs.", ("May rewrite the whole table.",)),
    Fix("sort_compliance", ("files",), "Sorts files that are not in the declared order.", ("Sorting needs room for a shuffle.",)),
    Fix("stats_coverage", ("files",), "Rewrites files to fill in missing column statistics.", ("May rewrite the whole table.",)),
)
FIXES = {f.finding_id: f for f in _ALL}


def generate_fixes(rel: Relations, as_of: datetime, ids: Iterable[str] | None = None, dry_run: bool = False) -> DataFrame:
    """A row per table and fix: finding_id, command (null in a dry run), description, warnings and scope columns.

    Unknown ids have no fix. Scopes are computed for every table, whatever its findings.
    """
    fixes = [f for k, f in FIXES.items() if ids is None or k in set(ids)]
    spark = rel.tables.sparkSession
    if not fixes:
        return spark.createDataFrame([], "table_id string, table_name string, finding_id string, command string, description string, warnings array<string>, estimated_files long, estimated_bytes long, estimated_partitions long, estimated_snapshots_expired long")
    frame = wide(rel, Thresholds(), as_of, [n for f in fixes for n in f.needs])
    if any(f.finding_id == "snapshot_bloat" for f in fixes):
        expired = rel.snapshots.where(F.col("ts") < F.lit(as_of - timedelta(days=KEEP_SNAPSHOT_DAYS))).groupBy("table_id").agg(F.count("*").alias("expired"))
        frame = frame.join(expired, "table_id", "left").withColumn("expired", F.coalesce("expired", F.lit(0)))
    rows = []
    for f in fixes:
        files, size, partitions, snapshots = (x.cast("long") for x in f.scope())
        command = F.lit(None).cast("string") if dry_run else f.command(as_of)
        rows.append(F.struct(F.lit(f.finding_id).alias("finding_id"), command.alias("command"), F.lit(f.description).alias("description"), F.array(*map(F.lit, f.warnings)).cast("array<string>").alias("warnings"), files.alias("estimated_files"), size.alias("estimated_bytes"), partitions.alias("estimated_partitions"), snapshots.alias("estimated_snapshots_expired")))
    return frame.select("table_id", "table_name", F.explode(F.array(*rows)).alias("f")).select("table_id", "table_name", "f.*")
