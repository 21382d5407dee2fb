"""The fifteen health checks, as expressions over the wide per-table frame.

A check has a severity rank (0 pass, 1 warning, 2 critical) and named numbers; text is made on the driver.
New checks are registered with ``@health_check``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import percent, whole

Details = dict[str, Column]


@dataclass(frozen=True)
class Check:
    id: str
    name: str
    needs: tuple[str, ...]
    #: (thresholds, as_of) -> (rank, details)
    measure: Callable[[Thresholds, datetime], tuple[Column, Details]]


REGISTRY: dict[str, Check] = {}


def health_check(check_id: str, name: str, *needs: str):
    def register(measure):
        REGISTRY[check_id] = Check(check_id, name, needs, measure)
        return measure

    return register


def _rank(critical: Column, warning: Column) -> Column:
    return F.when(critical, 2).when(warning, 1).otherwise(0)


@health_check("small_files", "Small Files", "files")
def small_files(th, as_of):
    pct = percent(F.col("small"), F.col("files"))
    rank = _rank((pct > 20) | (F.col("small") > 500), F.col("small") > 0)
    return rank, {"small_files": F.col("small"), "total_files": F.col("files"), "small_pct": pct, "bytes_trapped": F.col("small_bytes"), "bytes_trapped_pct": percent(F.col("small_bytes"), F.col("bytes")), "saved_pct": F.least(F.lit(0.8) * pct, F.lit(50.0))}


@health_check("snapshot_bloat", "Snapshot Bloat", "snapshots")
def snapshot_bloat(th, as_of):
    n, age = F.col("snapshots"), F.coalesce(whole("day", F.col("first_ts"), F.lit(as_of)), F.lit(0))
    rank = F.when(n == 0, 0).otherwise(_rank(((n > th.max_snapshots) | (age > th.max_snapshot_age_days)) & ((n > 5 * th.max_snapshots) | (age > 365)), (n > th.max_snapshots) | (age > th.max_snapshot_age_days)))
    return rank, {"snapshot_count": n, "oldest_days": age, "waste_bytes": F.greatest(n - th.max_snapshots, F.lit(0)) * 4096}


@health_check("orphan_files", "Orphan Files", "orphans")
def orphan_files(th, as_of):
    return _rank(F.col("orphans") > 100, F.col("orphans") >= 1), {"orphan_count": F.col("orphans")}


def skew_ratio(dimension: str) -> Column:
    """Greatest over median; of a median of 0: 1000 if anything is above it."""
    top, middle = F.coalesce(F.col(f"{dimension}_max"), F.lit(0)), F.coalesce(F.col(f"{dimension}_p50"), F.lit(0))
    return F.when(middle > 0, top / middle).when(top > 0, 1000.0).otherwise(0.0)


@health_check("partition_skew", "Partition Skew", "skew")
def partition_skew(th, as_of):
    by = {d: skew_ratio(d) for d in ("bytes", "rows", "files")}
    worst = F.greatest(*by.values())
    applies = (F.coalesce("partition_field_count", F.lit(0)) > 0) & (F.col("partition_count") > 0)
    driver = F.when((by["bytes"] >= by["rows"]) & (by["bytes"] >= by["files"]), "bytes").when(by["rows"] >= by["files"], "rows").otherwise("files")
    rank = F.when(~applies, 0).otherwise(_rank(worst > 5 * th.partition_skew_ratio, worst > th.partition_skew_ratio))
    detail = {f"{d}_ratio": F.when(applies, r) for d, r in by.items()}
    return rank, {**detail, "worst_ratio": F.when(applies, worst), "driver": F.when(applies, driver), "hot_partition": F.when(applies, F.col("hot_partition")), "partition_count": F.col("partition_count")} | {f"{d}_{p}": F.when(applies, F.col(f"{d}_{p}")) for d in by for p in ("p50", "p95", "p99", "max", "sum")}


@health_check("delete_pressure", "Delete Pressure", "deletes", "files")
def delete_pressure(th, as_of):
    effective = F.col("position_deletes") + 5.0 * F.col("equality_deletes")
    shadow = percent(F.col("delete_rows"), F.col("rows"))
    rank = F.when(F.col("deletes") == 0, 0).otherwise(_rank((effective > 5 * th.max_delete_files) | (shadow > 25), (effective > th.max_delete_files) | (shadow > 5)))
    return rank, {"delete_files": F.col("deletes"), "position_deletes": F.col("position_deletes"), "equality_deletes": F.col("equality_deletes"), "effective_deletes": effective, "shadow_pct": shadow}


@health_check("schema_history", "Schema History", "schemas")
def schema_history(th, as_of):
    breaking = F.col("dropped") + F.col("retyped")
    return F.when(F.col("schemas") <= 1, 0).otherwise(_rank(breaking > 3, breaking > 0)), {"schema_count": F.col("schemas"), "breaking": breaking, "additive": F.col("added"), "dropped": F.col("dropped"), "retyped": F.col("retyped")}


@health_check("metadata_size", "Metadata Size")
def metadata_size(th, as_of):
    size = F.coalesce("metadata_size_bytes", F.lit(0)).cast("long")
    return _rank(size > 3 * th.max_metadata_bytes, size > th.max_metadata_bytes), {"metadata_bytes": size, "saved_mb": F.lit(0.5) * size / (1 << 20)}


@health_check("sort_order", "Sort Order")
def sort_order(th, as_of):
    return F.lit(0), {"sort_fields": F.coalesce("sort_field_count", F.lit(0))}


@health_check("freshness", "Freshness", "snapshots")
def freshness(th, as_of):
    hours = whole("hour", F.col("last_ts"), F.lit(as_of))
    rank = F.when(hours.isNull(), 1).otherwise(_rank(hours > 7 * th.stale_table_hours, hours > th.stale_table_hours))
    return rank, {"hours_since": hours, "days_since": F.floor(hours / 24)}


@health_check("format_v1", "Format Version")
def format_v1(th, as_of):
    return _rank(F.lit(False), F.col("format_version") < 2), {"format_version": F.col("format_version")}


@health_check("properties_drift", "Properties Drift", "medians")
def properties_drift(th, as_of):
    declared, median = F.col("declared_target_bytes"), F.col("median_bytes")
    applies = F.coalesce((declared > 0) & (median > 0), F.lit(False))
    drift = F.when(applies, F.abs(median - declared) / declared)
    return F.when(~applies, 0).otherwise(_rank((drift > th.target_file_size_drift_pct) & (drift > 5.0), drift > th.target_file_size_drift_pct)), {"declared_bytes": F.when(declared > 0, declared), "median_bytes": median, "drift": drift}


@health_check("partition_spec_evolution", "Partition Spec Evolution", "specs", "files")
def partition_spec_evolution(th, as_of):
    specs, old = F.col("specs"), F.col("old_files")
    rank = _rank((specs > 2 * th.max_partition_specs) | (old > F.floor(F.col("files") / 4)), (specs > th.max_partition_specs) | (old > 0))
    fine = (specs <= th.max_partition_specs) & (old == 0)
    return F.when(fine, 0).otherwise(rank), {"spec_count": specs, "old_spec_files": old, "total_files": F.col("files"), "old_spec_bytes": F.col("old_bytes")}


@health_check("sort_compliance", "Sort Compliance", "files")
def sort_compliance(th, as_of):
    assessable = F.col("files") - F.col("no_order")
    pct = percent(F.col("in_order"), assessable)
    applies = (F.coalesce("sort_field_count", F.lit(0)) > 0) & (F.col("files") > 0)
    rank = F.when(~applies, 0).when(assessable == 0, 1).otherwise(_rank(pct < th.min_sort_compliance_pct / 2, pct < th.min_sort_compliance_pct))
    return rank, {"assessable": F.when(applies, assessable), "matching": F.when(applies, F.col("in_order")), "compliance_pct": F.when(applies & (assessable > 0), pct)}


@health_check("stats_coverage", "Stats Coverage", "files")
def stats_coverage(th, as_of):
    pct = percent(F.col("with_stats"), F.col("files"))
    rank = F.when(F.col("files") == 0, 0).otherwise(_rank(pct < th.min_stats_coverage_pct / 2, pct < th.min_stats_coverage_pct))
    return rank, {"total_files": F.col("files"), "with_stats": F.col("with_stats"), "with_value_counts": F.col("with_values"), "with_null_counts": F.col("with_nulls"), "coverage_pct": pct}


@health_check("branch_health", "Branch Health", "refs")
def branch_health(th, as_of):
    return _rank(F.col("dangling") > 0, F.col("stale") > 0), {c: F.col(c) for c in ("branches", "tags", "healthy", "stale", "dangling")}
