"""Roll-ups over all tables of a catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import namespace, whole
from ..model import Relations
from ..plans.engine import statuses

DORMANT_DAYS = 90
OFFENDERS = 10


def by_namespace(status: DataFrame) -> DataFrame:
    """Tables, critical, warning and healthy ones of each namespace; most critical ones first."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    out = status.groupBy(namespace(F.col("table_name")).alias("namespace")).agg(F.count("*").alias("table_count"), count("CRITICAL").alias("critical"), count("WARNING").alias("warning"), count("PASS").alias("healthy"))
    return out.orderBy(F.desc("critical"), "namespace")


def by_severity(status: DataFrame) -> DataFrame:
    return status.groupBy("severity").agg(F.count("*").alias("table_count"))


def dormant(rel: Relations, as_of: datetime, days: int = DORMANT_DAYS) -> DataFrame:
    """Tables whose last snapshot is ``days`` whole days old and more; tables without snapshots are left out."""
    last = rel.snapshots.groupBy("table_id").agg(F.max("ts").alias("ts"))
    age = whole("day", F.col("ts"), F.lit(as_of))
    return rel.tables.select("table_id", "table_name").join(last, "table_id").select("table_id", "table_name", age.alias("days_since")).where(F.col("days_since") >= days).orderBy(F.desc("days_since"), "table_name")


def unpartitioned(rel: Relations) -> DataFrame:
    return rel.tables.where(F.coalesce("partition_field_count", F.lit(0)) == 0).select("table_id", "table_name")


def format_v1_tables(rel: Relations) -> DataFrame:
    return rel.tables.where("format_version = 1").select("table_id", "table_name")


def top_offenders(status: DataFrame, k: int = OFFENDERS) -> DataFrame:
    """The ``k`` tables with most critical, then most warning findings."""
    return status.orderBy(F.desc("critical_count"), F.desc("warning_count"), "table_name").limit(k).select("table_id", "table_name", "severity", "critical_count", "warning_count")


def fleet_report(rel: Relations, th: Thresholds, as_of: datetime, days: int = DORMANT_DAYS, unreadable: int = 0) -> dict[str, DataFrame | int]:
    status = statuses(rel, th, as_of)
    return {
        "by_namespace": by_namespace(status),
        "by_severity": by_severity(status),
        "dormant": dormant(rel, as_of, days),
        "unpartitioned": unpartitioned(rel),
        "format_v1": format_v1_tables(rel),
        "top_offenders": top_offenders(status),
        "unreadable": unreadable,
    }


def catalog_summary(status: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A brief of each table, worst first; tables that could not be loaded (``failed``: table_name) have ERROR."""
    out = status.select("table_name", "severity", "critical_count", "warning_count")
    if failed is not None:
        out = out.unionByName(failed.select("table_name", F.lit("ERROR").alias("severity"), F.lit(0).cast("long").alias("critical_count"), F.lit(0).cast("long").alias("warning_count")))
    order = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).when(F.col("severity") == "ERROR", 2).otherwise(3)
    return out.orderBy(order, "table_name")
