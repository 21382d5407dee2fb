"""Findings of all tables at once, and what is rolled up from them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import severity_name
from ..model import Relations
from ..operators import aggregates
from ..operators.advice import advice
from ..operators.checks import REGISTRY, Check


def select_checks(ids: Iterable[str] | None = None) -> list[Check]:
    """All checks, or those named; unknown names are ignored."""
    return [c for k, c in REGISTRY.items() if ids is None or k in set(ids)]


def check(rel: Relations, check_id: str, th: Thresholds, as_of: datetime) -> DataFrame:
    """One check with typed details: table_id, table_name, severity, and a column for each detail."""
    c = REGISTRY[check_id]
    rank, details = c.measure(th, as_of)
    return aggregates.wide(rel, th, as_of, c.needs).select("table_id", "table_name", severity_name(rank).alias("severity"), *(v.alias(k) for k, v in details.items()))


#: Lists that go into the details of findings only: what they need, and the columns.
_LISTS = {"small_files": ("hotspots", ("top_partitions",)), "orphan_files": ("samples", ("sample_orphans",))}
_TOLD = ("impact", "fix_suggestion", "fix_command", "estimated_savings")


def findings(rel: Relations, th: Thresholds, as_of: datetime, ids: Iterable[str] | None = None, told: bool = True) -> DataFrame:
    """(table_id, table_name, check_id, check_name, severity_rank, severity, details, impact, fix_suggestion,
    fix_command, estimated_savings): a row per table and check.

    Every aggregate is joined once for all checks that read it; details are JSON. The last four are null where a
    check passes. Without ``told`` there are no details and none of the last four.
    """
    checks = select_checks(ids)
    columns = ["table_id", "table_name", "check_id", "check_name", "severity_rank", "severity", *(("details", *_TOLD) if told else ())]
    if not checks:
        return rel.tables.sparkSession.createDataFrame([], ", ".join(f"{c} {'int' if c == 'severity_rank' else 'string'}" for c in columns))
    lists = {c.id: _LISTS[c.id] for c in checks if told and c.id in _LISTS}
    frame = aggregates.wide(rel, th, as_of, [n for c in checks for n in c.needs] + [need for need, _ in lists.values()])
    if told and any(c.id == "partition_skew" for c in checks):
        fields = rel.partition_fields.groupBy("table_id", "spec_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("fields"))
        own = fields.select("table_id", F.col("spec_id").alias("default_spec_id"), F.transform("fields", lambda f: f["name"]).alias("partition_columns"))
        frame = frame.join(own, ["table_id", "default_spec_id"], "left")
    rows = []
    for c in checks:
        rank, details = c.measure(th, as_of)
        row = {"check_id": F.lit(c.id), "check_name": F.lit(c.name), "severity_rank": rank.cast("int")}
        if told:
            more = {k: F.col(k) for k in (lists[c.id][1] if c.id in lists else ())}
            row |= {"details": F.to_json(F.struct(*(v.alias(k) for k, v in (details | more).items()))), **advice(c.id, th, as_of, details).columns(rank)}
        rows.append(F.struct(*(v.alias(k) for k, v in row.items())))
    out = frame.select("table_id", "table_name", F.explode(F.array(*rows)).alias("f")).select("table_id", "table_name", "f.*")
    return out.withColumn("severity", severity_name(F.col("severity_rank"))).select(*columns)


def overall(found: DataFrame) -> DataFrame:
    """Per table: the worst severity, and how many findings have which."""
    count = lambda k: F.count(F.when(F.col("severity_rank") == k, 1))
    return found.groupBy("table_id", "table_name").agg(F.max("severity_rank").alias("severity_rank"), count(0).alias("pass_count"), count(1).alias("warning_count"), count(2).alias("critical_count")).withColumn("severity", severity_name(F.col("severity_rank")))


def statuses(rel: Relations, th: Thresholds, as_of: datetime, ids: Iterable[str] | None = None) -> DataFrame:
    """``overall`` for every table, also where no check was chosen: then it passes."""
    found = overall(findings(rel, th, as_of, ids, told=False)).drop("table_name")
    out = rel.tables.select("table_id", "table_name").join(found, "table_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("severity_rank", "pass_count", "warning_count", "critical_count")}).withColumn("severity", F.coalesce("severity", F.lit("PASS")))


def summary(rel: Relations) -> DataFrame:
    """Snapshots, data files, bytes and rows of each table."""
    files = rel.data_files.groupBy("table_id").agg(F.count("*").alias("data_file_count"), F.sum("file_size_bytes").alias("total_size_bytes"), F.sum("record_count").alias("total_record_count"))
    snapshots = rel.snapshots.groupBy("table_id").agg(F.count("*").alias("snapshot_count"))
    out = rel.tables.select("table_id", "table_name").join(snapshots, "table_id", "left").join(files, "table_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("snapshot_count", "data_file_count", "total_size_bytes", "total_record_count")})
