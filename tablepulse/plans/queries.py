"""Every operator as a query over the derived relations, with the same in SQL of another engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CostAssumptions
from ..operators import aggregates, cost, fix, fleet, watch
from ..operators.checks import REGISTRY
from . import engine
from ..sources import metadata_json
from ..sources.demo import demo_relations
from . import written
from .derived import AS_OF, THRESHOLDS, documents, history, relations, with_views

WATCH_AS_OF, WATCH_DAYS = datetime(2024, 1, 31), 2
_DATA_FILE = ("file_path", "file_size_bytes", "record_count", "partition_key", "spec_id", "sort_order_id", "n_value_counts", "n_null_counts", "n_column_sizes")
_DELETE_FILE = ("file_path", "file_size_bytes", "record_count", "delete_type")
Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen checks of all tables in one plan, rolled up to a status per table."""
    return engine.statuses(relations(spark, sf_dir), THRESHOLDS, AS_OF)


def _check(check_id: str) -> Query:
    return lambda spark, d: engine.check(relations(spark, d), check_id, THRESHOLDS, AS_OF)


def _findings(*ids: str) -> Query:
    return lambda spark, d: engine.findings(relations(spark, d), THRESHOLDS, AS_OF, ids or None, told=False).select("table_id", "check_id", "severity")


def _cost(category: str) -> Query:
    return lambda spark, d: cost.cost_items(relations(spark, d), CostAssumptions(), AS_OF).where(F.col("category") == category)


def _cost_report(spark: SparkSession, d: str) -> DataFrame:
    return cost.cost_report(relations(spark, d), CostAssumptions(), AS_OF).drop("assumptions")


def _fix(finding_id: str, dry_run: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = fix.generate_fixes(relations(spark, d), AS_OF, [finding_id] if finding_id else None, dry_run)
        return out.drop("description", "warnings", *(["command"] if dry_run else []))

    return run


def _fleet(part: str) -> Query:
    return lambda spark, d: fleet.fleet_report(relations(spark, d), THRESHOLDS, AS_OF, days=6)[part]


def _status(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(flagship(spark, d))


def _history(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(history(spark, d))


def _flat(alerts: DataFrame) -> DataFrame:
    return alerts.select("table_name", "previous_severity", "current_severity", "message", "alerted_at")


def _parsed(f: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, d: f(metadata_json.parse(documents(spark, d))).select(*columns)


def _cycle(spark: SparkSession, d: str) -> DataFrame:
    """What a watch cycle stores of a run."""
    found = engine.findings(relations(spark, d), THRESHOLDS, AS_OF, told=False).withColumn("details", F.lit(None).cast("string"))
    rows = watch.history_rows(engine.overall(found), found, AS_OF)
    return rows.select("table_name", "severity", "finding_count", "critical_count", "warning_count", F.array_join("finding_ids", ",").alias("finding_ids"), "checked_at")


def _report(spark: SparkSession, d: str) -> DataFrame:
    """A fleet report as one table of (part, name, value)."""
    parts = fleet.fleet_report(relations(spark, d), THRESHOLDS, AS_OF, days=6)
    columns = {"by_namespace": ("namespace", "table_count"), "by_severity": ("severity", "table_count"), "dormant": ("table_name", "days_since"), "unpartitioned": ("table_name", None), "format_v1": ("table_name", None), "top_offenders": ("table_name", "critical_count")}
    rows = [parts[k].select(F.lit(k).alias("part"), F.col(name).alias("name"), (F.col(n) if n else F.lit(1)).cast("long").alias("value")) for k, (name, n) in columns.items()]
    return reduce(DataFrame.unionByName, rows)


def _decoded(kind: str, *columns: str) -> Query:
    return lambda spark, d: written.decoded(spark, d).where(F.col("kind") == kind).select("table_id", *columns)


def _demo(spark: SparkSession, d: str) -> DataFrame:
    return engine.findings(demo_relations(spark, AS_OF), THRESHOLDS, AS_OF, told=False).select("check_id", "severity")


def queries() -> dict[str, Query]:
    # fixed table of the fixes' ids by finding
    named = {"partition_spec_evolution": "spec_evolution"}
    return {
        **{k: _check(k) for k in REGISTRY},
        "check_table": _findings(),
        "check_table_filtered": _findings("small_files", "freshness", "no_such_check"),
        "overall_status": flagship,
        "table_summary": lambda s, d: engine.summary(relations(s, d)),
        "small_file_hotspots": lambda s, d: aggregates.hotspots(relations(s, d), THRESHOLDS),
        "schema_changes": lambda s, d: aggregates.schema_changes(relations(s, d)),
        "ref_health": lambda s, d: aggregates.ref_health(relations(s, d), THRESHOLDS, AS_OF).drop("ref_type"),
        "orphan_paths": lambda s, d: aggregates.orphan_paths(relations(s, d)),
        "manifest_stats": lambda s, d: aggregates.manifest_stats(relations(s, d)),
        "cost_orphan": _cost("orphan_storage"),
        "cost_snapshot": _cost("snapshot_metadata"),
        "cost_small_files": _cost("small_file_gets"),
        "cost_manifest_gets": _cost("manifest_gets"),
        "cost_delete_merge": _cost("delete_merge"),
        "cost_report": _cost_report,
        **{f"fix_{named.get(k, k)}": _fix(k) for k in fix.FIXES},
        "dry_run_fix": _fix("", dry_run=True),
        "fleet_namespace": _fleet("by_namespace"),
        "fleet_by_severity": _fleet("by_severity"),
        "fleet_dormant": _fleet("dormant"),
        "fleet_unpartitioned": _fleet("unpartitioned"),
        "fleet_format_v1": _fleet("format_v1"),
        "fleet_top_offenders": _fleet("top_offenders"),
        "catalog_summary": _status(fleet.catalog_summary),
        "parse_metadata_json": _parsed(metadata_json.tables, "table_id", "table_name", "format_version", "declared_target_bytes", "default_spec_id", "partition_field_count", "sort_field_count", "metadata_size_bytes"),
        "parse_snapshots": _parsed(metadata_json.snapshots, "table_id", "snapshot_id", "operation"),
        "demo_source": _demo,
        "parse_manifest": _decoded("data_files", *_DATA_FILE),
        "parse_delete_files": _decoded("delete_files", *_DELETE_FILE),
        "parse_manifest_list": lambda s, d: written.decoded_lists(s, d).select("table_id", "manifest_path", "manifest_length", "added_files_count", "deleted_files_count"),
        "watch_cycle": _cycle,
        "fleet_report": _report,
        "latest_report": _history(lambda h: watch.latest_report(h, "7").select("table_name", "severity", "finding_count", "checked_at")),
        "history": _history(lambda h: watch.recent(h, "7", 20).select("table_name", "severity", "finding_count", "checked_at")),
        "all_latest": _history(lambda h: watch.all_latest(h).select("table_name", "severity", "finding_count", "checked_at")),
        "trend": _history(lambda h: watch.trends(h, WATCH_AS_OF, WATCH_DAYS)),
        "detect_changes": _history(lambda h: _flat(watch.detect_changes(h))),
        "alerts_recent": _history(lambda h: _flat(watch.recent_alerts(watch.detect_changes(h), 10, "7"))),
        "alert_cooldown": _history(lambda h: _flat(watch.cooldown(watch.detect_changes(h), 7 * 86400))),
    }


_ALL = with_views("tables", "data_files", "delete_files", "storage_paths", "snapshots", "refs", "manifests", "partition_specs", "schema_fields")
_ASOF = "timestamp '2024-01-27 00:00:00'"
_US = f"(epoch_us({_ASOF}) - epoch_us({{}}))"
_STAT = "(n_value_counts > 0 or n_null_counts > 0 or n_column_sizes > 0)"
_UNSORTED = "(case when sort_field_count > 0 then sort_order_id <> declared else sort_order_id <> 0 end)"
_RANKED = "list(x order by x)[cast(round({} / 100.0 * (count(*) - 1)) as int) + 1]"
_RATIO = "case when {0}_p50 > 0 then {0}_max::double / {0}_p50 when {0}_max > 0 then 1000.0::double else 0.0::double end"


def _dimension(d: str) -> str:
    return ", ".join([f"{_RANKED.format(p).replace(' x)', f' {d})').replace('list(x', f'list({d}')} as {d}_p{p}" for p in (50, 95, 99)] + [f"max({d})::bigint as {d}_max", f"sum({d})::bigint as {d}_sum"])


#: One row per table with every aggregate, for the statements below.
_WIDE = f"""{_ALL},
df as (select d.*, t.default_spec_id, t.sort_order_id as declared, t.sort_field_count from data_files d join tables t using (table_id)),
f as (select table_id, count(*) as files, sum(file_size_bytes)::bigint as bytes, sum(record_count)::bigint as rws,
  count(*) filter (file_size_bytes < 10000000) as small, coalesce(sum(file_size_bytes) filter (file_size_bytes < 10000000), 0)::bigint as small_bytes,
  count(*) filter (file_size_bytes < 8388608) as fix_small, coalesce(sum(file_size_bytes) filter (file_size_bytes < 8388608), 0)::bigint as fix_small_bytes,
  count(*) filter ({_STAT}) as with_stats, count(*) filter (n_value_counts > 0) as with_values, count(*) filter (n_null_counts > 0) as with_nulls,
  count(*) filter (not {_STAT}) as without_stats, coalesce(sum(file_size_bytes) filter (not (n_value_counts > 0 or n_null_counts > 0)), 0)::bigint as without_counts_bytes,
  count(distinct partition_key) as partitions, count(distinct partition_key) filter (file_size_bytes < 8388608) as small_partitions,
  count(distinct partition_key) filter (not {_STAT}) as bare_partitions, count(distinct partition_key) filter ({_UNSORTED}) as unsorted_partitions,
  count(*) filter (spec_id <> default_spec_id) as old_files, coalesce(sum(file_size_bytes) filter (spec_id <> default_spec_id), 0)::bigint as old_bytes,
  count(*) filter (sort_order_id is null) as no_order, count(*) filter (sort_order_id = declared) as in_order,
  count(*) filter ({_UNSORTED}) as unsorted_files, coalesce(sum(file_size_bytes) filter ({_UNSORTED}), 0)::bigint as unsorted_bytes,
  list(file_size_bytes order by file_size_bytes)[cast(round(0.5 * (count(*) - 1)) as int) + 1] as median_bytes
  from df group by table_id),
dl as (select table_id, count(*) as deletes, count(*) filter (delete_type = 'position_delete') as position_deletes, count(*) filter (delete_type = 'equality_delete') as equality_deletes, sum(record_count)::bigint as delete_rows from delete_files group by table_id),
sn as (select table_id, count(*) as snapshots, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (ts < {_ASOF} - interval 7 day) as expired from snapshots group by table_id),
sp as (select table_id, count(*) as specs from partition_specs group by table_id),
orph as (select table_id, path from storage_paths s where not exists (select 1 from data_files d where d.table_id = s.table_id and d.file_path = s.path) and not exists (select 1 from delete_files d where d.table_id = s.table_id and d.file_path = s.path)),
oc as (select table_id, count(*) as orphans from orph group by table_id),
st as (select table_id, count(*) as stored from storage_paths group by table_id),
mf as (select table_id, count(*) as manifests, sum(greatest(manifest_length, 0))::bigint as manifest_bytes, max(greatest(manifest_length, 0)) as max_manifest,
  list(greatest(manifest_length, 0) order by greatest(manifest_length, 0))[cast(round(0.5 * (count(*) - 1)) as int) + 1] as median_manifest from manifests group by table_id),
pt as (select table_id, partition_key, count(*) as files, sum(file_size_bytes)::bigint as bytes, sum(record_count)::bigint as rows from data_files group by 1, 2),
sk as (select table_id, count(*) as partition_count, {', '.join(_dimension(d) for d in ('files', 'bytes', 'rows'))}, first(partition_key order by bytes desc, partition_key) as hot_partition from pt group by table_id),
fl as (select distinct table_id, schema_pos from schema_fields),
fw as (select b.table_id, a.schema_pos, b.schema_pos as before from fl a join fl b on a.table_id = b.table_id and a.schema_pos = b.schema_pos + 1),
od as (select fw.table_id, fw.schema_pos, name, field_type as was from schema_fields s join fw on s.table_id = fw.table_id and s.schema_pos = fw.before),
nw as (select fw.table_id, fw.schema_pos, name, field_type as now from schema_fields s join fw on s.table_id = fw.table_id and s.schema_pos = fw.schema_pos),
ch as (select * from (select table_id, schema_pos, name, was, now, case when now is null then 'dropped' when was is null then 'added' when was <> now then 'retyped' end as change from od full join nw using (table_id, schema_pos, name)) where change is not null),
sc as (select table_id, count(*) as schemas from fl group by table_id),
cc as (select table_id, count(*) filter (change = 'dropped') as dropped, count(*) filter (change = 'added') as added, count(*) filter (change = 'retyped') as retyped from ch group by table_id),
rh as (select r.table_id, name, ref_type, r.snapshot_id, case when s.ts is null then 'dangling' when {_US.format('s.ts')} > 14 * 86400000000 then 'stale' else 'healthy' end as state, floor({_US.format('s.ts')} / 86400000000)::bigint as age_days
  from refs r left join snapshots s on r.table_id = s.table_id and r.snapshot_id = s.snapshot_id where name <> 'main'),
rc as (select table_id, count(*) filter (ref_type = 'branch') as branches, count(*) filter (ref_type <> 'branch') as tags, count(*) filter (state = 'dangling') as dangling, count(*) filter (state = 'stale') as stale, count(*) filter (state = 'healthy') as healthy from rh group by table_id),
w as (select t.*, {', '.join(f'coalesce({c}, 0) as {c}' for c in 'files bytes rws small small_bytes fix_small fix_small_bytes with_stats with_values with_nulls without_stats without_counts_bytes partitions small_partitions bare_partitions unsorted_partitions old_files old_bytes no_order in_order unsorted_files unsorted_bytes deletes position_deletes equality_deletes delete_rows snapshots expired specs orphans stored manifests manifest_bytes schemas dropped added retyped branches tags dangling stale healthy partition_count'.split()).replace('coalesce(files', 'coalesce(f.files').replace('coalesce(bytes', 'coalesce(f.bytes')},
  median_bytes, first_ts, last_ts, hot_partition, {', '.join(f'{d}_{p}' for d in ('files', 'bytes', 'rows') for p in ('p50', 'p95', 'p99', 'max', 'sum'))},
  floor({_US.format('first_ts')} / 86400000000)::bigint as age, floor({_US.format('last_ts')} / 3600000000)::bigint as hours,
  {', '.join(f'{_RATIO.format(d)} as {d}_r' for d in ('files', 'bytes', 'rows'))}
  from tables t left join f using (table_id) left join dl using (table_id) left join sn using (table_id) left join sp using (table_id) left join oc using (table_id) left join st using (table_id)
  left join mf using (table_id) left join sk using (table_id) left join sc using (table_id) left join cc using (table_id) left join rc using (table_id)),
"""


def _rank(fine: str, critical: str, warning: str) -> str:
    return f"case when {fine} then 0 when {critical} then 2 when {warning} then 1 else 0 end"


_PCT = "coalesce(case when {1} > 0 then 1e2 * {0} / {1} end, 0e0)"
_SKEWED = "partition_field_count > 0 and partition_count > 0"
_WORST = "greatest(bytes_r, rows_r, files_r)"
_DRIFT = "abs(median_bytes - declared_target_bytes)::double / declared_target_bytes"
_DRIFTS = "coalesce(declared_target_bytes > 0 and median_bytes > 0, false)"
_SORTED = "sort_field_count > 0 and files > 0"

#: Rank and details of each check over ``w``.
_CHECKS = {
    "small_files": (_rank("false", f"{_PCT.format('small', 'files')} > 20 or small > 500", "small > 0"), f"small as small_files, files as total_files, {_PCT.format('small', 'files')} as small_pct, small_bytes as bytes_trapped, {_PCT.format('small_bytes', 'bytes')} as bytes_trapped_pct, least(8e-1 * {_PCT.format('small', 'files')}, 5e1) as saved_pct"),
    "snapshot_bloat": (_rank("snapshots = 0 or (snapshots <= 200 and age <= 7)", "snapshots > 1000 or age > 365", "true"), "snapshots as snapshot_count, coalesce(age, 0) as oldest_days, greatest(snapshots - 200, 0) * 4096 as waste_bytes"),
    "orphan_files": (_rank("false", "orphans > 100", "orphans >= 1"), "orphans as orphan_count"),
    "partition_skew": (
        _rank(f"not ({_SKEWED})", f"{_WORST} > 50", f"{_WORST} > 10"),
        ", ".join(f"case when {_SKEWED} then {x} end as {n}" for n, x in [*((f"{d}_ratio", f"{d}_r") for d in ("bytes", "rows", "files")), ("worst_ratio", _WORST), ("driver", "case when bytes_r >= rows_r and bytes_r >= files_r then 'bytes' when rows_r >= files_r then 'rows' else 'files' end"), ("hot_partition", "hot_partition"), *((f"{d}_{p}", f"{d}_{p}") for d in ("bytes", "rows", "files") for p in ("p50", "p95", "p99", "max", "sum"))]) + ", partition_count",
    ),
    "delete_pressure": (_rank("deletes = 0", f"position_deletes + 5e0 * equality_deletes > 250 or {_PCT.format('delete_rows', 'rws')} > 25", f"position_deletes + 5e0 * equality_deletes > 50 or {_PCT.format('delete_rows', 'rws')} > 5"), f"deletes as delete_files, position_deletes, equality_deletes, position_deletes + 5e0 * equality_deletes as effective_deletes, {_PCT.format('delete_rows', 'rws')} as shadow_pct"),
    "schema_history": (_rank("schemas <= 1", "dropped + retyped > 3", "dropped + retyped > 0"), "schemas as schema_count, dropped + retyped as breaking, added as additive, dropped, retyped"),
    "metadata_size": (_rank("false", "metadata_size_bytes > 1572864000", "metadata_size_bytes > 524288000"), "metadata_size_bytes as metadata_bytes, 5e-1 * metadata_size_bytes / 1048576 as saved_mb"),
    "sort_order": ("0", "sort_field_count as sort_fields"),
    "freshness": (_rank("false", "hours > 336", "hours is null or hours > 48"), "hours as hours_since, floor(hours / 24)::bigint as days_since"),
    "format_v1": (_rank("false", "false", "format_version < 2"), "format_version"),
    "properties_drift": (_rank(f"not {_DRIFTS}", f"{_DRIFT} > 5", f"{_DRIFT} > 0.5"), f"case when declared_target_bytes > 0 then declared_target_bytes end as declared_bytes, median_bytes, case when {_DRIFTS} then {_DRIFT} end as drift"),
    "partition_spec_evolution": (_rank("specs <= 3 and old_files = 0", "specs > 6 or old_files > floor(files / 4)", "true"), "specs as spec_count, old_files as old_spec_files, files as total_files, old_bytes as old_spec_bytes"),
    "sort_compliance": (_rank(f"not ({_SORTED})", f"files > no_order and {_PCT.format('in_order', '(files - no_order)')} < 40", f"files = no_order or {_PCT.format('in_order', '(files - no_order)')} < 80"), f"case when {_SORTED} then files - no_order end as assessable, case when {_SORTED} then in_order end as matching, case when {_SORTED} and files > no_order then {_PCT.format('in_order', '(files - no_order)')} end as compliance_pct"),
    "stats_coverage": (_rank("files = 0", f"{_PCT.format('with_stats', 'files')} < 25", f"{_PCT.format('with_stats', 'files')} < 50"), f"files as total_files, with_stats, with_values as with_value_counts, with_nulls as with_null_counts, {_PCT.format('with_stats', 'files')} as coverage_pct"),
    "branch_health": (_rank("false", "dangling > 0", "stale > 0"), "branches, tags, healthy, stale, dangling"),
}
_NAMED = "case {} when 2 then 'CRITICAL' when 1 then 'WARNING' else 'PASS' end"
_FINDINGS = _WIDE + "found as (" + " union all ".join(f"select table_id, table_name, '{k}' as check_id, {rank} as r from w" for k, (rank, _) in _CHECKS.items()) + f"),\nstatus as (select table_id, table_name, max(r) as severity_rank, count(*) filter (r = 0) as pass_count, count(*) filter (r = 1) as warning_count, count(*) filter (r = 2) as critical_count, {_NAMED.format('max(r)')} as severity from found group by 1, 2)\n"
_AVERAGE = "(case when files > 0 then floor(bytes / files) else 134217728 end)"
_COSTS = {
    "orphan_storage": ("stored > files + deletes", "stored - files - deletes", f"(stored - files - deletes) * {_AVERAGE} / 1073741824e0 * 23e-3"),
    "snapshot_metadata": ("snapshots > 100 and metadata_size_bytes > 0", "snapshots", "(metadata_size_bytes * (snapshots - 100))::double / snapshots / 1073741824e0 * 23e-3"),
    "small_file_gets": ("fix_small > 0", "fix_small", "fix_small * 3e3 / 1e3 * 4e-4"),
    "manifest_gets": ("manifests > 0", "manifests", "manifests * 3e3 / 1e3 * 4e-4"),
    "delete_merge": ("deletes > 0", "deletes", "1024e-2 * least(1e0, 1e-3 * position_deletes + 5e-3 * equality_deletes) * 3e3 / 36e2 * 5e-2"),
}
_CALL = "concat('CALL catalog.system.{}(table => ''', replace(table_name, '''', ''''''), '''{})')"
_EVERY = ("files", "bytes", "partitions", "0")
_FIXES = {
    "small_files": (_CALL.format("rewrite_data_files", ", strategy => ''binpack''"), ("fix_small", "fix_small_bytes", "small_partitions", "0")),
    "snapshot_bloat": (_CALL.format("expire_snapshots", ", older_than => TIMESTAMP ''2024-01-20 00:00:00''"), ("0", "0", "0", "expired")),
    "orphan_files": (_CALL.format("remove_orphan_files", ", older_than => TIMESTAMP ''2024-01-24 00:00:00''"), ("orphans", "0", "0", "0")),
    "delete_pressure": (_CALL.format("rewrite_data_files", ", strategy => ''binpack''"), _EVERY),
    "metadata_size": (_CALL.format("rewrite_manifests", ""), ("manifests", "manifest_bytes", "0", "0")),
    "partition_skew": (_CALL.format("rewrite_data_files", ", strategy => ''sort''"), _EVERY),
    "format_v1": ("concat('ALTER TABLE ', table_name, ' SET TBLPROPERTIES (''format-version''=''2'')')", ("0", "0", "0", "0")),
    "properties_drift": ("concat('CALL catalog.system.rewrite_data_files(table => ''', table_name, ''', strategy => ''binpack'', options => map(''target-file-size-bytes'', ''', coalesce(declared_target_bytes, 536870912)::varchar, '''))')", _EVERY),
    "partition_spec_evolution": (_CALL.format("rewrite_data_files", ", options => map(''rewrite-all'', ''true'')"), ("old_files", "old_bytes", "0", "0")),
    "sort_compliance": (_CALL.format("rewrite_data_files", ", strategy => ''sort''"), ("unsorted_files", "unsorted_bytes", "unsorted_partitions", "0")),
    "stats_coverage": (_CALL.format("rewrite_data_files", ", strategy => ''binpack'', options => map(''rewrite-all'', ''true'')"), ("without_stats", "without_counts_bytes", "bare_partitions", "0")),
}


def _fix_sql(k: str, dry: bool = False) -> str:
    command, scope = _FIXES[k]
    columns = ", ".join(f"{x} as estimated_{n}" for x, n in zip(scope, ("files", "bytes", "partitions", "snapshots_expired")))
    return f"select table_id, table_name, '{k}' as finding_id, {'' if dry else command + ' as command, '}{columns} from w"


#: What the checks say of the demo table, which is the same every time; all others pass.
_DEMO = {k: "PASS" for k in REGISTRY} | {"small_files": "CRITICAL", "snapshot_bloat": "WARNING", "orphan_files": "WARNING", "partition_skew": "WARNING"}
_W = _WIDE.rstrip().rstrip(",") + "\n"
_HISTORY = with_views("check_history") + """,
h as (select table_id::varchar as table_name, severity, finding_count::bigint as finding_count, checked_at,
  list_filter([case when f_small_files = 1 then 'small_files' end, case when f_snapshot_bloat = 1 then 'snapshot_bloat' end, case when f_freshness = 1 then 'freshness' end], lambda x: x is not null) as ids from check_history),
lagged as (select *, lag(severity) over o as ps, lag(ids) over o as pi from h window o as (partition by table_name order by checked_at, severity, finding_count, ids)),
diff as (select *, coalesce(ps, 'unknown') as was, list_sort(list_filter(ids, lambda x: not list_contains(coalesce(pi, []), x))) as new, list_sort(list_filter(coalesce(pi, []), lambda x: not list_contains(ids, x))) as gone from lagged),
alerts as (select table_name, was as previous_severity, severity as current_severity, case when ps is null then concat('first run: ', len(ids), ' finding(s)') else concat_ws('; ', case when len(new) > 0 then concat('new: ', array_to_string(new, ', ')) end, case when len(gone) > 0 then concat('resolved: ', array_to_string(gone, ', ')) end, case when was <> severity then concat(was, ' -> ', severity) end) end as message, checked_at as alerted_at
  from diff where case when ps is null then severity <> 'PASS' else len(new) > 0 or len(gone) > 0 or ps <> severity end)
"""
_TREND = """,
named as (select distinct table_name from h),
win as (select *, row_number() over (partition by table_name order by checked_at, severity, finding_count, ids) as i, count(*) over (partition by table_name) as n, lag(severity) over (partition by table_name order by checked_at, severity, finding_count, ids) as before from h where checked_at >= timestamp '2024-01-29 00:00:00'),
agg as (select table_name, max(n) as checks, count(*) filter (before <> severity) as transitions, avg(finding_count) as avg_findings, avg(finding_count) filter (i <= n // 2) as older, avg(finding_count) filter (i > n // 2) as newer,
  arg_min(severity, i) as first_severity, arg_max(severity, i) as last_severity, arg_min(finding_count, i) as first_findings, arg_max(finding_count, i) as last_findings from win group by table_name)
select table_name, coalesce(checks, 0) as checks, coalesce(transitions, 0) as transitions, avg_findings, first_severity, last_severity, first_findings, last_findings,
  case when checks is null then 'no_data' when transitions >= 3 then 'flapping' when newer > coalesce(older, avg_findings) + 0.5 then 'degrading' when coalesce(older, avg_findings) > newer + 0.5 then 'improving' else 'stable' end as trend
from named left join agg using (table_name)"""
_COOLED = """,
numbered as (select *, row_number() over (partition by table_name, message order by alerted_at) as k from alerts),
fired as (select table_name, message, k, alerted_at as last, previous_severity, current_severity from numbered where k = 1
  union all select n.table_name, n.message, n.k, n.alerted_at, n.previous_severity, n.current_severity from (select f.*, (select min(k) from numbered m where m.table_name = f.table_name and m.message = f.message and m.alerted_at > f.last + interval 7 day) as nk from fired f) f
  join numbered n on n.table_name = f.table_name and n.message = f.message and n.k = f.nk)
select table_name, previous_severity, current_severity, message, last as alerted_at from fired"""


def oracle_sql() -> dict[str, str]:
    named = {"partition_spec_evolution": "spec_evolution"}
    spaced = "case when contains(table_name, '.') then regexp_extract(table_name, '^(.*)\\.', 1) else '<root>' end"
    latest = "select table_name, severity, finding_count, checked_at from h"
    return {
        **{k: f"{_W} select table_id, table_name, {_NAMED.format(rank)} as severity, {details} from w" for k, (rank, details) in _CHECKS.items()},
        "check_table": f"{_FINDINGS} select table_id, check_id, {_NAMED.format('r')} as severity from found",
        "check_table_filtered": f"{_FINDINGS} select table_id, check_id, {_NAMED.format('r')} as severity from found where check_id in ('small_files', 'freshness')",
        "overall_status": f"{_FINDINGS} select * from status",
        "table_summary": f"{_W} select table_id, table_name, snapshots as snapshot_count, files as data_file_count, bytes as total_size_bytes, rws as total_record_count from w",
        "small_file_hotspots": f"{_W} select * from (select table_id, partition_key, count(*) as small, row_number() over (partition by table_id order by count(*) desc, partition_key) as rank from data_files where file_size_bytes < 10000000 group by 1, 2) where rank <= 5",
        "schema_changes": f"{_W} select * from ch",
        "ref_health": f"{_W} select table_id, name, snapshot_id, state, age_days from rh",
        "orphan_paths": f"{_W} select * from orph",
        "manifest_stats": f"{_W} select * from mf",
        **{f"cost_{n}": f"{_W} select table_id, table_name, '{c}' as category, {_COSTS[c][1]} as quantity, {_COSTS[c][2]} as monthly_cost from w where {_COSTS[c][0]}" for n, c in (("orphan", "orphan_storage"), ("snapshot", "snapshot_metadata"), ("small_files", "small_file_gets"), ("manifest_gets", "manifest_gets"), ("delete_merge", "delete_merge"))},
        "cost_report": f"{_W} select table_id, table_name, {' + '.join(f'(case when {there} then 1 else 0 end)' for there, _, _ in _COSTS.values())} as items, {' + '.join(f'(case when {there} then {price} else 0e0 end)' for there, _, price in _COSTS.values())} as total_monthly_cost, 'USD' as currency from w",
        **{f"fix_{named.get(k, k)}": f"{_W} {_fix_sql(k)}" for k in _FIXES},
        "dry_run_fix": f"{_W} {' union all '.join(_fix_sql(k, True) for k in _FIXES)}",
        "fleet_namespace": f"{_FINDINGS} select {spaced} as namespace, count(*) as table_count, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'WARNING') as warning, count(*) filter (severity = 'PASS') as healthy from status group by 1",
        "fleet_by_severity": f"{_FINDINGS} select severity, count(*) as table_count from status group by 1",
        "fleet_dormant": f"{_W} select table_id, table_name, floor({_US.format('last_ts')} / 86400000000)::bigint as days_since from w where floor({_US.format('last_ts')} / 86400000000) >= 6",
        "fleet_unpartitioned": f"{_W} select table_id, table_name from w where partition_field_count = 0",
        "fleet_format_v1": f"{_W} select table_id, table_name from w where format_version = 1",
        "fleet_top_offenders": f"{_FINDINGS} select table_id, table_name, severity, critical_count, warning_count from status order by critical_count desc, warning_count desc, table_name limit 10",
        "catalog_summary": f"{_FINDINGS} select table_name, severity, critical_count, warning_count from status",
        "parse_metadata_json": f"{_W} select table_id::varchar as table_id, table_name, format_version, declared_target_bytes, default_spec_id, partition_field_count, sort_field_count, metadata_size_bytes from w",
        "parse_snapshots": f"{_W} select table_id::varchar as table_id, snapshot_id, 'append' as operation from snapshots",
        "demo_source": f"select * from (values {', '.join(f'({k!r}, {v!r})' for k, v in _DEMO.items())}) as t(check_id, severity)",
        "parse_manifest": f"{_W} select table_id::varchar as table_id, {', '.join(_DATA_FILE)} from data_files",
        "parse_delete_files": f"{_W} select table_id::varchar as table_id, {', '.join(_DELETE_FILE)} from delete_files",
        "parse_manifest_list": f"{_W} select table_id::varchar as table_id, manifest_path, manifest_length, 3 as added_files_count, 0 as deleted_files_count from manifests",
        "watch_cycle": f"{_FINDINGS} select table_name, severity, warning_count + critical_count as finding_count, critical_count, warning_count, coalesce(ids, '') as finding_ids, {_ASOF} as checked_at from status left join (select table_id, string_agg(check_id, ',' order by check_id) as ids from found where r > 0 group by table_id) using (table_id)",
        "fleet_report": f"{_FINDINGS} select 'by_namespace' as part, {spaced} as name, count(*) as value from status group by 2 union all select 'by_severity', severity, count(*) from status group by 2"
        f" union all select 'dormant', table_name, floor({_US.format('last_ts')} / 86400000000)::bigint from w where floor({_US.format('last_ts')} / 86400000000) >= 6 union all select 'unpartitioned', table_name, 1 from w where partition_field_count = 0"
        " union all select 'format_v1', table_name, 1 from w where format_version = 1 union all select * from (select 'top_offenders', table_name, critical_count from status order by critical_count desc, warning_count desc, table_name limit 10)",
        "latest_report": f"{_HISTORY} {latest} where table_name = '7' order by checked_at desc, severity desc, finding_count desc, ids desc limit 1",
        "history": f"{_HISTORY} {latest} where table_name = '7' order by checked_at desc, severity desc, finding_count desc, ids desc limit 20",
        "all_latest": f"{_HISTORY} {latest} where (table_name, checked_at) in (select table_name, max(checked_at) from h group by 1)",
        "trend": _HISTORY + _TREND,
        "detect_changes": f"{_HISTORY} select * from alerts",
        "alerts_recent": f"{_HISTORY} select * from alerts where table_name = '7' order by alerted_at desc, table_name, message limit 10",
        "alert_cooldown": _HISTORY.replace("with ", "with recursive ", 1) + _COOLED,
    }
