"""Metadata relations derived from star-schema tables, to run every analytic on data that any SQL engine has.

25 tables (one per nation) in five namespaces (one per region). The statements are plain SQL for two engines.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..model import Relations

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AS_OF = datetime(2024, 1, 27)
#: Overrides that leave tables on both sides of every bound.
THRESHOLDS = Thresholds(small_file_bytes=10_000_000, max_snapshots=200, stale_branch_days=14)

VIEWS = {
    "tables": """select n_nationkey as table_id, concat(r_name, '.', n_name) as table_name,
  case when n_nationkey % 8 = 7 then 1 else 2 end as format_version,
  case when n_nationkey % 5 = 0 then null else cast(2000000 as bigint) * (1 + n_nationkey) end as declared_target_bytes,
  1 as default_spec_id, 1 as sort_order_id,
  case when n_nationkey % 6 = 5 then 0 else 1 end as sort_field_count,
  case when n_nationkey % 7 = 6 then 0 else 1 end as partition_field_count,
  cast(4194304 as bigint) * n_nationkey * n_nationkey as metadata_size_bytes
from nation join region on n_regionkey = r_regionkey""",
    "order_rows": "select l_orderkey, count(*) as record_count from lineitem group by l_orderkey",
    "data_files": """select c_nationkey as table_id, concat('o/', cast(o_orderkey as string)) as file_path,
  cast(floor(o_totalprice * 100) as bigint) as file_size_bytes, record_count,
  case when c_nationkey % 4 = 1 then concat('digits=', cast(length(cast(o_orderkey as string)) as string))
       when c_nationkey % 4 = 3 then case when o_orderkey % 100 = 0 then 'h=c' when o_orderkey % 100 = 1 then 'h=b' else 'h=a' end
       else concat('year=', cast(year(o_orderdate) as string)) end as partition_key,
  case when o_orderpriority = '4-NOT SPECIFIED' then null
       when c_nationkey % 3 = 0 and o_orderpriority = '5-LOW' then 0
       when c_nationkey % 6 = 0 and o_orderpriority = '3-MEDIUM' then 2 else 1 end as spec_id,
  case when o_orderstatus = 'P' then null when o_orderkey % 30 < c_nationkey + 4 then 1 else 0 end as sort_order_id,
  case when o_orderkey % 25 < c_nationkey then 4 else 0 end as n_value_counts,
  case when o_orderkey % 50 < c_nationkey then 4 else 0 end as n_null_counts,
  case when o_orderkey % 25 < c_nationkey - 2 then 4 else 0 end as n_column_sizes
from orders join customer on o_custkey = c_custkey join order_rows on o_orderkey = l_orderkey""",
    "delete_files": """select c_nationkey as table_id, concat('d/', cast(l_orderkey as string)) as file_path,
  case when l_linestatus = 'O' then 'equality_delete' else 'position_delete' end as delete_type,
  cast(floor(l_quantity / 10) as bigint) as record_count, cast(floor(l_extendedprice) as bigint) as file_size_bytes
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where l_returnflag = 'R' and l_linenumber = 1 and l_orderkey % 50 < 2 * c_nationkey""",
    "storage_paths": """select c_nationkey as table_id, concat('o/', cast(o_orderkey as string)) as path
from orders join customer on o_custkey = c_custkey
union all select table_id, file_path as path from delete_files""",
    "snapshots": """select cast(user_id % 25 as int) as table_id, event_id as snapshot_id, ts
from events where extract(day from ts) <= 1 + user_id % 25""",
    "refs": """select table_id, concat('ref_', cast(snapshot_id as string)) as name,
  case when snapshot_id % 20 = 0 then 'branch' else 'tag' end as ref_type,
  case when table_id % 5 = 4 and snapshot_id % 30 = 0 then snapshot_id + 100000000 else snapshot_id end as snapshot_id
from snapshots where snapshot_id % 10 = 0
union all select table_id, 'main' as name, 'branch' as ref_type, max(snapshot_id) as snapshot_id from snapshots group by table_id""",
    "manifests": """select s_nationkey as table_id, concat('m/', cast(s_suppkey as string)) as manifest_path,
  cast(floor(s_acctbal * 100) as bigint) as manifest_length from supplier""",
    "partition_specs": "select table_id, cast(p_partkey as int) as spec_id from tables join part on p_partkey <= 1 + table_id % 9",
    "schema_fields": """select cast(p_partkey % 25 as int) as table_id, cast(floor(p_partkey / 25) as int) % 3 as schema_pos, p_type as name,
  case when min(p_partkey) % 7 = 0 then 'string' else 'int' end as field_type
from part where p_partkey % 25 % 5 <> 0 or cast(floor(p_partkey / 25) as int) % 3 = 0
group by 1, 2, 3""",
    "check_history": """select cast(user_id as int) as table_id, ts as checked_at,
  case when event_type = 'error' then 'CRITICAL' when event_type = 'purchase' then 'WARNING' else 'PASS' end as severity,
  cast(floor(abs(value)) as int) % 16 as finding_count,
  case when cast(regexp_extract(props, '[0-9]+', 0) as int) % 2 = 0 then 1 else 0 end as f_small_files,
  case when cast(regexp_extract(props, '[0-9]+', 0) as int) % 3 = 0 then 1 else 0 end as f_snapshot_bloat,
  case when cast(regexp_extract(props, '[0-9]+', 0) as int) % 5 = 0 then 1 else 0 end as f_freshness
from events""",
}
_NEEDS = {"data_files": ["order_rows"], "storage_paths": ["delete_files"], "refs": ["snapshots"], "partition_specs": ["tables"]}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they need."""
    wanted = {n for name in names for n in [*_NEEDS.get(name, []), name]}
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in VIEWS.items() if n in wanted)


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the star schema, opened once a session: its files are not expected to change."""
    opened = spark.__dict__.setdefault("_tablepulse_bases", {})
    if (sf_dir, name) not in opened:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        local = {c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"}
        opened[sf_dir, name] = rows.withColumns(local) if local else rows
    return opened[sf_dir, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation. Only the tables that its statement names are opened."""
    statement = f"{with_views(name)} select * from {name}"
    for base in BASE:
        if re.search(rf"\b{base}\b", statement):
            _base(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(statement)


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    names = ("tables", "data_files", "delete_files", "storage_paths", "snapshots", "refs", "manifests", "partition_specs", "schema_fields")
    return Relations.of(spark, **{n: partial(view, spark, sf_dir, n) for n in names})


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_compact(F.array(*(F.when(F.col(f"f_{c}") == 1, F.lit(c)) for c in ("small_files", "snapshot_bloat", "freshness"))))
    rows = view(spark, sf_dir, "check_history")
    zero = F.lit(0).cast("long")
    return rows.select(F.col("table_id").cast("string").alias("table_name"), "severity", F.col("finding_count").cast("long").alias("finding_count"), zero.alias("critical_count"), zero.alias("warning_count"), ids.alias("finding_ids"), F.lit(None).cast("string").alias("report"), "checked_at")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived tables and snapshots as metadata JSON, as a catalog would hand it out."""
    filled = lambda n: F.transform(F.filter(F.array(F.lit(1)), lambda x: n > 0), lambda x: F.struct(x.alias("source-id"), F.lit("identity").alias("transform"), F.lit("f").alias("name")))
    snapshots = view(spark, sf_dir, "snapshots").groupBy("table_id").agg(F.collect_list(F.struct(F.col("snapshot_id").alias("snapshot-id"), F.floor(F.unix_micros("ts") / 1000).alias("timestamp-ms"), F.create_map(F.lit("operation"), F.lit("append")).alias("summary"))).alias("snapshots"))
    rows = view(spark, sf_dir, "tables").join(snapshots, "table_id", "left")
    document = F.struct(
        F.col("format_version").alias("format-version"),
        F.lit("s3://bucket/table").alias("location"),
        F.when(F.col("declared_target_bytes").isNotNull(), F.create_map(F.lit("write.target-file-size-bytes"), F.col("declared_target_bytes").cast("string"))).alias("properties"),
        F.lit(1).alias("default-spec-id"),
        F.array(F.struct(F.lit(1).alias("spec-id"), filled(F.col("partition_field_count")).alias("fields"))).alias("partition-specs"),
        F.lit(1).alias("default-sort-order-id"),
        F.array(F.struct(F.lit(1).alias("order-id"), filled(F.col("sort_field_count")).alias("fields"))).alias("sort-orders"),
        "snapshots",
    )
    return rows.select(F.col("table_id").cast("string").alias("table_id"), "table_name", F.to_json(document).alias("json"), "metadata_size_bytes")
