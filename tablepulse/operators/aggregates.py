"""Per-table aggregates that checks, costs and fixes read.

``data_files`` is by far the largest relation. Counts and sums of it come from a cube per (table, partition, spec,
sort order); where several aggregates are wanted the cube is written once (``share_cube``) and read by all of them.
Median sizes and orphans are passes of their own. A table that holds a third of all files is merged map-side.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Thresholds
from ..functions.expressions import UNPARTITIONED, whole
from ..model import Relations
from .checkpoint import checkpointed
from .order_stats import order_stats

#: Small files for costs and fixes, whatever the threshold of the check is (fixed value).
FIX_SMALL_BYTES = 8 << 20
_COUNTS = ("files", "bytes", "rows", "small", "small_bytes", "fix_small", "fix_small_bytes", "with_stats", "with_values", "with_nulls", "without_stats", "without_counts_bytes")


#: Aggregates that read files: by the cube, by sizes, by paths.
_PASSES = {"files": "cube", "skew": "cube", "hotspots": "cube", "medians": "sizes", "orphans": "paths", "samples": "paths"}
_FILE = ("table_id", "file_path", "file_size_bytes", "record_count", "partition_key", "spec_id", "sort_order_id", "n_value_counts", "n_null_counts", "n_column_sizes")


def shared(rel: Relations, th: Thresholds, needs: Iterable[str]) -> Relations:
    """``rel`` with what several of ``needs`` read worked out now: files where more than one pass goes over them
    (unless the source has written them already), and the cube where more than one aggregate comes from it."""
    needs = set(needs)
    if len({_PASSES[n] for n in needs if n in _PASSES}) > 1 and not rel.memo.get("written"):
        rel = rel.with_(data_files=checkpointed(rel.data_files.select(*_FILE)))
        rel.memo["written"] = True
    if sum(_PASSES.get(n) == "cube" for n in needs) > 1:
        share_cube(rel, th)
    return rel


def share_cube(rel: Relations, th: Thresholds) -> None:
    """Works out the cube now; aggregates of ``rel`` with the same thresholds then read it."""
    if th.small_file_bytes not in rel.memo:
        rel.memo[th.small_file_bytes] = checkpointed(file_cube(rel, th))


def file_cube(rel: Relations, th: Thresholds) -> DataFrame:
    if th.small_file_bytes in rel.memo:
        return rel.memo[th.small_file_bytes]
    size, one = F.col("file_size_bytes"), F.lit(1)
    small, fix_small = size < th.small_file_bytes, size < FIX_SMALL_BYTES
    values, nulls, sizes = F.coalesce("n_value_counts", F.lit(0)) > 0, F.coalesce("n_null_counts", F.lit(0)) > 0, F.coalesce("n_column_sizes", F.lit(0)) > 0
    count = lambda c: F.coalesce(F.sum(F.when(c, one)), F.lit(0)).cast("long")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    return rel.data_files.groupBy("table_id", F.coalesce("partition_key", F.lit(UNPARTITIONED)).alias("partition_key"), "spec_id", "sort_order_id").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("rows"),
        count(small).alias("small"),
        total(small, size).alias("small_bytes"),
        count(fix_small).alias("fix_small"),
        total(fix_small, size).alias("fix_small_bytes"),
        count(values | nulls | sizes).alias("with_stats"),
        count(values).alias("with_values"),
        count(nulls).alias("with_nulls"),
        count(~(values | nulls | sizes)).alias("without_stats"),
        total(~(values | nulls), size).alias("without_counts_bytes"),
    )


def _partitions(cube: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table and partition, with what differs from the table's spec and sort order."""
    known = tables.select("table_id", "default_spec_id", F.col("sort_order_id").alias("declared_order"), "sort_field_count")
    joined = cube.join(known, "table_id")
    old = F.col("spec_id") != F.col("default_spec_id")
    declared = F.coalesce("sort_field_count", F.lit(0)) > 0
    # files without a known order are not "declared non-matching"; a table without an order has nothing to match
    unsorted = declared & F.col("sort_order_id").isNotNull() & (F.col("sort_order_id") != F.col("declared_order"))
    unsorted = F.coalesce(unsorted, F.lit(False)) | (~declared & F.col("sort_order_id").isNotNull() & (F.col("sort_order_id") != 0))
    when = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast("long")
    return joined.groupBy("table_id", "partition_key").agg(
        *(F.sum(c).alias(c) for c in _COUNTS),
        when(old, "files").alias("old_files"),
        when(old, "bytes").alias("old_bytes"),
        when(F.col("sort_order_id").isNull(), "files").alias("no_order"),
        when(F.col("sort_order_id") == F.col("declared_order"), "files").alias("in_order"),
        when(unsorted, "files").alias("unsorted_files"),
        when(unsorted, "bytes").alias("unsorted_bytes"),
    )


def partition_stats(rel: Relations, th: Thresholds) -> DataFrame:
    return _partitions(file_cube(rel, th), rel.tables)


def file_stats(rel: Relations, th: Thresholds) -> DataFrame:
    """Per table that has files."""
    part = partition_stats(rel, th)
    sums = [c for c in part.columns if c not in ("table_id", "partition_key")]
    distinct = {"partitions": "files", "small_partitions": "fix_small", "unsorted_partitions": "unsorted_files", "bare_partitions": "without_stats"}
    return part.groupBy("table_id").agg(*(F.sum(c).alias(c) for c in sums), *(F.count(F.when(F.col(c) > 0, 1)).alias(name) for name, c in distinct.items()))


def delete_stats(rel: Relations) -> DataFrame:
    position = F.col("delete_type") == "position_delete"
    return rel.delete_files.groupBy("table_id").agg(
        F.count("*").alias("deletes"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("delete_bytes"), F.count(F.when(position, 1)).alias("position_deletes"), F.count(F.when(~position, 1)).alias("equality_deletes"), F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("delete_rows")
    )


def snapshot_stats(rel: Relations) -> DataFrame:
    return rel.snapshots.groupBy("table_id").agg(F.count("*").alias("snapshots"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def spec_stats(rel: Relations) -> DataFrame:
    return rel.partition_specs.groupBy("table_id").agg(F.count("*").alias("specs"))


def orphan_paths(rel: Relations) -> DataFrame:
    """Storage paths that no data or delete file has; repeated paths stay repeated."""
    known = rel.data_files.select("table_id", F.col("file_path").alias("path")).unionByName(rel.delete_files.select("table_id", F.col("file_path").alias("path")))
    return rel.storage_paths.select("table_id", "path").join(known, ["table_id", "path"], "left_anti")


def orphan_stats(rel: Relations) -> DataFrame:
    return orphan_paths(rel).groupBy("table_id").agg(F.count("*").alias("orphans"))


def storage_stats(rel: Relations) -> DataFrame:
    return rel.storage_paths.groupBy("table_id").agg(F.count("*").alias("stored"))


def size_medians(rel: Relations) -> DataFrame:
    return order_stats(rel.data_files, ["table_id"], "file_size_bytes", {"median_bytes": 50}).drop("n")


def manifest_stats(rel: Relations) -> DataFrame:
    """Count, sum, upper median and greatest length of manifests; negative lengths count as 0."""
    lengths = rel.manifests.select("table_id", F.greatest(F.col("manifest_length"), F.lit(0)).alias("length"))
    sums = lengths.groupBy("table_id").agg(F.count("*").alias("manifests"), F.sum("length").alias("manifest_bytes"), F.max("length").alias("max_manifest"))
    return sums.join(order_stats(lengths, ["table_id"], "length", {"median_manifest": 50}).drop("n"), "table_id", "left")


DIMENSIONS = ("files", "bytes", "rows")


def skew_stats(rel: Relations, th: Thresholds) -> DataFrame:
    """Of the partitions of each table: order statistics of files, bytes and rows, and the partition of most bytes."""
    part = partition_stats(rel, th).select("table_id", "partition_key", *DIMENSIONS)
    long = part.select("table_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*DIMENSIONS))).alias("dimension", "value"))
    stats = order_stats(long, ["table_id", "dimension"], "value", {"p50": 50, "p95": 95, "p99": 99})
    wide = stats.groupBy("table_id").agg(*(F.max(F.when(F.col("dimension") == d, F.col(p))).alias(f"{d}_{p}") for d in DIMENSIONS for p in ("p50", "p95", "p99")))
    order = F.struct(F.col("bytes").alias("b"))
    top = part.groupBy("table_id").agg(
        F.count("*").alias("partition_count"), *(F.max(d).alias(f"{d}_max") for d in DIMENSIONS), *(F.sum(d).alias(f"{d}_sum") for d in DIMENSIONS), F.min_by("partition_key", F.struct((-F.col("bytes")).alias("b"), "partition_key")).alias("hot_partition")
    )
    return top.join(wide, "table_id")


def schema_changes(rel: Relations) -> DataFrame:
    """(table_id, schema_pos, name, change) between schemas that follow one another: dropped, added or retyped."""
    positions = rel.schema_fields.select("table_id", "schema_pos").distinct()
    follows = positions.select("table_id", (F.col("schema_pos") + 1).alias("schema_pos")).join(positions, ["table_id", "schema_pos"])
    field = rel.schema_fields.select("table_id", "schema_pos", "name", "field_type")
    before = field.select("table_id", (F.col("schema_pos") + 1).alias("schema_pos"), "name", F.col("field_type").alias("was")).join(follows, ["table_id", "schema_pos"])
    after = field.select("table_id", "schema_pos", "name", F.col("field_type").alias("now")).join(follows, ["table_id", "schema_pos"])
    both = before.join(after, ["table_id", "schema_pos", "name"], "full_outer")
    kind = F.when(F.col("now").isNull(), "dropped").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "retyped")
    return both.select("table_id", "schema_pos", "name", "was", "now", kind.alias("change")).where("change is not null")


def schema_stats(rel: Relations) -> DataFrame:
    count = rel.schema_fields.groupBy("table_id").agg(F.countDistinct("schema_pos").alias("schemas"))
    kinds = schema_changes(rel).groupBy("table_id").agg(*(F.count(F.when(F.col("change") == k, 1)).alias(k) for k in ("dropped", "added", "retyped")))
    return count.join(kinds, "table_id", "left")


def ref_health(rel: Relations, th: Thresholds, as_of: datetime) -> DataFrame:
    """Each ref but main: dangling (its snapshot is gone), stale (older than allowed) or healthy, with whole days."""
    found = rel.refs.where("name <> 'main'").join(rel.snapshots.select("table_id", "snapshot_id", "ts"), ["table_id", "snapshot_id"], "left")
    age = F.unix_micros(F.lit(as_of)) - F.unix_micros("ts")
    state = F.when(F.col("ts").isNull(), "dangling").when(age > th.stale_branch_days * 86_400_000_000, "stale").otherwise("healthy")
    return found.select("table_id", "name", "ref_type", "snapshot_id", state.alias("state"), whole("day", F.col("ts"), F.lit(as_of)).alias("age_days"))


def ref_stats(rel: Relations, th: Thresholds, as_of: datetime) -> DataFrame:
    branch = F.col("ref_type") == "branch"
    return ref_health(rel, th, as_of).groupBy("table_id").agg(
        F.count(F.when(branch, 1)).alias("branches"), F.count(F.when(~branch, 1)).alias("tags"), *(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("dangling", "stale", "healthy"))
    )


def hotspots(rel: Relations, th: Thresholds, k: int = 5) -> DataFrame:
    """The ``k`` partitions of each table with most small files; ties by partition."""
    order = Window.partitionBy("table_id").orderBy(F.desc("small"), "partition_key")
    small = partition_stats(rel, th).where("small > 0").select("table_id", "partition_key", "small")
    return small.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hotspot_lists(rel: Relations, th: Thresholds) -> DataFrame:
    """``top_partitions``: the hot spots of each table as an array, most small files first."""
    spot = F.struct("rank", F.col("partition_key").alias("partition"), F.col("small").alias("small_files"))
    rows = hotspots(rel, th).groupBy("table_id").agg(F.sort_array(F.collect_list(spot)).alias("s"))
    return rows.select("table_id", F.transform("s", lambda x: F.struct(x["partition"].alias("partition"), x["small_files"].alias("small_files"))).alias("top_partitions"))


def orphan_samples(rel: Relations, k: int = 10) -> DataFrame:
    """``sample_orphans``: the first ``k`` orphan paths of each table. Each task keeps ``k`` of a table at most."""
    order = Window.partitionBy("table_id").orderBy("path")
    first = orphan_paths(rel).withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    return first.groupBy("table_id").agg(F.sort_array(F.collect_list("path")).alias("sample_orphans"))


_SOURCES = {
    "hotspots": lambda rel, th, as_of: hotspot_lists(rel, th),
    "samples": lambda rel, th, as_of: orphan_samples(rel),
    "files": lambda rel, th, as_of: file_stats(rel, th),
    "deletes": lambda rel, th, as_of: delete_stats(rel),
    "snapshots": lambda rel, th, as_of: snapshot_stats(rel),
    "specs": lambda rel, th, as_of: spec_stats(rel),
    "orphans": lambda rel, th, as_of: orphan_stats(rel),
    "storage": lambda rel, th, as_of: storage_stats(rel),
    "medians": lambda rel, th, as_of: size_medians(rel),
    "manifests": lambda rel, th, as_of: manifest_stats(rel),
    "skew": lambda rel, th, as_of: skew_stats(rel, th),
    "schemas": lambda rel, th, as_of: schema_stats(rel),
    "refs": lambda rel, th, as_of: ref_stats(rel, th, as_of),
}
#: Absent groups have no members, not unknown ones.
_ZERO = {"files", "bytes", "delete_bytes", "rows", "small", "deletes", "snapshots", "specs", "orphans", "stored", "manifests", "schemas", "dangling", "stale", "healthy", "branches", "tags", "dropped", "added", "retyped", "partition_count", "partitions"}


def wide(rel: Relations, th: Thresholds, as_of: datetime, needs: Iterable[str]) -> DataFrame:
    """One row for each table of ``rel.tables``, with the aggregates named in ``needs`` beside it."""
    out, needs = rel.tables, list(dict.fromkeys(needs))
    rel = shared(rel, th, needs)
    for need in needs:
        out = out.join(_SOURCES[need](rel, th, as_of), "table_id", "left")
    floats = {"hot_partition", "first_ts", "last_ts"}
    keys = set(rel.tables.columns)
    zero = [c for c, t in out.dtypes if c not in keys and c not in floats and t in ("bigint", "int") and (c in _ZERO or not c.endswith(("p50", "p95", "p99")))]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero if not c.startswith("median")})
