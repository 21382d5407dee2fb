"""A synthetic table with problems of most kinds, for a first look."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Relations

MIB = 1 << 20
NAME = "demo.events"


def demo_relations(spark: SparkSession, as_of: datetime) -> Relations:
    """50 files of 128 MiB over 28 partitions, 25 of 512 KiB in one, 3 orphans, 120 snapshots two hours apart."""
    day = lambda i: F.concat(F.lit("day=2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"))
    i = F.col("id")

    def files(n: int, size: int, rows: int, prefix: str, key) -> DataFrame:
        return spark.range(n).select(F.lit(NAME).alias("table_id"), F.concat(F.lit(f"data/{prefix}-"), i, F.lit(".parquet")).alias("file_path"), F.lit(size).cast("long").alias("file_size_bytes"), F.lit(rows).cast("long").alias("record_count"), key.alias("partition_key"), F.lit("parquet").alias("file_format"), F.lit(3).alias("n_column_sizes"), F.lit(3).alias("n_value_counts"), F.lit(3).alias("n_null_counts"), F.lit(0).alias("sort_order_id"), F.lit(0).alias("spec_id"))

    data = files(50, 128 * MIB, 1_000_000, "large", day(i)).unionByName(files(25, MIB // 2, 4_000, "small", F.lit("day=2024-01-15")))
    snapshots = spark.range(120).select(F.lit(NAME).alias("table_id"), (i + 1).alias("snapshot_id"), F.when(i > 0, i).alias("parent_snapshot_id"), F.timestamp_micros(F.unix_micros(F.lit(as_of)) - (119 - i) * 7_200_000_000).alias("ts"), F.lit("append").alias("operation"), F.lit(0).alias("schema_id"))
    tables = spark.createDataFrame([(NAME, NAME, "demo/events", 2, 120, 0, 0, 1, 45 * MIB)], "table_id string, table_name string, location string, format_version int, current_snapshot_id long, default_spec_id int, sort_field_count int, partition_field_count int, metadata_size_bytes long")
    tables = tables.withColumns({"sort_order_id": F.lit(None).cast("int"), "declared_target_bytes": F.lit(None).cast("long"), "sort_transforms": F.lit(None).cast("array<string>")})
    fields = spark.createDataFrame([(NAME, 0, 0, k + 1, n, t, k == 0) for k, (n, t) in enumerate((("id", "long"), ("day", "date"), ("value", "double")))], "table_id string, schema_pos int, schema_id int, field_id int, name string, field_type string, required boolean")
    orphans = spark.range(3).select(F.lit(NAME).alias("table_id"), F.concat(F.lit("data/orphan-"), i, F.lit(".parquet")).alias("path"))
    paths = data.select("table_id", F.col("file_path").alias("path")).unionByName(orphans)
    specs = spark.createDataFrame([(NAME, 0)], "table_id string, spec_id int")
    return Relations.of(spark, tables=tables, data_files=data, snapshots=snapshots, schema_fields=fields, storage_paths=paths, partition_specs=specs)
