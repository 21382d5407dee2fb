"""The relational model of table metadata: one DataFrame per collection, covering all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Columns that operators use. Relations may have more (a source's maps, for instance).
SCHEMAS = {
    "tables": "table_id string, table_name string, location string, format_version int, table_uuid string, current_snapshot_id long, default_spec_id int, sort_order_id int, sort_field_count int, sort_transforms array<string>, partition_field_count int, declared_target_bytes long, properties map<string,string>, metadata_size_bytes long",
    "schema_fields": "table_id string, schema_pos int, schema_id int, field_id int, name string, field_type string, required boolean",
    "snapshots": "table_id string, snapshot_id long, parent_snapshot_id long, ts timestamp, operation string, summary map<string,string>, manifest_list string, schema_id int",
    "refs": "table_id string, name string, ref_type string, snapshot_id long, max_ref_age_ms long, max_snapshot_age_ms long, min_snapshots_to_keep int",
    "partition_specs": "table_id string, spec_id int",
    "partition_fields": "table_id string, spec_id int, pos int, source_id int, field_id int, name string, transform string",
    "sort_fields": "table_id string, order_id int, pos int, source_id int, transform string, direction string, null_order string",
    "data_files": "table_id string, file_path string, file_size_bytes long, record_count long, partition map<string,string>, partition_key string, file_format string, column_sizes map<int,long>, value_counts map<int,long>, null_value_counts map<int,long>, n_column_sizes int, n_value_counts int, n_null_counts int, sort_order_id int, spec_id int",
    "delete_files": "table_id string, file_path string, file_size_bytes long, record_count long, delete_type string, equality_ids array<int>",
    "manifests": "table_id string, manifest_path string, manifest_length long, partition_spec_id int, content int, added_snapshot_id long, added_files_count int, existing_files_count int, deleted_files_count int, added_rows_count long, existing_rows_count long, deleted_rows_count long",
    "storage_paths": "table_id string, path string, size long",
    "unreadable": "table_id string, path string, error string",
}


class Relations:
    """DataFrames by the names of ``SCHEMAS``. One may be given as a function that makes it when it is first used;
    those that are not given are empty. ``memo`` holds what operators have worked out and share."""

    def __init__(self, spark: SparkSession, given: dict[str, DataFrame | Callable[[], DataFrame]]):
        if unknown := set(given) - set(SCHEMAS):
            raise ValueError(f"no such relations: {sorted(unknown)}")
        self.spark, self._given, self.memo = spark, dict(given), {}

    @classmethod
    def of(cls, spark: SparkSession, **given: DataFrame | Callable[[], DataFrame]) -> Relations:
        return cls(spark, given)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        found = self._given.get(name)
        if not isinstance(found, DataFrame):
            found = self._given[name] = found() if found else self.spark.createDataFrame([], SCHEMAS[name])
        return found

    def with_(self, **changed: DataFrame) -> Relations:
        return Relations(self.spark, self._given | changed)
