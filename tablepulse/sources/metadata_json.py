"""Table metadata JSON (format versions 1 and 2) as rows of the model, by Spark's own JSON functions.

Documents of any number of tables are parsed in one plan. Types of fields stay text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = "struct<id:int,name:string,required:boolean,type:string>"
_SCHEMA = f"struct<`schema-id`:int,fields:array<{_FIELD}>>"
_PARTITION = "struct<`source-id`:int,`field-id`:int,name:string,transform:string>"
_SORT = "struct<`source-id`:int,transform:string,direction:string,`null-order`:string>"
DOCUMENT = f"""struct<`format-version`:int,`table-uuid`:string,location:string,`current-snapshot-id`:bigint,`current-schema-id`:int,`default-spec-id`:int,`default-sort-order-id`:int,
  properties:map<string,string>,schema:{_SCHEMA},schemas:array<{_SCHEMA}>,`partition-spec`:array<{_PARTITION}>,
  `partition-specs`:array<struct<`spec-id`:int,fields:array<{_PARTITION}>>>,`sort-orders`:array<struct<`order-id`:int,fields:array<{_SORT}>>>,
  snapshots:array<struct<`snapshot-id`:bigint,`parent-snapshot-id`:bigint,`timestamp-ms`:bigint,summary:map<string,string>,`manifest-list`:string,`schema-id`:int>>,
  refs:map<string,struct<`snapshot-id`:bigint,type:string,`max-ref-age-ms`:bigint,`max-snapshot-age-ms`:bigint,`min-snapshots-to-keep`:int>>>""".replace("\n", "")
TARGET_SIZE = "write.target-file-size-bytes"


def parse(documents: DataFrame) -> DataFrame:
    """(table_id, table_name, json, metadata_size_bytes) with the parsed document ``m``, defaults filled in.

    A document without a location or format version is no table metadata: it is an error, with the table's name.
    """
    m = F.from_json("json", DOCUMENT)
    rows = documents.withColumn("m", m)
    bad = F.concat(F.lit("not table metadata: "), "table_name")
    rows = rows.withColumn("m", F.when(F.col("m.location").isNotNull() & F.col("m.format-version").isNotNull(), F.col("m")).otherwise(F.raise_error(bad)))
    d = lambda name: F.col(f"m.`{name}`")
    schemas = F.coalesce(d("schemas"), F.when(d("schema").isNotNull(), F.array(d("schema"))), F.array().cast(f"array<{_SCHEMA}>"))
    single = F.when(d("partition-spec").isNotNull(), F.array(F.struct(F.lit(0).alias("spec-id"), d("partition-spec").alias("fields"))))
    specs = F.coalesce(d("partition-specs"), single, F.array().cast(f"array<struct<`spec-id`:int,fields:array<{_PARTITION}>>>"))
    return rows.withColumns({"schemas": schemas, "specs": specs})


def _pick(items: Column, matches) -> Column:
    """The first item that matches, else the first, else null."""
    return F.coalesce(F.get(F.filter(items, matches), F.lit(0)), F.get(items, F.lit(0)))


def tables(parsed: DataFrame) -> DataFrame:
    d = lambda name: F.col(f"m.`{name}`")
    spec = _pick(F.col("specs"), lambda s: s["spec-id"] == F.coalesce(d("default-spec-id"), F.lit(0)))
    wanted = F.coalesce(d("default-sort-order-id"), F.lit(0))
    order = F.get(F.filter(F.coalesce(d("sort-orders"), F.array().cast(f"array<struct<`order-id`:int,fields:array<{_SORT}>>>")), lambda o: (o["order-id"] == wanted) & (F.size(o["fields"]) > 0)), F.lit(0))
    declared = F.expr("try_cast(trim(element_at(m.properties, 'write.target-file-size-bytes')) as bigint)")
    return parsed.select(
        "table_id",
        "table_name",
        d("location").alias("location"),
        d("format-version").alias("format_version"),
        d("table-uuid").alias("table_uuid"),
        d("current-snapshot-id").alias("current_snapshot_id"),
        F.coalesce(spec["spec-id"], F.lit(0)).alias("default_spec_id"),
        order["order-id"].alias("sort_order_id"),
        F.coalesce(F.size(order["fields"]), F.lit(0)).alias("sort_field_count"),
        F.transform(order["fields"], lambda f: f["transform"]).alias("sort_transforms"),
        F.coalesce(F.size(spec["fields"]), F.lit(0)).alias("partition_field_count"),
        F.when(declared > 0, declared).alias("declared_target_bytes"),
        d("properties").alias("properties"),
        F.coalesce("metadata_size_bytes", F.octet_length("json").cast("long")).alias("metadata_size_bytes"),
    )


def schema_fields(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("table_id", F.posexplode("schemas").alias("schema_pos", "s")).select("table_id", "schema_pos", F.coalesce(F.col("s.schema-id"), F.lit(0)).alias("schema_id"), F.explode("s.fields").alias("f"))
    return rows.select("table_id", "schema_pos", "schema_id", F.col("f.id").alias("field_id"), "f.name", F.col("f.type").alias("field_type"), F.coalesce("f.required", F.lit(False)).alias("required"))


def snapshots(parsed: DataFrame) -> DataFrame:
    s = lambda name: F.col(f"s.`{name}`")
    rows = parsed.select("table_id", F.explode("m.snapshots").alias("s"))
    return rows.select("table_id", s("snapshot-id").alias("snapshot_id"), s("parent-snapshot-id").alias("parent_snapshot_id"), F.timestamp_millis(s("timestamp-ms")).alias("ts"), F.element_at("s.summary", "operation").alias("operation"), "s.summary", s("manifest-list").alias("manifest_list"), s("schema-id").alias("schema_id"))


def refs(parsed: DataFrame) -> DataFrame:
    r = lambda name: F.col(f"r.`{name}`")
    rows = parsed.select("table_id", F.explode("m.refs").alias("name", "r"))
    return rows.select("table_id", "name", F.coalesce(r("type"), F.lit("branch")).alias("ref_type"), r("snapshot-id").alias("snapshot_id"), r("max-ref-age-ms").alias("max_ref_age_ms"), r("max-snapshot-age-ms").alias("max_snapshot_age_ms"), r("min-snapshots-to-keep").alias("min_snapshots_to_keep"))


def partition_specs(parsed: DataFrame) -> DataFrame:
    return parsed.select("table_id", F.explode("specs").alias("s")).select("table_id", F.col("s.spec-id").alias("spec_id"))


def partition_fields(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("table_id", F.explode("specs").alias("s")).select("table_id", F.col("s.spec-id").alias("spec_id"), F.posexplode("s.fields").alias("pos", "f"))
    source = F.col("f.source-id")
    return rows.select("table_id", "spec_id", "pos", source.alias("source_id"), F.coalesce(F.col("f.field-id"), source + 1000).alias("field_id"), "f.name", "f.transform")


def sort_fields(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("table_id", F.explode("m.sort-orders").alias("o")).select("table_id", F.col("o.order-id").alias("order_id"), F.posexplode("o.fields").alias("pos", "f"))
    return rows.select("table_id", "order_id", "pos", F.col("f.source-id").alias("source_id"), "f.transform", "f.direction", F.col("f.null-order").alias("null_order"))
