"""Sources end to end: real files in, findings out."""

import io
import json
from datetime import datetime, timezone

import pytest

from tablepulse import cli
from tablepulse.config import Catalog as Settings
from tablepulse.config import Config, Watch
from tablepulse.sources import metadata_json
from tablepulse.sources.avro import read_container
from tablepulse.sources.avro_writer import MANIFEST, container, entry, write_table
from tablepulse.operators import aggregates
from tablepulse.server import serve
from tablepulse.sources.catalog import Document, FilesystemCatalog, GlueCatalog, RestCatalog, TableNotFound, from_config, resolve_path
from tablepulse.sources.manifests import manifest_rows
from tablepulse.sources.reader import load, relations_of
from tablepulse.sources.store import fetch_bytes, hadoop_location
from tablepulse.tools import Tools

NOW = datetime(2023, 11, 15)
MIB = 1 << 20


@pytest.fixture(scope="module")
def warehouse(tmp_path_factory):
    top = tmp_path_factory.mktemp("wh")
    write_table(top / "db" / "healthy", [entry(str(top / f"db/healthy/data/f{i}.parquet"), 128 * MIB, 1_500_000) for i in range(10)])
    small = [entry(f"data/s{i}.parquet", 100 << 10, 500) for i in range(200)] + [entry(f"data/b{i}.parquet", 128 * MIB, 1_000_000) for i in range(10)]
    write_table(top / "db" / "small", small, codec="deflate")
    write_table(top / "db" / "drift", [entry("data/a.parquet", 64 * MIB, 5)], schemas=[[("id", "long"), ("name", "string"), ("email", "string"), ("age", "int")], [("id", "long"), ("name", "string"), ("age", "string"), ("address", "string")]])
    write_table(top / "orphans", [entry("data/a.parquet", 64 * MIB, 5)], extra=[f"orphan-{i}.parquet" for i in range(15)])
    return top


def test_avro_reads_what_is_written():
    rows = [
        entry("a", 5, 2, partition={"day": 19000, "kind": "x"}, column_sizes=[{"key": 1, "value": 10}], value_counts=[{"key": 1, "value": 2}], null_value_counts={"1": 0}, sort_order_id=3),
        entry("gone", 5, 2, status=2),
        entry("p", 1, 1, content=1),
        entry("e", 1, 1, content=2, equality_ids=[4, 5]),
        entry("odd", 1, 1, content=9),
    ]
    for codec in ("null", "deflate"):
        data = container(MANIFEST, rows, codec)
        assert len(list(read_container(data))) == 5
        got = list(manifest_rows(data, 7))
        assert [(k, r["file_path"]) for k, r in got] == [("data_files", "a"), ("delete_files", "p"), ("delete_files", "e")]
        first = got[0][1]
        assert (first["partition"], first["partition_key"], first["column_sizes"], first["null_value_counts"], first["sort_order_id"], first["spec_id"]) == ({"day": "19000", "kind": "x"}, "day=19000/kind=x", {1: 10}, {1: 0}, 3, 7)
        assert got[2][1]["equality_ids"] == [4, 5]
    with pytest.raises(ValueError):
        list(read_container(b"nothing"))
    with pytest.raises(ValueError):
        list(read_container(container(MANIFEST, rows)[:-5]))


def test_avro_agrees_with_the_java_library(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    schema = jvm.org.apache.avro.Schema.Parser().parse('{"type":"record","name":"r","fields":[{"name":"a","type":["null","long"]},{"name":"b","type":{"type":"map","values":"int"}}]}')
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
    path = tmp_path / "x.avro"
    writer.create(schema, jvm.java.io.File(str(path)))
    for a in (None, -(1 << 40), 1 << 40):
        r = jvm.org.apache.avro.generic.GenericData.Record(schema)
        if a is not None:
            r.put("a", jvm.java.lang.Long(a))
        m = jvm.java.util.HashMap()
        m.put("k", 3)
        r.put("b", m)
        writer.append(r)
    writer.close()
    assert list(read_container(path.read_bytes())) == [{"a": a, "b": {"k": 3}} for a in (None, -(1 << 40), 1 << 40)]


def test_filesystem_catalog(warehouse, tmp_path):
    c = FilesystemCatalog(str(warehouse))
    assert c.list_tables() == ["db.drift", "db.healthy", "db.small", "orphans"]
    assert c.list_tables("db") == ["db.drift", "db.healthy", "db.small"]
    with pytest.raises(TableNotFound):
        c.document("db.nothing")
    meta = tmp_path / "t" / "metadata"
    meta.mkdir(parents=True)
    for n in ("v2", "v10", "v9"):
        (meta / f"{n}.metadata.json").write_text("{}")
    assert FilesystemCatalog(str(tmp_path)).find_metadata(tmp_path / "t").name == "v10.metadata.json"


def test_paths(warehouse):
    folder = str(warehouse / "db" / "small")
    assert resolve_path("s3://bucket/x/metadata/m1.avro", folder, str(warehouse)).endswith("small/metadata/m1.avro")
    assert resolve_path(f"s3://bucket/db/small/metadata/m1.avro", "/nowhere", str(warehouse)) == str(warehouse / "db/small/metadata/m1.avro")
    assert resolve_path("metadata/m1.avro", folder, None).endswith("small/metadata/m1.avro")
    assert resolve_path("s3://b/none.avro", folder, str(warehouse)) == "s3://b/none.avro"
    assert hadoop_location("s3://a/b") == "s3a://a/b"
    with pytest.raises(ValueError):
        fetch_bytes("ftp://x/y")


def test_end_to_end(spark, warehouse):
    tools = Tools(spark, Config(catalog=Settings("filesystem", str(warehouse))), as_of=NOW)
    healthy = tools.check_table("db.healthy")
    assert {f["check_id"] for f in healthy["findings"] if f["severity"] != "PASS"} == {"stats_coverage"}
    assert healthy["summary"]["total_record_count"] == 15_000_000 and healthy["unreadable"] == []
    assert all(f["message"].startswith(f["check_name"]) for f in healthy["findings"])
    small = tools.check_table("db.small", ["small_files"])
    assert small["overall"]["severity"] == "CRITICAL"
    drift = json.loads(tools.check_table("db.drift", ["schema_history"])["findings"][0]["details"])
    assert (drift["breaking"], drift["additive"]) == (2, 1)
    catalog = tools.check_catalog()
    assert catalog["total"] == 4 and catalog["tables"][0]["severity"] == "CRITICAL"
    assert tools.check_fleet()["by_severity"]
    assert "error" in tools.check_table("db.nothing")
    assert "error" in tools.get_fix("db.small", "freshness")
    assert tools.get_fix("db.small", "small_files")["scope"]["estimated_files"] == 200
    assert "command" not in tools.dry_run_fix("db.small", "small_files")
    assert tools.get_cost_report("db.small")["total_monthly_cost"] > 0


def test_tables_behind_a_file_system_that_only_spark_reads(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./x", f"file://{tmp_path}/t")
    files = [entry(f"viewfs://lake/x/data/f{i}.parquet", 1 << 20, 10) for i in range(7)] + [entry("viewfs://lake/x/data/d.parquet", 5, 1, content=1)]
    write_table(tmp_path / "t", files, extra=["orphan.parquet"], top="viewfs://lake/x")
    text = (tmp_path / "t/metadata/v1.metadata.json").read_text()
    good, listless = Document("a.t", text), Document("a.bad", text.replace("snap-1.avro", "gone.avro"))
    failed = {}
    rel = relations_of(spark, [good, listless, Document("a.none", text.replace("viewfs://lake/x", "nowhere://x"))], failed)
    assert set(failed) == {"a.bad", "a.none"} and "manifest list" in failed["a.bad"]
    assert [r["table_id"] for r in rel.tables.collect()] == ["a.t"]
    assert (rel.data_files.count(), rel.delete_files.count(), rel.unreadable.count()) == (7, 1, 0)
    assert [r["path"] for r in aggregates.orphan_paths(rel).collect()] == ["viewfs://lake/x/data/orphan.parquet"]
    (tmp_path / "t/metadata/m1.avro").write_bytes(b"not a manifest")
    rel = relations_of(spark, [good])
    assert rel.data_files.count() == 0 and [r["path"] for r in rel.unreadable.collect()] == ["viewfs://lake/x/metadata/m1.avro"]
    (tmp_path / "t/metadata/m1.avro").unlink()
    rel = relations_of(spark, [good])
    assert "not found" in rel.unreadable.first()["error"]

    class Catalog:
        def document(self, table_id):
            return {"a.t": good, "a.bad": listless}[table_id]

        def list_tables(self, namespace=None):
            return ["a.t", "a.bad"]

    report = Tools(spark, Config(), Catalog(), NOW).check_catalog()
    assert report["errors"] == 1 and report["unreadable_files"] == 1
    assert {t["table_name"]: t["severity"] for t in report["tables"]}["a.bad"] == "ERROR"


def test_the_tools_over_lines(spark, warehouse):
    tools = Tools(spark, Config(catalog=Settings("filesystem", str(warehouse))), as_of=NOW)
    call = lambda i, name, **arguments: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    lines = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"}), "", "nonsense", call(2, "get_fix", table="db.small", finding="small_files"), call(3, "check_table", table="db.nothing"), call(4, "get_fix", table="db.small"), call(5, "no_tool"), json.dumps({"jsonrpc": "2.0", "id": 6, "method": "other"})]
    sink = io.StringIO()
    serve(tools, io.StringIO("\n".join(lines)), sink)
    got = {r["id"]: r for r in map(json.loads, sink.getvalue().splitlines())}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, None}
    listed = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert set(listed) == {"check_table", "check_catalog", "check_fleet", "get_fix", "dry_run_fix", "get_cost_report", "watch_status"}
    assert listed["check_table"]["required"] == ["table"] and listed["check_table"]["properties"]["checks"] == {"type": "array", "items": {"type": "string"}}
    assert "CALL catalog.system.rewrite_data_files" in got[2]["result"]["content"][0]["text"] and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == got[5]["error"]["code"] == -32602 and got[6]["error"]["code"] == -32601


def test_metadata_defaults(spark):
    v1 = {"format-version": 1, "location": "l", "schema": {"fields": [{"id": 1, "name": "a", "type": {"type": "list", "element": "int"}, "required": True}]}, "partition-spec": [{"source-id": 1, "name": "a", "transform": "identity"}], "properties": {metadata_json.TARGET_SIZE: "-5"}}
    df = spark.createDataFrame([("t", "t", json.dumps(v1), None)], "table_id string, table_name string, json string, metadata_size_bytes long")
    parsed = metadata_json.parse(df)
    t = metadata_json.tables(parsed).first()
    assert (t["partition_field_count"], t["sort_field_count"], t["declared_target_bytes"], t["metadata_size_bytes"]) == (1, 0, None, len(json.dumps(v1)))
    assert metadata_json.partition_fields(parsed).first()["field_id"] == 1001
    assert json.loads(metadata_json.schema_fields(parsed).first()["field_type"]) == {"type": "list", "element": "int"}
    assert metadata_json.refs(parsed).count() == metadata_json.snapshots(parsed).count() == 0
    with pytest.raises(Exception, match="not table metadata"):
        metadata_json.tables(metadata_json.parse(df.selectExpr("table_id", "table_name", "'{}' as json", "metadata_size_bytes"))).collect()


def test_rest_and_glue():
    asked = []

    def fetch(url, token=None):
        asked.append((url, token))
        if url.endswith("namespaces"):
            return json.dumps({"namespaces": [["a"], ["b", "c"], ["bad"]]}).encode()
        if "bad" in url:
            raise OSError("no")
        if url.endswith("tables"):
            space = ["b", "c"] if "%1F" in url else ["a"]
            return json.dumps({"identifiers": [{"namespace": space, "name": "t"}]}).encode()
        return json.dumps({"metadata": {"location": "x"}}).encode()

    c = RestCatalog("http://h/", "p", "secret", fetch)
    assert c.list_tables() == ["a.t", "b.c.t"]
    assert json.loads(c.document("b.c.t").text) == {"location": "x"}
    assert asked[-1] == ("http://h/v1/p/namespaces/b%1Fc/tables/t", "secret")
    with pytest.raises(ValueError):
        c.document("t")
    with pytest.raises(NotImplementedError):
        GlueCatalog()
    with pytest.raises(ValueError):
        from_config(Settings("other"))


def test_watch_and_cli(spark, warehouse, tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text(f'[catalog]\nkind = "filesystem"\nwarehouse = "{warehouse}"\n[watch]\nhistory = "{tmp_path}/h"\n')
    run = lambda *a: cli.main(["--config", str(path), *a], spark)
    assert run("list") == 0 and "db.small" in capsys.readouterr().out
    assert run("check", "db.small", "--checks", "small_files", "--format", "github") == 1
    assert "::error" in capsys.readouterr().out
    assert run("check", "db.none") == 2
    assert run("fix", "db.small", "freshness") == 1
    assert run("fix", "db.small", "small_files") == 0
    assert run("watch", "--interval", "1s", "--cycles", "2") == 0
    tools = Tools(spark, Config(catalog=Settings("filesystem", str(warehouse)), watch=Watch(history=f"{tmp_path}/h")), as_of=datetime.now(timezone.utc).replace(tzinfo=None))
    status = tools.watch_status("db.small")
    assert status["status"] == "has_data" and status["trends"][0]["trend"] == "stable" and len(status["alerts"]) == 1


def test_alert_stream(spark, tmp_path):
    from tablepulse.operators import watch
    from tablepulse.streaming.watching import Store, alert_stream

    rows = [("t", s, n, 0, 0, ids, None, datetime(2024, 1, 1, h)) for h, s, n, ids in [(0, "WARNING", 1, ["a"]), (1, "WARNING", 1, ["a", "b"]), (2, "PASS", 0, [])]]
    spark.createDataFrame(rows, watch.HISTORY).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/h")
    q = alert_stream(spark, spark.readStream.schema(watch.HISTORY).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert store.history.count() == 3
    assert [r["message"] for r in store.alerts.orderBy("alerted_at").collect()] == ["first run: 1 finding(s)", "new: b", "resolved: a, b; WARNING -> PASS"]
