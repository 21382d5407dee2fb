"""The driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tablepulse.plans import queries as core

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_statements_are_valid_and_names_agree():
    import duckdb

    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(statements) <= set(queries)
    assert set(core.queries()) <= set(statements)
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    for name, sql in statements.items():
        try:
            c.execute(f"explain {sql}")
        except duckdb.Error as e:
            pytest.fail(f"{name}: {e}")


@needs_data
@pytest.mark.parametrize("name", ["small_files", "parse_metadata_json", "parse_snapshots", "all_latest", "schema_changes", "demo_source", "parse_manifest", "parse_delete_files", "parse_manifest_list", "alert_cooldown", "watch_cycle"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    got = core.queries()[name](spark, SF)
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    columns = sorted(got.columns)
    want = c.execute(f"select {', '.join(columns)} from ({core.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_core_works_without_the_operators_for_training_data(tmp_path):
    root = Path(entry.__file__).resolve().parent
    for p in ["__spark_entry__.py", *(str(f.relative_to(root)) for f in root.glob("tablepulse/**/*.py") if "llm" not in f.parts)]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text((root / p).read_text())
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'small_files' in e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
