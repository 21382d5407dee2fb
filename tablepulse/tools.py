"""Tool functions: plain arguments in, JSON-ready dicts out. Errors come back as ``{"error": ...}``."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import cost, fix, fleet, watch
from .plans import engine
from .render import message
from .sources.catalog import Catalog, from_config
from .sources.reader import load
from .streaming.watching import Store


def _guarded(f: Callable[..., dict]) -> Callable[..., dict]:
    @functools.wraps(f)
    def run(*args, **kwargs) -> dict:
        try:
            return f(*args, **kwargs)
        except Exception as e:
            return {"error": str(e) or type(e).__name__}

    return run


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # reports: a row per table or finding


class Tools:
    def __init__(self, spark: SparkSession, config: Config | None = None, catalog: Catalog | None = None, as_of: datetime | None = None):
        self.spark, self.config = spark, config or Config()
        self.catalog = catalog or from_config(self.config.catalog)
        self._as_of = as_of

    @property
    def as_of(self) -> datetime:
        return self._as_of or datetime.now(timezone.utc).replace(tzinfo=None)

    def _one(self, table: str):
        rel, failed = load(self.spark, self.catalog, [table])
        if failed:
            raise LookupError(failed[table])
        return rel

    @_guarded
    def check_table(self, table: str, checks: list[str] | None = None) -> dict:
        rel = self._one(table)
        found = engine.findings(rel, self.config.thresholds, self.as_of, checks).persist()
        try:
            status, summary = _rows(engine.overall(found)), _rows(engine.summary(rel))
            rest = {"severity": "PASS", "pass_count": 0, "warning_count": 0, "critical_count": 0}
            return {"table_name": table, "summary": summary[0], "unreadable": _rows(rel.unreadable.drop("table_id")), "findings": [f | {"message": message(f)} for f in _rows(found.drop("table_id", "table_name"))], "overall": {k: v for k, v in (status[0] if status else rest).items() if k in rest}, "generated_at": self.as_of.isoformat()}
        finally:
            found.unpersist()

    @_guarded
    def check_catalog(self, namespace: str | None = None) -> dict:
        names = self.catalog.list_tables(namespace)
        rel, failed = load(self.spark, self.catalog, names)
        status = engine.statuses(rel, self.config.thresholds, self.as_of)
        bad = self.spark.createDataFrame([(t,) for t in failed], "table_name string")
        tables = _rows(fleet.catalog_summary(status, bad))
        count = lambda s: sum(t["severity"] == s for t in tables)
        unreadable = rel.unreadable.groupBy("table_id").count().collect()  # a row per table
        return {"total": len(names), "unreadable_files": sum(r["count"] for r in unreadable), "critical": count("CRITICAL"), "warning": count("WARNING"), "healthy": count("PASS"), "errors": count("ERROR"), "tables": tables}

    @_guarded
    def check_fleet(self, namespace: str | None = None, dormant_days: int = fleet.DORMANT_DAYS) -> dict:
        rel, failed = load(self.spark, self.catalog, self.catalog.list_tables(namespace))
        report = fleet.fleet_report(rel, self.config.thresholds, self.as_of, dormant_days, len(failed))
        return {k: v if isinstance(v, int) else _rows(v) for k, v in report.items()}

    def _fixes(self, table: str, finding: str, dry_run: bool) -> dict:
        rows = _rows(fix.generate_fixes(self._one(table), self.as_of, [finding], dry_run))
        if not rows:
            raise LookupError(f"no fix for finding {finding!r}")
        out = {k: v for k, v in rows[0].items() if k != "table_id" and not k.startswith("estimated_")}
        if dry_run:
            out.pop("command")
        return out | {"scope": {k: v for k, v in rows[0].items() if k.startswith("estimated_")}}

    @_guarded
    def get_fix(self, table: str, finding: str) -> dict:
        return self._fixes(table, finding, False)

    @_guarded
    def dry_run_fix(self, table: str, finding: str) -> dict:
        return self._fixes(table, finding, True)

    @_guarded
    def get_cost_report(self, table: str) -> dict:
        rel = self._one(table)
        total = _rows(cost.cost_report(rel, self.config.cost, self.as_of))[0]
        return {"table_name": table, "items": _rows(cost.cost_items(rel, self.config.cost, self.as_of).drop("table_id", "table_name")), "total_monthly_cost": total["total_monthly_cost"], "currency": total["currency"], "assumptions": total["assumptions"]}

    @_guarded
    def watch_status(self, table: str | None = None, days: int = 7, include_trend: bool | None = None) -> dict:
        store = Store(self.spark, self.config.watch.history)
        rows = watch.all_latest(store.history)
        if table:
            rows = rows.where(F.col("table_name") == table)
        latest = _rows(rows.drop("report").orderBy("table_name"))
        out = {"status": "has_data" if latest else "no_data", "latest": latest, "alerts": _rows(watch.recent_alerts(store.alerts, 10, table))}
        if include_trend if include_trend is not None else table is not None:
            trend = watch.trends(store.history, self.as_of, days)
            out["trends"] = _rows(trend.where(F.col("table_name") == table) if table else trend)
        return out
