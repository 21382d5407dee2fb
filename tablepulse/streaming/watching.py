"""The watch: check, compare with the last run, alert, store; as one batch cycle, or as a stream of runs."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Thresholds
from ..model import Relations
from ..operators import watch
from ..plans.engine import findings, overall

log = logging.getLogger(__name__)


class Store:
    """History and alerts as Parquet below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def history(self) -> DataFrame:
        return self._read("history", watch.HISTORY)

    @property
    def alerts(self) -> DataFrame:
        return self._read("alerts", watch.ALERTS)

    def add_history(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/history")

    def add_alerts(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/alerts")


def webhook(url: str, alert: dict, timeout: float = 10) -> None:
    """Posts one alert as text; failures are logged only."""
    text = f"{alert['table_name']}: {alert['previous_severity']} -> {alert['current_severity']}: {alert['message']}"
    body = json.dumps({"text": text, "attachments": [{k: v for k, v in alert.items() if k in ("new_findings", "resolved_findings")}]}, default=str).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            if r.status // 100 != 2:
                log.warning("the webhook answered %s", r.status)
    except OSError as e:
        log.warning("the webhook failed: %s", e)


def cycle(rel: Relations, store: Store, th: Thresholds, as_of: datetime, webhook_url: str | None = None, cooldown: int = watch.COOLDOWN_SECONDS) -> list[dict]:
    """One run over all tables: fired alerts are stored, posted and returned; the run itself is always stored."""
    found = findings(rel, th, as_of).persist()
    try:
        status = overall(found)
        now = watch.history_rows(status, found, as_of).persist()
        fired = watch.suppress(watch.detect_current(now, store.history), store.alerts, as_of, cooldown)
        alerts = [r.asDict(recursive=True) for r in fired.collect()]  # a row per table that has changed
        if alerts:
            store.add_alerts(store.spark.createDataFrame(alerts, watch.ALERTS))
        for a in alerts if webhook_url else []:
            webhook(webhook_url, a)
        store.add_history(now)
        now.unpersist()
    finally:
        found.unpersist()
    return alerts


def loop(load: Callable[[], Relations], store: Store, th: Thresholds, interval: str, webhook_url: str | None = None, cycles: int | None = None) -> None:
    """A cycle every ``interval``, less the time it took; errors of a cycle are logged and the loop goes on."""
    every, done = watch.parse_interval(interval), 0
    while cycles is None or done < cycles:
        began = time.monotonic()
        try:
            cycle(load(), store, th, datetime.now(timezone.utc).replace(tzinfo=None), webhook_url)
        except Exception:
            log.exception("a watch cycle failed")
        done += 1
        if cycles is None or done < cycles:
            time.sleep(max(0.0, every - (time.monotonic() - began)))


def alert_stream(spark: SparkSession, runs: DataFrame, store: Store, checkpoint: str, cooldown: int = watch.COOLDOWN_SECONDS, delay: str = "1 day") -> StreamingQuery:
    """Alerts of a stream of history rows (``watch.HISTORY``).

    Rows of each micro-batch are compared, in the order of time, with one another and with what is stored; the
    watermark drops runs that come too late to compare, and repeated rows.
    """
    late = runs.withWatermark("checked_at", delay).dropDuplicatesWithinWatermark(["table_name", "checked_at"])

    def handle(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        old = store.history.join(batch.select("table_name").distinct(), "table_name", "left_semi")
        last = watch.all_latest(old).dropDuplicates(["table_name"])
        changes = watch.detect_changes(last.unionByName(batch))
        first = batch.groupBy("table_name").agg(F.min("checked_at").alias("since"))
        changes = changes.join(first, "table_name").where(F.col("alerted_at") >= F.col("since")).drop("since")
        seen = store.alerts.join(batch.select("table_name").distinct(), "table_name", "left_semi")
        fired = watch.cooldown(seen.unionByName(changes), cooldown).join(seen.select("table_name", "message", "alerted_at"), ["table_name", "message", "alerted_at"], "left_anti")
        rows = fired.select(*seen.columns).persist()
        store.add_alerts(rows)
        store.add_history(batch)
        rows.unpersist()
        batch.unpersist()

    return late.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
