"""Watch analytics over the check history: latest, trends, change detection and alert cooldown.

History rows: table_name, severity, finding_count, critical_count, warning_count, finding_ids (those not
passing), checked_at. Windows are per table; a table's history is one row per check run.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY = "table_name string, severity string, finding_count long, critical_count long, warning_count long, finding_ids array<string>, report string, checked_at timestamp"
ALERTS = "table_name string, previous_severity string, current_severity string, message string, new_findings array<string>, resolved_findings array<string>, alerted_at timestamp"
COOLDOWN_SECONDS = 3600
FLAPPING, MOVED = 3, 0.5


def parse_interval(text: str) -> int:
    """Seconds of ``30s``, ``15m``, ``6h`` or ``1d``."""
    number, unit = text.strip()[:-1], text.strip()[-1:]
    if not (number.isascii() and number.isdigit()) or unit not in "smhd" or not unit:
        raise ValueError(f"not an interval: {text!r}")
    return int(number) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[unit]


#: The order of a table's rows: by time, and rows of one time by what they say.
_ORDER = ("checked_at", "severity", "finding_count", "finding_ids")


def latest_report(history: DataFrame, table_name: str) -> DataFrame:
    return recent(history, table_name, 1)


def recent(history: DataFrame, table_name: str, n: int) -> DataFrame:
    """The last ``n`` rows of one table, newest first."""
    return history.where(F.col("table_name") == table_name).orderBy(*map(F.desc, _ORDER)).limit(n)


def recent_alerts(alerts: DataFrame, n: int, table_name: str | None = None) -> DataFrame:
    if table_name is not None:
        alerts = alerts.where(F.col("table_name") == table_name)
    return alerts.orderBy(F.desc("alerted_at"), "table_name", "message").limit(n)


def all_latest(history: DataFrame) -> DataFrame:
    """The latest rows of each table (several, if several have its latest time). The maximum is aggregated
    map-side and joined back, so no history is sorted."""
    last = history.groupBy("table_name").agg(F.max("checked_at").alias("checked_at"))
    return history.join(last, ["table_name", "checked_at"]).select(*history.columns)


def trends(history: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """How each table has moved in the last ``days``; tables without rows then are ``no_data``.

    Findings of the older half (the first half of the rows, rounded down) and of the newer are averaged.
    """
    names = history.select("table_name").distinct()
    order = Window.partitionBy("table_name").orderBy(*_ORDER)
    rows = history.where(F.col("checked_at") >= F.lit(as_of - timedelta(days=days)))
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("table_name")))
    rows = rows.withColumn("moved", F.col("severity") != F.lag("severity").over(order)).withColumn("half", F.floor(F.col("n") / 2))
    found = rows.groupBy("table_name").agg(
        F.max("n").alias("checks"),
        F.count(F.when(F.col("moved"), 1)).alias("transitions"),
        F.avg("finding_count").alias("avg_findings"),
        F.avg(F.when(F.col("i") <= F.col("half"), F.col("finding_count"))).alias("older"),
        F.avg(F.when(F.col("i") > F.col("half"), F.col("finding_count"))).alias("newer"),
        F.min_by("severity", "i").alias("first_severity"),
        F.max_by("severity", "i").alias("last_severity"),
        F.min_by("finding_count", "i").alias("first_findings"),
        F.max_by("finding_count", "i").alias("last_findings"),
    )
    out = names.join(found, "table_name", "left").withColumn("checks", F.coalesce("checks", F.lit(0))).withColumn("transitions", F.coalesce("transitions", F.lit(0)))
    older, newer = F.coalesce("older", "avg_findings"), F.col("newer")
    kind = F.when(F.col("checks") == 0, "no_data").when(F.col("transitions") >= FLAPPING, "flapping").when(newer > older + MOVED, "degrading").when(older > newer + MOVED, "improving").otherwise("stable")
    return out.withColumn("trend", kind).drop("older", "newer")


def _changes(previous: Column, before: Column, now: Column) -> tuple[Column, Column]:
    new = F.sort_array(F.array_except(now, before))
    gone = F.sort_array(F.array_except(before, now))
    return new, gone


def compare(rows: DataFrame) -> DataFrame:
    """Alerts from rows that have previous_severity and previous_ids beside the row's own (null: no previous).

    New and resolved findings and a changed severity are reported; a first row only if it does not pass, and then by
    the number of its findings, so that the cooldown's key does not depend on which they are.
    """
    known = F.col("previous_severity").isNotNull()
    new, gone = _changes(known, F.coalesce("previous_ids", F.array().cast("array<string>")), F.col("finding_ids"))
    rows = rows.withColumn("new_findings", new).withColumn("resolved_findings", gone)
    moved = known & (F.col("previous_severity") != F.col("severity"))
    fires = F.when(known, (F.size("new_findings") > 0) | (F.size("resolved_findings") > 0) | moved).otherwise(F.col("severity") != "PASS")
    part = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    before = F.coalesce("previous_severity", F.lit("unknown"))
    first = F.format_string("first run: %d finding(s)", F.size("finding_ids"))
    message = F.when(~known, first).otherwise(F.concat_ws("; ", part("new_findings", "new: "), part("resolved_findings", "resolved: "), F.when(before != F.col("severity"), F.concat(before, F.lit(" -> "), "severity"))))
    return rows.where(fires).select("table_name", before.alias("previous_severity"), F.col("severity").alias("current_severity"), message.alias("message"), "new_findings", "resolved_findings", F.col("checked_at").alias("alerted_at"))


def detect_changes(history: DataFrame) -> DataFrame:
    """An alert for each row of the history that differs from its table's row before."""
    order = Window.partitionBy("table_name").orderBy(*_ORDER)
    rows = history.withColumn("previous_severity", F.lag("severity").over(order)).withColumn("previous_ids", F.lag("finding_ids").over(order))
    return compare(rows)


def detect_current(current: DataFrame, history: DataFrame) -> DataFrame:
    """Alerts of a new run (``current``) against the latest stored row of each table."""
    last = history.groupBy("table_name").agg(F.max_by(F.struct(F.col("severity").alias("previous_severity"), F.col("finding_ids").alias("previous_ids")), F.struct(*_ORDER)).alias("l")).select("table_name", "l.*")
    return compare(current.join(last, "table_name", "left"))


def cooldown(alerts: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alerts without those whose (table, message) fired ``seconds`` ago or less.

    What is suppressed does not start the time anew, so this is a fold in the order of time. Rows are sorted by
    key on disk and streamed; one row of state is held, however long a key's history is.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = fired = None
        for b in batches:
            keep = []
            for k, at in zip(zip(b["table_name"], b["message"]), b["alerted_at"]):
                fire = k != key or (at - fired).total_seconds() > seconds
                if fire:
                    key, fired = k, at
                keep.append(fire)
            yield b[keep]

    ordered = alerts.repartition("table_name", "message").sortWithinPartitions("table_name", "message", "alerted_at")
    return ordered.mapInPandas(fold, alerts.schema)


def suppress(alerts: DataFrame, stored: DataFrame, as_of: datetime, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """``alerts`` of one run without those stored with the same message ``seconds`` ago or less."""
    hot = stored.where(F.col("alerted_at") >= F.lit(as_of - timedelta(seconds=seconds))).select("table_name", "message").distinct()
    return alerts.join(hot, ["table_name", "message"], "left_anti").select(*alerts.columns)


def history_rows(status: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """What a run stores, from ``statuses`` and ``findings``."""
    bad = found.where("severity_rank > 0").groupBy("table_id").agg(F.sort_array(F.collect_list("check_id")).alias("finding_ids"))
    reports = found.groupBy("table_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("check_id", "severity", "details")))).alias("report"))
    rows = status.join(bad, "table_id", "left").join(reports, "table_id", "left")
    return rows.select("table_name", "severity", (F.col("warning_count") + F.col("critical_count")).alias("finding_count"), "critical_count", "warning_count", F.coalesce("finding_ids", F.array().cast("array<string>")).alias("finding_ids"), "report", F.lit(as_of).alias("checked_at"))
