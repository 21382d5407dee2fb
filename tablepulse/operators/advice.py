"""What a finding tells its reader: why it matters, what to do, the command for it, and what that saves.

Texts are columns over the wide frame, null where a check passes. A finding's own command differs from the one of
``fix`` in some checks: it keeps the last snapshot, sorts by z-order, or states a condition.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.expressions import quoted
from .fix import KEEP_ORPHAN_DAYS

#: Arguments of the public maintenance procedures.
_BINPACK = ", strategy => 'binpack'"
_SORT = ", strategy => 'sort'"
_ALL = ", options => map('rewrite-all', 'true')"


@dataclass(frozen=True)
class Advice:
    impact: str
    suggestion: str
    command: Column | None = None
    savings: Column | None = None

    def columns(self, rank: Column) -> dict[str, Column]:
        text = lambda c: F.when(rank > 0, c if isinstance(c, Column) else F.lit(c)).cast("string")
        return {"impact": text(self.impact), "fix_suggestion": text(self.suggestion), "fix_command": text(self.command), "estimated_savings": text(self.savings)}


def _call(procedure: str, *rest: Column | str) -> Column:
    parts = [r if isinstance(r, Column) else F.lit(r) for r in rest]
    return F.concat(F.lit(f"CALL catalog.system.{procedure}(table => '"), quoted(F.col("table_name")), F.lit("'"), *parts, F.lit(")"))


def _said(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def _older(as_of: datetime, days: int) -> str:
    return f", older_than => TIMESTAMP '{as_of - timedelta(days=days):%Y-%m-%d %H:%M:%S}'"


def advice(check_id: str, th: Thresholds, as_of: datetime, details: dict[str, Column]) -> Advice:
    """``details``: the numbers of the check."""
    d = details
    zorder = F.concat(F.lit(", strategy => 'sort', sort_order => 'zorder("), quoted(F.coalesce(F.array_join("partition_columns", ", "), F.lit(""))), F.lit(")'"))
    target = F.concat(F.lit(_BINPACK + ", options => map('target-file-size-bytes', '"), F.col("declared_target_bytes").cast("string"), F.lit("')"))
    return {
        "small_files": lambda: Advice(
            "Every small file costs a request and a task of its own, and planning time grows with their number.",
            "Compact small files by rewrite_data_files with the binpack strategy.",
            _call("rewrite_data_files", _BINPACK),
            _said("scans about %.0f%% faster, %d requests fewer for a full scan", d["saved_pct"].cast("double"), d["small_files"].cast("long")),
        ),
        "snapshot_bloat": lambda: Advice(
            "Metadata grows with each snapshot that is kept, and so do loading times and the data files that are held.",
            f"Expire snapshots older than {th.max_snapshot_age_days} days.",
            _call("expire_snapshots", _older(as_of, th.max_snapshot_age_days), ", retain_last => 1"),
            _said("about %.1f GB less metadata", d["waste_bytes"] / float(1 << 30)),
        ),
        "orphan_files": lambda: Advice(
            "Files that no snapshot refers to are paid for and never read. Files of writes still under way can look like them.",
            f"Remove orphan files older than {KEEP_ORPHAN_DAYS} days.",
            _call("remove_orphan_files", _older(as_of, KEEP_ORPHAN_DAYS)),
        ),
        "partition_skew": lambda: Advice(
            "The task that reads the largest partition decides how long a query takes.",
            "Choose a finer partition transform, or rewrite with a z-order that spreads rows.",
            _call("rewrite_data_files", zorder),
            _said("no stragglers on partition %s", F.coalesce("hot_partition", F.lit(""))),
        ),
        "delete_pressure": lambda: Advice(
            "Delete files are merged whenever the table is read; equality deletes are tried against every data file they may touch.",
            "Compact data files so that deletes are applied.",
            _call("rewrite_data_files", _BINPACK),
            _said("no merging of %d delete files (%.1f MB)", d["delete_files"].cast("long"), F.col("delete_bytes") / float(1 << 20)),
        ),
        "schema_history": lambda: Advice("Readers that rely on a dropped or retyped column break.", "Go through the breaking changes with those who read the table."),
        "metadata_size": lambda: Advice(
            "All metadata is read before a query can be planned.",
            "Expire old snapshots and rewrite manifests.",
            _call("rewrite_manifests"),
            _said("about %.0f MB less metadata", d["saved_mb"].cast("double")),
        ),
        "sort_order": lambda: Advice("Unsorted files can't be skipped.", "Rewrite with the sort strategy if data was written out of order."),
        "freshness": lambda: Advice("Whoever reads the table sees old data.", "Look into the pipeline that writes it."),
        "format_v1": lambda: Advice(
            "Version 1 has no row-level deletes.",
            "Set the table to format version 2.",
            F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" SET TBLPROPERTIES ('format-version' = '2')")),
            F.lit("makes row-level deletes, branches and tags usable"),
        ),
        "properties_drift": lambda: Advice(
            "Files are far from the size that the table declares, so writers do not follow it.",
            "Check what size writers are set to; if the property is meant, rewrite files towards it.",
            _call("rewrite_data_files", target),
        ),
        "partition_spec_evolution": lambda: Advice(
            "Files of retired specs are planned by other rules and pruned less.",
            "Rewrite files of retired partition specs, and avoid further changes.",
            _call("rewrite_data_files", ", where => 'true'", _ALL),
        ),
        "sort_compliance": lambda: Advice(
            "Files out of the declared order can't be skipped by its columns.",
            "Rewrite with the sort strategy.",
            _call("rewrite_data_files", _SORT),
            F.when(d["assessable"] > 0, F.lit("data skipping works again: fewer files a query")),
        ),
        "stats_coverage": lambda: Advice(
            "Files without column statistics are read even where none of their rows can match.",
            "Rewrite files with a writer that fills in statistics.",
            _call("rewrite_data_files", _BINPACK, _ALL),
            F.lit("file pruning works again: fewer files a query"),
        ),
        "branch_health": lambda: Advice(
            "Old refs keep snapshots, and with them data files, from expiring.",
            "Drop refs that no one needs, or give them a greatest age.",
            F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" DROP BRANCH `<name>`  -- for each stale ref")),
            F.lit("snapshots can expire again, which makes metadata smaller"),
        ),
    }[check_id]()
