"""Typed configuration, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

MIB = 1 << 20
GIB = 1 << 30


@dataclass(frozen=True)
class Thresholds:
    # fixed values: the defaults that results are compared under
    small_file_bytes: int = 8 * MIB
    max_snapshots: int = 100
    max_snapshot_age_days: int = 7
    partition_skew_ratio: float = 10.0
    max_delete_files: int = 50
    stale_table_hours: int = 48
    max_metadata_bytes: int = 500 * MIB
    max_partition_specs: int = 3
    min_sort_compliance_pct: float = 80.0
    min_stats_coverage_pct: float = 50.0
    stale_branch_days: int = 30
    target_file_size_drift_pct: float = 0.5


@dataclass(frozen=True)
class CostAssumptions:
    # fixed values
    storage_per_gb_month: float = 0.023
    get_per_1000: float = 0.0004
    region: str = "us-east-1"
    queries_per_day: int = 100
    compute_per_cpu_hour: float = 0.05
    avg_bytes_scanned: int = GIB


@dataclass(frozen=True)
class Watch:
    interval: str = "6h"
    webhook_url: str | None = None
    history: str = "./tablepulse-history"
    namespace: str | None = None


@dataclass(frozen=True)
class Catalog:
    """``kind`` is filesystem, rest or glue; the other fields are of that kind."""

    kind: str = "filesystem"
    warehouse: str | None = None
    uri: str | None = None
    prefix: str | None = None
    token: str | None = None
    region: str | None = None


@dataclass(frozen=True)
class Config:
    catalog: Catalog = field(default_factory=Catalog)
    thresholds: Thresholds = field(default_factory=Thresholds)
    cost: CostAssumptions = field(default_factory=CostAssumptions)
    watch: Watch = field(default_factory=Watch)


def parse(text: str) -> Config:
    """Sections catalog, thresholds, cost and watch; what is left out has its default."""
    given = tomllib.loads(text)
    parts = {"catalog": Catalog, "thresholds": Thresholds, "cost": CostAssumptions, "watch": Watch}
    out = {}
    for name, kind in parts.items():
        known = {f.name for f in fields(kind)}
        section = given.get(name, {})
        if unknown := set(section) - known:
            raise ValueError(f"[{name}] has no setting {', '.join(sorted(unknown))}")
        out[name] = kind(**section)
    if out["catalog"].kind not in ("filesystem", "rest", "glue"):
        raise ValueError(f"unknown catalog kind: {out['catalog'].kind}")
    return Config(**out)


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text())
