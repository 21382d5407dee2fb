"""What table debt costs a month: up to five items per table."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GIB, MIB, CostAssumptions, Thresholds
from ..model import Relations
from .aggregates import wide

# fixed values
FREE_SNAPSHOTS = 100
ORPHAN_BYTES = 128 * MIB
SCAN_BYTES_PER_SECOND = 100 * MIB
CURRENCY = "USD"


def _items(cost: CostAssumptions) -> list[tuple[str, Column, Column, Column]]:
    """(category, whether it exists, quantity, price) in the order they are added up."""
    c = F.col
    monthly = float(cost.queries_per_day * 30)
    orphans = F.greatest(c("stored") - (c("files") + c("deletes")), F.lit(0))
    average = F.when(c("files") > 0, F.floor(F.try_divide(c("bytes"), c("files")))).otherwise(ORPHAN_BYTES)
    size = F.coalesce("metadata_size_bytes", F.lit(0))
    overhead = F.least(F.lit(1.0), F.lit(0.001) * c("position_deletes") + F.lit(0.005) * c("equality_deletes"))
    cpu = cost.avg_bytes_scanned / SCAN_BYTES_PER_SECOND
    gets = lambda n: n * monthly / 1000.0 * cost.get_per_1000
    return [
        ("orphan_storage", orphans > 0, orphans, orphans * average / float(GIB) * cost.storage_per_gb_month),
        ("snapshot_metadata", (c("snapshots") > FREE_SNAPSHOTS) & (size > 0), c("snapshots"), F.try_divide(size * (c("snapshots") - FREE_SNAPSHOTS), c("snapshots")) / float(GIB) * cost.storage_per_gb_month),
        ("small_file_gets", c("fix_small") > 0, c("fix_small"), gets(c("fix_small"))),
        ("manifest_gets", c("manifests") > 0, c("manifests"), gets(c("manifests"))),
        ("delete_merge", c("deletes") > 0, c("deletes"), cpu * overhead * monthly / 3600.0 * cost.compute_per_cpu_hour),
    ]


def _frame(rel: Relations, cost: CostAssumptions, as_of: datetime) -> DataFrame:
    frame = wide(rel, Thresholds(), as_of, ("files", "deletes", "snapshots", "storage", "manifests"))
    rows = (F.when(there, F.struct(F.lit(name).alias("category"), n.cast("long").alias("quantity"), price.cast("double").alias("monthly_cost"))) for name, there, n, price in _items(cost))
    return frame.select("table_id", "table_name", F.array_compact(F.array(*rows)).alias("items"))


def cost_items(rel: Relations, cost: CostAssumptions, as_of: datetime) -> DataFrame:
    """(table_id, table_name, category, quantity, monthly_cost); an item exists only where there is something to pay."""
    return _frame(rel, cost, as_of).select("table_id", "table_name", F.explode("items").alias("i")).select("table_id", "table_name", "i.*")


def cost_report(rel: Relations, cost: CostAssumptions, as_of: datetime) -> DataFrame:
    """Each table's total, also where it has no item, with the assumptions it rests on."""
    total = F.aggregate("items", F.lit(0.0), lambda a, i: a + i["monthly_cost"])
    echoed = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in asdict(cost).items())))
    return _frame(rel, cost, as_of).select("table_id", "table_name", F.size("items").cast("long").alias("items"), total.alias("total_monthly_cost"), F.lit(CURRENCY).alias("currency"), echoed.alias("assumptions"))
