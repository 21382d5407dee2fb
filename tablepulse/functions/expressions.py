"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNPARTITIONED = "<unpartitioned>"
SEVERITIES = ("PASS", "WARNING", "CRITICAL")


def partition_key(values: Column) -> Column:
    """A map of partition values as ``k=v/k=v`` in the order of keys; empty or null: not partitioned."""
    parts = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(values) > 0, F.array_join(parts, "/")).otherwise(F.lit(UNPARTITIONED))


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, and 0 of nothing."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def whole(unit: str, start: Column, end: Column) -> Column:
    """Elapsed whole days or hours."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / {"day": 86_400_000_000, "hour": 3_600_000_000}[unit])


def namespace(table_name: Column) -> Column:
    """What stands before the last dot."""
    return F.when(F.contains(table_name, F.lit(".")), F.regexp_extract(table_name, r"(?s)^(.*)\.", 1)).otherwise(F.lit("<root>"))


def quoted(text: Column) -> Column:
    """For use inside of a single-quoted SQL string."""
    return F.replace(text, F.lit("'"), F.lit("''"))
