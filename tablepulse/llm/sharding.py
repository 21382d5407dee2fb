"""Sharding by histogram sort.

Rows are put in the order of (hash of the text, doc_id); shards are runs of that order. Boundaries are found
by probing: each round counts, exactly and over all rows, the bytes and rows below candidate keys, and puts
new candidates only where a splitter is not yet within tolerance, between the least and the greatest key that
the round saw there. With the splitters known, every row's shard and place follow from the counts, and rows
are exchanged once.

A round sends one row per task and candidate; a third of all rows with one text is a run of one hash, which
later rounds split by doc_id, and a run of one text and one id is split by counting its rows. Probing goes on
until tasks of the exchange, too, are of a bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, ship, without

#: Candidates per open splitter and round.
PROBES = 64
#: Rows of one task of the exchange hold about so many bytes.
TASK_BYTES = 32 << 20
#: Candidates of the first round at most: a count of each comes to the driver.
MOST_PROBES = 1 << 16
_SIGN = 1 << 63


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _unsigned(x) -> np.ndarray:
    """Signed 64-bit numbers as unsigned ones of the same order."""
    return np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def bucket_of(high: np.ndarray, low: np.ndarray, probes: list[int]) -> np.ndarray:
    """For 128-bit keys in two halves: how many of the sorted probes are not above the key."""
    high, low = _unsigned(high), _unsigned(low)
    p_high = np.array([p >> 64 for p in probes], np.uint64)
    p_low = np.array([p & ((1 << 64) - 1) for p in probes], np.uint64)
    out = np.searchsorted(p_high, high, "left")
    upper = np.searchsorted(p_high, high, "right")
    tied = np.flatnonzero(upper > out)
    if len(tied):
        order = tied[np.argsort(out[tied], kind="stable")]
        cuts = np.flatnonzero(np.diff(out[order])) + 1
        for group in np.split(order, cuts):
            a, b = out[group[0]], upper[group[0]]
            out[group] += np.searchsorted(p_low[a:b], low[group], "right")
    return out


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, least key, greatest key) of each bucket that has rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least: dict[int, tuple[int, int]] = {}
        most: dict[int, tuple[int, int]] = {}
        for b in batches:
            high, low = b["high"].to_numpy(), b["low"].to_numpy()
            at = bucket_of(high, low, probes)
            np.add.at(size, at, b["size"].to_numpy())
            rows += np.bincount(at, minlength=n)
            order = np.lexsort((low, high, at))
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            last = np.append(first[1:] - 1, len(order) - 1)
            for i, j in zip(order[first], order[last]):
                k = int(at[i])
                x, y = (int(high[i]), int(low[i])), (int(high[j]), int(low[j]))
                least[k], most[k] = min(least.get(k, x), x), max(most.get(k, y), y)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(size[full]), pa.array(rows[full])] + [pa.array([side[k][i] for k in full.tolist()], pa.int64()) for side in (least, most) for i in (0, 1)],
            names=["bucket", "size", "n", "lh", "ll", "mh", "ml"],
        )

    parts = keys.mapInArrow(local, "bucket int, size long, n long, lh long, ll long, mh long, ml long")
    found = parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min(F.struct("lh", "ll")).alias("a"), F.max(F.struct("mh", "ml")).alias("z"))
    key = lambda h, low: ((h + _SIGN) << 64) | (low + _SIGN)
    return sorted((r["bucket"], r["size"], r["n"], key(*r["a"]), key(*r["z"])) for r in found.collect())  # a row per probe at most


class Order:
    """What rounds of counting have found out about the order of all keys."""

    def __init__(self, least: int, most: int, total: int, rows: int):
        #: Counted candidates: (bytes, rows) below each. The end of all keys counts as one.
        self.below: dict[int, tuple[int, int]] = {least: (0, 0), most + 1: (total, rows)}

    def add(self, keys: DataFrame, probes: list[int]) -> None:
        counts = {b: rest for b, *rest in _count(keys, probes)}
        size = rows = 0
        for b in range(len(probes) + 1):
            if b in counts:
                n_bytes, n, least, most = counts[b]
                if b:
                    self.below[probes[b - 1]] = (size, rows)
                # the run of keys that exist: between its ends and its neighbours there is nothing to find
                self.below.setdefault(least, (size, rows))
                size, rows = size + n_bytes, rows + n
                self.below.setdefault(most + 1, (size, rows))
            elif b:
                self.below[probes[b - 1]] = (size, rows)

    def sorted(self) -> list[tuple[int, int, int]]:
        return sorted((p, *n) for p, n in self.below.items())


def find_splitters(keys: DataFrame, shards: int, tolerance: float, task_bytes: int = TASK_BYTES) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Splitters of ``keys`` (high, low, size) as (key, rows of that key that go before), and all counted
    candidates as (key, bytes below, rows below). Between any two neighbours of those that keys or splitters lie
    between there are ``task_bytes`` at most, or a single key."""
    (_, total, n, least, most), *_ = _count(keys, []) or [(0, 0, 0, 0, 0)]
    if not total:
        return [], []
    order = Order(least, most, total, n)
    goal = [total * (i + 1) / shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    task_bytes = max(task_bytes, 2 * total // MOST_PROBES)
    while True:
        known = order.sorted()
        probes: set[int] = set()
        for (a, size, _), (b, after, _) in zip(known, known[1:]):
            if b - a <= 1 or after == size:  # a single key, or none
                continue
            seek = [g for g in goal if size < g < after and min(g - size, after - g) > slack]
            parts = max(PROBES if seek else 0, -(-2 * (after - size) // task_bytes) if after - size > task_bytes else 0)
            probes |= {a + (b - a) * (i + 1) // (parts + 1) for i in range(parts)} - {a}
        if not probes:
            break
        order.add(keys, sorted(probes))
    splitters = []
    for g in goal:
        p, size, rows = max(k for k in known if k[1] <= g)
        q, after, end = min(k for k in known if k[1] >= g)
        if g - size <= slack or after - g <= slack:
            splitters.append((p if g - size <= after - g else q, 0))
        else:  # inside of the run of one key
            k = round((g - size) / (after - size) * (end - rows))
            splitters.append((p, k) if k < end - rows else (q, 0))
    return splitters, known


def shard(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.002, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Each row of ``docs`` with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (its place there, from 0).

    Shards hold equal bytes (``size_of`` the text) but for ``tolerance`` of a shard and half a row. Null texts have
    size 1, null ids come first. Rows that agree in text and id have one key; where they are more than a task
    should hold, or a splitter lies among them, they are numbered as they were written to the shared folder, and
    parted by that. Shards may be empty where rows are few. An empty table gives an empty result. Input columns
    named like a result's are replaced.
    """
    ship(docs.sparkSession)
    base = without(docs, *(c for c in ("size", "shard", "slot") if c not in (text, doc_id)))
    high, low = F.xxhash64(F.col(text)), F.coalesce(F.col(doc_id).cast("long"), F.lit(-_SIGN))
    keys = base.select(high.alias("high"), low.alias("low"), size_of(F.col(text)).alias("size")).persist(StorageLevel.DISK_ONLY)
    try:
        splitters, known = find_splitters(keys, shards, tolerance, task_bytes)
    finally:
        keys.unpersist()
    if not known:
        return base.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    task_bytes = max(task_bytes, 2 * known[-1][1] // MOST_PROBES)
    rows_below = {p: n for p, _, n in known}
    #: Rows before each shard.
    begins = np.array([0, *(rows_below[p] + k for p, k in splitters)], np.int64)
    inside = {p for p, k in splitters if k}
    #: Single keys whose rows are parted, and how many rows they have.
    runs = {p: m - n for (p, a, n), (q, b, m) in zip(known, known[1:]) if q - p == 1 and (p in inside or b - a > task_bytes)}
    cuts, last = {p for p, _ in splitters}, 0
    for (p, size, _), (_, after, _) in zip(known, known[1:]):
        if after - last > task_bytes and size > last:
            cuts.add(p)
            last = size
    first = known[0][0]
    edges = sorted((cuts | set(runs)) - {first, known[-1][0]})
    tasks = [first, *edges]
    #: Of each task: rows before it, the key that is parted elsewhere (if any), and the shard and slot of its first row.
    start = np.array([rows_below[e] for e in tasks], np.int64)
    run_high, run_low = (np.array([half(e) if e in runs else 0 for e in tasks], np.int64) for half in (lambda e: (e >> 64) - _SIGN, lambda e: (e & ((1 << 64) - 1)) - _SIGN))
    has_run = np.array([e in runs for e in tasks])
    own_start = start + np.array([runs.get(e, 0) for e in tasks], np.int64)
    shard_at = np.searchsorted(begins[1:], own_start, "right")
    slot_at = own_start - begins[shard_at]

    @F.pandas_udf("task int, shard int, slot long, run boolean, start long")
    def place_of(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        high, low = high.to_numpy(), low.to_numpy()
        task = bucket_of(high, low, edges)
        run = has_run[task] & (high == run_high[task]) & (low == run_low[task])
        return pd.DataFrame({"task": task.astype(np.int32), "shard": shard_at[task].astype(np.int32), "slot": slot_at[task], "run": run, "start": start[task]})

    keyed = base.select("*", high.alias("__high"), low.alias("__low")).withColumn("__at", place_of("__high", "__low")).withColumn("size", size_of(F.col(text)))
    dealt = (keyed.where("not __at.run") if runs else keyed).withColumn("__task", F.col("__at.task")).repartitionById(len(tasks), F.col("__task"))
    row = F.row_number().over(Window.partitionBy("__task").orderBy("__high", "__low"))
    own = ("__high", "__low", "__at")
    out = dealt.withColumn("shard", F.col("__at.shard")).withColumn("slot", F.col("__at.slot") + row - 1).drop(*own, "__task")
    return out.unionByName(_parted(keyed.where("__at.run"), begins).drop(*own)) if runs else out


def _parted(rows: DataFrame, begins: np.ndarray) -> DataFrame:
    """``rows`` of single keys (``__at.start``: rows before the key) with shard and slot. The rows of a key are
    numbered by the task that wrote them to the shared folder and by their order there, so they go to no one task."""

    @F.pandas_udf("long")
    def nth(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: Counter = Counter()
        for start in batches:
            out = start.groupby(start).cumcount() + start.map(seen).fillna(0).astype(np.int64)
            seen.update(start.value_counts().to_dict())
            yield out.astype(np.int64)

    written = cut(rows.withColumn("__part", F.spark_partition_id()).withColumn("__start", F.col("__at.start")).withColumn("__k", nth(F.col("__at.start"))), "runs")
    parts = written.groupBy("__start", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__start").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    number = F.col("__start") + F.col("__before") + F.col("__k")
    array = F.array(*(F.lit(int(b)) for b in begins))
    shard_of = F.size(F.filter(array, lambda b: b <= F.col("__number"))) - 1
    out = written.join(parts, ["__start", "__part"]).withColumn("__number", number).withColumn("shard", shard_of)
    return out.withColumn("slot", F.col("__number") - F.element_at(array, F.col("shard") + 1)).drop("__start", "__part", "__k", "__before", "__number")
