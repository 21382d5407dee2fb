"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder is set as the checkpoint folder of this application and
    used from then on, but only on one machine (a local master): machines of a cluster would each have its own.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tablepulse-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


#: Work tables that this process has written and not removed.
_written: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    _written.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def work_tables() -> frozenset[str]:
    """Work tables that this process has written so far and not removed."""
    return frozenset(_written)


def remove_others(df: DataFrame, since: frozenset[str]) -> None:
    """Deletes the work tables that were written after ``since`` was taken, but for those that ``df`` reads."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    _delete(df.sparkSession, {p for p in _written - since if p.rsplit("/", 1)[-1] not in own})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.difference_update({w for w in _written if w.rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1]})


#: Keys of more than one in so many rows are joined by broadcast; there can be no more of them than this.
HOT_KEYS = 4096


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``table``, which has one row per key and in ``weight`` how many of the ``total`` rows
    have that key. ``how``: inner (without ``weight``) or left_anti.

    Keys of more than a 4096th of all rows, of which there are fewer than 4096, are broadcast, so their rows stay
    where they are; all other keys are exchanged, and none of them holds many rows.
    """
    bound = F.lit(max(1, total // HOT_KEYS))
    small = F.broadcast(table.where(F.col(weight) > bound))
    rest = table.where(F.col(weight) <= bound).drop(weight)
    if how == "left_anti":
        return rows.join(small.select(*on), on, how).join(rest.select(*on), on, how)
    return rows.join(small.drop(weight), on).unionByName(rows.join(small.select(*on), on, "left_anti").join(rest, on))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less its columns of these names (in any case): an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df
