"""The corpus pipeline: quality rules, near-duplicate removal, decontamination and packing of ``documents``.

Every stage works on all rows that the one before it kept, and returns the columns of ``documents``; the last
returns packed pieces. ``run`` writes each stage's result to the shared folder and reads it again, so a lost
executor costs a stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm._common import cut, remove_others, table, work_tables
from tablepulse.llm.decontaminate import decontaminate
from tablepulse.llm.jaccard import keep_one
from tablepulse.llm.packing import pack_documents
from tablepulse.llm.quality import quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged, also in columns named like the rules' counts. Null and empty
    texts fail; repeated rows and null ids are judged each for itself; an empty table gives an empty result."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), text)
    return quality(rows).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group that links of 0.75 and more join. Texts without words are in
    no group and stay; ids before nulls; repeated rows are a group; an empty table gives an empty result."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, unchanged, in which no ten words in a row (or whole shorter item) of ``benchmark`` stand. Null texts
    and ids stay; an empty benchmark takes nothing away; an empty table gives an empty result."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Null texts are an end alone, null ids stay null, repeated rows
    are packed each for itself; an empty table gives no pieces."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Subword ids are beyond SQL; tests/llm holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), work_tables()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        remove_others(docs, before)  # the stage's own work tables, and what the stage before left
    return docs
