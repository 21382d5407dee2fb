"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded once; per length only a count is kept, summed map-side, so what is shuffled grows with
the distinct lengths (their sum can't exceed all tokens), not with the documents. With the documents and
tokens of all longer texts, each limit L has its truncated total: tokens(length < L) + L * docs(length >= L).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut
from .bpe import default_path, encoder
from .words import pieces

#: Lengths in a block: sums over blocks and inside of blocks keep windows small.
BLOCK = 128


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) over all documents. Null and empty texts have length 0."""
    path = tokenizer or default_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = encoder(path).ids, Counter()
        for batch in pieces(batches, "text"):
            found.update(len(ids(t.as_py())) for t in batch["text"])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n_docs"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_ge and tokens_ge (of this length and more), truncated_total (tokens left when
    all texts are cut to this length), docs_le and the totals; an empty histogram gives an empty result.

    ``histogram`` is read twice: once by blocks of lengths, once inside of them.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row per block of lengths: few even of very long texts
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(blocks, "block").withColumn("docs_ge", F.col("d_after") + F.sum("n_docs").over(inside)).withColumn("tokens_ge", F.col("t_after") + F.sum("tokens").over(inside))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        (F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        "total_docs",
        "total_tokens",
    )


def with_limits(histogram: DataFrame, limits) -> DataFrame:
    """The histogram with a row for each limit, of no documents where no text has that length: its suffix sums
    then hold the answer for every limit in a row of its own."""
    asked = histogram.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    return histogram.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def _answered(shares: list[float]) -> Column:
    """Of a row of suffix sums: the shares whose rank lies among the documents of this length, so it is the least
    length that at least this share of all documents does not exceed."""

    def own(share: Column) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(share * F.col("total_docs")))
        return (rank <= F.col("docs_le")) & (rank > F.col("docs_le") - F.col("n_docs"))

    return F.filter(F.array(*map(F.lit, shares)), own)


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str | None = None, limits=(), shares=()) -> DataFrame:
    """``suffix_sums`` of the exact histogram of encoded lengths, in rows of three kinds.

    kind ``length``: each length that occurs; ``limit``: each of ``limits`` (n_docs may be 0); ``quantile``: the
    length of each of ``shares`` (null for the other kinds). Texts are encoded once: the histogram is written to
    the shared folder. All columns of ``docs`` but ``text`` are ignored; null and empty texts have length 0;
    repeated rows count as often as they occur; without rows there are the limits only, and all sums are 0.
    """
    histogram = cut(length_histogram(docs, text, tokenizer), "lengths")
    limits, shares = sorted({int(x) for x in limits}), sorted({float(x) for x in shares})
    sums = suffix_sums(with_limits(histogram, limits) if limits else histogram)
    kinds = F.array_compact(F.array(F.when(F.col("n_docs") > 0, F.lit("length")), F.when(F.col("n_tokens").isin(limits), F.lit("limit")) if limits else F.lit(None).cast("string")))
    row = lambda kind, share: F.struct(kind.alias("kind"), share.cast("double").alias("share"))
    rows = F.transform(kinds, lambda k: row(k, F.lit(None)))
    if shares:
        rows = F.concat(rows, F.transform(_answered(shares), lambda q: row(F.lit("quantile"), q)))
    return sums.withColumn("own", F.explode(rows)).select("own.*", *sums.columns)
