"""Preference formatting, with DataFrame functions only.

The turns of the chosen and of the rejected conversation of a pair are compared from the first on; the
longest common prefix is rendered once as the prompt, the rest of either as a completion, with the character
spans in which loss is taken (what the assistant says, and its end mark).

A pair becomes one row, so a task holds a conversation, never more; many pairs with the same first turn
are as many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: Column, trained: str) -> Column:
    """(begin, end) in characters of ``_rendered(turns)``, for each turn of the trained role."""
    kind = "struct<at:int,spans:array<struct<begin:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")).cast(kind)

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["role"]) + len(BEGIN) + 1
        end = begin + F.length(t["text"]) + len(END)
        own = F.when(t["role"] == trained, F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(a["spans"], own).alias("spans")).cast(kind)

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def _common(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal."""
    at = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    differs = F.filter(at, lambda i: F.coalesce(F.get(a, i) != F.get(b, i), F.lit(True)))
    return F.get(differs, F.lit(0))


def _turn(turn: Column, role: Column, text: Column) -> Column:
    return F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_pairs(sides: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per row of ``sides`` (pair_id, c, r): the turns of the chosen and of the rejected conversation
    as arrays of (role, text), in order, without nulls. Columns as of ``preference_pairs``."""
    sides = sides.select("pair_id", "c", "r").withColumn("n_common", _common(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    there = lambda c, x: F.when(F.size(c) > 0, x)
    return sides.select(
        "pair_id",
        "n_common",
        _rendered(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        there(F.col("c"), _rendered(rest(F.col("c")))).alias("chosen"),
        there(F.col("r"), _rendered(rest(F.col("r")))).alias("rejected"),
        there(F.col("c"), _spans(rest(F.col("c")), trained)).alias("chosen_spans"),
        there(F.col("r"), _spans(rest(F.col("r")), trained)).alias("rejected_spans"),
    )


def preference_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per ``pair_id`` from rows (pair_id, chosen boolean, turn, role, text).

    Columns: pair_id, n_common, prompt, chosen, rejected (the rendered rest of either), chosen_spans and
    rejected_spans (arrays of begin and end). Null roles and texts are empty ones. Turns are in the order of
    (turn, role, text), nulls first; repeated rows stay as repeated turns. A pair with one side only has no
    common turns and a null completion (and null spans) on the other. A row without pair_id is a pair of its
    own with that one turn, so such rows are never gathered; rows with a null ``chosen`` are left out. An empty
    table gives an empty result. Other input columns are ignored.
    """
    rows = turns.where(F.col("chosen").isNotNull()).select("pair_id", "chosen", _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    sides = rows.where("pair_id is not null").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("chosen"), F.col("t")))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("chosen"), F.col("t")))).alias("r"),
    )
    one = lambda own: F.filter(F.array("t"), lambda t: own)
    alone = rows.where("pair_id is null").select("pair_id", one(F.col("chosen")).alias("c"), one(~F.col("chosen")).alias("r"))
    both = sides.unionByName(alone)
    return format_pairs(both.select("pair_id", _said(F.col("c")).alias("c"), _said(F.col("r")).alias("r")), trained)


def swapped_replies(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Sides of one pair per conversation of ``turns`` (conv_id, turn, role, text), for ``format_pairs``.

    Chosen: the conversation. Rejected: its turns before the last one of the trained role (all, if it has none),
    and then the last such turn of the neighbour (conversations 2k and 2k + 1 are neighbours), if that has one.
    Turns are ordered as in ``preference_pairs``. A turn without conv_id is a conversation without neighbour.
    Neighbours are brought together by one exchange; no conversation meets any other.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    odd = F.pmod("conv_id", F.lit(2)) == 1
    twins = rows.where("conv_id is not null").groupBy(F.expr("conv_id - pmod(conv_id, 2)").alias("even")).agg(
        F.sort_array(F.collect_list(F.when(~odd, F.col("t")))).alias("a"), F.sort_array(F.collect_list(F.when(odd, F.col("t")))).alias("b")
    )
    alone = rows.where("conv_id is null").select(F.col("conv_id").alias("even"), F.array("t").alias("a"), F.filter(F.array("t"), lambda t: F.lit(False)).alias("b"))
    twins = twins.unionByName(alone).select("even", _said(F.col("a")).alias("a"), _said(F.col("b")).alias("b"))
    last = lambda c: F.array_max(F.filter(F.transform(c, lambda t, i: F.when(t["role"] == trained, i)), lambda i: i.isNotNull()))
    twins = twins.withColumns({"at_a": last(F.col("a")), "at_b": last(F.col("b"))})

    def pair(shift: int, own: str, other: str) -> Column:
        before = F.slice(own, F.lit(1), F.coalesce(F.col(f"at_{own}"), F.size(own)))
        reply = F.when(F.col(f"at_{other}").isNotNull(), F.array(F.get(F.col(other), F.col(f"at_{other}")))).otherwise(F.slice(other, F.lit(1), F.lit(0)))
        return F.struct((F.col("even") + shift).alias("pair_id"), F.col(own).alias("c"), F.concat(before, reply).alias("r"))

    pairs = twins.select(F.explode(F.array(pair(0, "a", "b"), pair(1, "b", "a"))).alias("p")).select("p.*")
    return pairs.where(F.size("c") > 0)
