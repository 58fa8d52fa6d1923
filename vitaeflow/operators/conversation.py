"""The conversation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeflow.session import lookup_side


def append_turns(log: DataFrame, turns: DataFrame) -> DataFrame:
    """Put new turns after the last one of their conversation.

    ``turns`` has ``(conv_id, seq, role, text)``; ``seq`` orders the new turns
    of one conversation, counted from 0. Only the conversations in ``turns`` are looked at.
    """
    touched = log.join(lookup_side(turns.select("conv_id").distinct()), "conv_id", "left_semi")
    ends = touched.groupBy("conv_id").agg(F.max("turn").alias("_end"))
    placed = turns.join(lookup_side(ends), "conv_id", "left").withColumn(
        "turn", F.coalesce(F.col("_end") + 1, F.lit(0)) + F.col("seq")
    )
    return log.unionByName(placed.select(*log.columns))


def replay(log: DataFrame) -> DataFrame:
    """All turns in order. The sort splits by range on both columns, so one
    very long conversation spreads over several tasks."""
    return log.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


def clear(log: DataFrame, cleared: Column | None = None) -> DataFrame:
    """The log without the conversations that match; without all when none is named."""
    return log.where(F.lit(False)) if cleared is None else log.where(~F.coalesce(cleared, F.lit(False)))
