"""Selection under budgets: prefix, skip and next-fit batches (folds), tail trimming, largest remainder, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fitting, next_fit

__all__ = ["evict", "fitting", "largest_remainder", "next_fit", "prefix", "round_robin", "skip", "trim_tail"]


def prefix(rows: DataFrame, by: list[str], order: list, cost: str, limit: Column) -> DataFrame:
    """Of each group, in order, the rows before the first that doesn't fit: all whose running cost stays within."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(upto)).withColumn("selected", F.col("used") <= limit)


def skip(rows: DataFrame, by: str, order: str, cost: str, limit: int, most: int | None = None) -> DataFrame:
    """Of each group, in order, every row that still fits, passing over those that don't, `most` rows at most: the group,
    taken (array<long>, in order) and used. For packs; `folds.fitting` gives rows, for groups of any size."""
    chosen = fitting(rows, by, order, cost, limit, most).withColumn("__taken", F.when(F.col("selected"), F.col(order).cast("long")))
    return chosen.groupBy(by).agg(F.array_sort(F.collect_list("__taken")).alias("taken"), F.coalesce(F.sum(F.when(F.col("selected"), F.col(cost))), F.lit(0)).cast("long").alias("used"))


def trim_tail(rows: DataFrame, by: list[str], order: list, cost: str, limit: int, least: int = 1) -> DataFrame:
    """Of each group, in order, the longest prefix within the limit, but `least` rows at any rate."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"used": F.sum(cost).over(upto), "__n": F.row_number().over(Window.partitionBy(*by).orderBy(*order))}).where((F.col("used") <= limit) | (F.col("__n") <= least)).drop("__n")


def largest_remainder(rows: DataFrame, by: list[str], order: str, weight: str, total: Column) -> DataFrame:
    """Whole shares of a total by weight (at least 0.01 each): floors first, what is left to the largest fractions."""
    group = Window.partitionBy(*by)
    own = F.greatest(F.lit(0.01), F.col(weight))
    raw = total * own / F.sum(own).over(group)
    out = rows.withColumn("raw_share", raw).withColumn("base_share", F.floor("raw_share"))
    nth = F.row_number().over(group.orderBy(F.desc(F.round(F.col("raw_share") - F.col("base_share"), 9)), order))
    return out.withColumn("allocated", F.col("base_share") + F.when(nth <= total - F.sum("base_share").over(group), 1).otherwise(0)).drop("raw_share", "base_share")


def evict(items: DataFrame, session: str, limit: int) -> DataFrame:
    """Hot items of a session with those to demote, least recently and rarely used first, until the rest fits."""
    total = F.sum("estimated_tokens").over(Window.partitionBy(session))
    before = F.coalesce(F.sum("estimated_tokens").over(Window.partitionBy(session).orderBy("last_accessed", "access_count", "item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("demoted", total - before > limit)


def round_robin(rows: DataFrame, queue: str, order: list, item: str) -> DataFrame:
    """Items of several queues in turn: all firsts in the order of the queues, then all seconds; each item once."""
    nth = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    first = rows.withColumn("__n", nth).groupBy(item).agg(F.min(F.struct(F.col("__n").alias("position"), F.col(queue).alias("queue"))).alias("turn"))
    return first.select(item, "turn.position", "turn.queue")
