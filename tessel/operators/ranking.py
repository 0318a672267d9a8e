"""Cutting a ranked list at its first score cliff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import written


@dataclass(frozen=True)
class Cliff:
    gap: float = 0.12
    least_ratio: float = 0.5
    most: int = 10
    image_floor: float = 0.38
    text_floor: float = 0.28

    def floor(self, mode: str) -> float:
        return self.image_floor if mode == "image" else self.text_floor


def _above_floor(rows: DataFrame, rule: Cliff, mode: str, score: Column, keys: list[str], ties: list[Column]) -> DataFrame:
    """Rows above the floor with their 0-based place, the next score and the position after which the list ends.

    Rows below it are ordered last and left out after the windows: a filter before them would be pushed down through the
    whole computation of the score and repeat it.
    """
    lists = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    counts = F.when((score > 0) & (score >= rule.floor(mode)), score)
    ordered = lists.orderBy(F.desc_nulls_last("_s"), *ties)
    ranked = rows.withColumn("_s", counts)
    ranked = ranked.withColumns({"_i": F.row_number().over(ordered) - 1, "_next": F.lead("_s").over(ordered), "_top": F.first("_s").over(ordered)})
    least = F.greatest(F.lit(rule.floor(mode)), F.col("_top") * rule.least_ratio)
    gap = (F.col("_s") - F.col("_next") >= rule.gap) & (F.col("_i") >= 1)
    low = (F.col("_next") < least) & (F.col("_i") >= 2)
    ranked = ranked.withColumns({"_gap": gap, "_stop": F.coalesce(gap | low, F.lit(False))})
    return ranked.withColumn("_end", F.min(F.when(F.col("_stop"), F.col("_i"))).over(lists)).where(F.col("_s").isNotNull())


def cut_at_cliff(rows: DataFrame, score_col: str, mode: str, rule: Cliff = Cliff(), keys: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """The head of each list (``keys`` tell lists apart) up to its first cliff, with a new 1-based ``rank``.

    A list ends after its second row or later if the next score falls by ``gap``, and after its third or later if the next
    one is below the floor or ``least_ratio`` of the best.  Rows at or below 0 and below the floor never count.
    """
    lists = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    first = rows.withColumn("_n", F.row_number().over(lists.orderBy(F.desc_nulls_last(score_col), *ties)))
    head = first.where(F.col("_n") <= rule.most + 1).drop("_n")  # tasks send their best ones alone, also of a long list
    marked = _above_floor(head, rule, mode, F.col(score_col), list(keys), list(map(F.col, ties)))
    kept = marked.where((F.coalesce(F.col("_end"), F.lit(1 << 30)) >= F.col("_i")) & (F.col("_i") < rule.most))
    return kept.withColumn("rank", F.col("_i") + 1).drop("_s", "_i", "_next", "_top", "_gap", "_stop", "_end")


def _above_floor_whole(rows: DataFrame, rule: Cliff, mode: str, score: Column, ties: list[Column]) -> DataFrame:
    """``_above_floor`` for one list of any length, without a task that sees it whole.

    Rows are dealt to ranges of the order and numbered within each; how many rows the ranges before have, and what the next range
    begins with, follows from one small row for each range.
    """
    valid = rows.withColumn("_s", F.when((score > 0) & (score >= rule.floor(mode)), score)).where(F.col("_s").isNotNull())
    ranged = written(valid.repartitionByRange(F.desc("_s"), *ties).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(F.desc("_s"), *ties)
    ranges = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.max("_s").alias("_first"))
    along = Window.orderBy("_range")  # a row for each range
    ranges = ranges.select("_range", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.lead("_first").over(along).alias("_after"), F.max("_first").over(Window.partitionBy()).alias("_top"))
    marked = ranged.withColumns({"_i": F.row_number().over(within) - 1, "_next": F.lead("_s").over(within)}).join(F.broadcast(ranges), "_range")
    marked = marked.withColumns({"_i": F.col("_i") + F.col("_before"), "_next": F.coalesce("_next", "_after")})
    least = F.greatest(F.lit(rule.floor(mode)), F.col("_top") * rule.least_ratio)
    gap = (F.col("_s") - F.col("_next") >= rule.gap) & (F.col("_i") >= 1)
    stop = F.coalesce(gap | ((F.col("_next") < least) & (F.col("_i") >= 2)), F.lit(False))
    marked = marked.withColumns({"_gap": gap, "_stop": stop})
    ends = marked.agg(F.min(F.when(F.col("_stop"), F.col("_i"))).alias("_end"))
    return marked.crossJoin(F.broadcast(ends))  # one row


def cliff_report(rows: DataFrame, score_col: str, mode: str, rule: Cliff = Cliff(), keys: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each list: candidates, kept and eliminated rows, and the gap if one ended the list.

    Without keys the rows are one list, which may be of any length; ``ties`` must then make its order total.
    """
    if keys:
        marked = _above_floor(rows, rule, mode, F.col(score_col), list(keys), list(map(F.col, ties)))
    else:
        marked = _above_floor_whole(rows, rule, mode, F.col(score_col), list(map(F.col, ties)))
    at_end = F.col("_i") == F.col("_end")
    found = marked.groupBy(*keys).agg(
        F.count("*").alias("valid"),
        F.min("_end").alias("end"),
        F.max("_top").alias("top_score"),
        F.max(F.when(at_end & F.coalesce("_gap", F.lit(False)), F.col("_i") + 1)).alias("gap_rank"),
        F.max(F.when(at_end & F.coalesce("_gap", F.lit(False)), F.round(F.col("_s") - F.col("_next"), 4))).alias("gap_size"),
    )
    total = rows.groupBy(*keys).agg(F.count("*").alias("total_candidates"))
    both = total.join(found, list(keys), "left") if keys else total.crossJoin(F.broadcast(found))
    valid = F.coalesce("valid", F.lit(0))
    kept = F.least(F.coalesce(F.col("end") + 1, valid), valid, F.lit(rule.most)).cast("long")
    reason = F.when(F.col("total_candidates") == 0, "empty_input").when(valid == 0, "all_below_quality_or_incompatible")
    return both.select(
        *keys,
        "total_candidates",
        kept.alias("kept_count"),
        (F.col("total_candidates") - kept).alias("eliminated_count"),
        F.col("gap_rank").isNotNull().alias("gap_detected"),
        F.col("gap_rank").cast("long").alias("gap_rank"),
        "gap_size",
        "top_score",
        reason.alias("reason"),
    )
