"""What earlier reports covered: anti-joins with look-back, keep-best, expiry, first-seen snapshots and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days back in which a reported key counts, by category.
LOOKBACK_DAYS = {"paper": 7, "enterprise": 5, "opensource": 1}
OTHER_DAYS, MEMORY_DAYS, SNAPSHOT_DAYS, GROWTH_MIN_DAYS = 3, 14, 8, 5


def lookback(category: Column) -> Column:
    out = F.lit(OTHER_DAYS)
    for name, days in LOOKBACK_DAYS.items():
        out = F.when(category == name, F.lit(days)).otherwise(out)
    return out


def already_reported(candidates: DataFrame, memory: DataFrame, report_date: Column, include_same_day: bool = True) -> DataFrame:
    """``candidates`` (category, key, …) with ``reported``: whether ``memory`` (report_date, category, key) has the key within
    the category's look-back. An empty key is never reported."""
    age = F.datediff(report_date.cast("date"), F.col("report_date").cast("date"))
    recent = memory.where((age >= (0 if include_same_day else 1)) & (age <= lookback(F.col("category")))).select("category", "key").distinct()
    return candidates.join(recent.withColumn("_hit", F.lit(True)), ["category", "key"], "left").withColumn("reported", F.coalesce("_hit", F.lit(False)) & (F.col("key") != "")).drop("_hit")


def unreported(candidates: DataFrame, memory: DataFrame, report_date: Column, **options: bool) -> DataFrame:
    """The candidates that no report within look-back has."""
    return already_reported(candidates, memory, report_date, **options).where("not reported").drop("reported")


def unreported_or_best(candidates: DataFrame, memory: DataFrame, report_date: Column, order: list[Column]) -> DataFrame:
    """As ``unreported``, but of a category that would be emptied its first candidate in ``order`` stays."""
    marked = already_reported(candidates, memory, report_date)
    left = marked.groupBy("category").agg(F.count_if(~F.col("reported")).alias("_left")).where("_left = 0").select("category")
    kept = marked.where("not reported")
    first = Window.partitionBy("category").orderBy(*order)
    best = marked.join(F.broadcast(left), "category", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return kept.unionByName(best).drop("reported")


def remember(memory: DataFrame, date: str, picks: DataFrame, days: int = MEMORY_DAYS) -> DataFrame:
    """``memory`` with the day's picks (category, key) in place of an earlier run's, if there are any, and without what is
    older than ``days``."""
    today = picks.where("key <> ''").select(F.lit(date).alias("report_date"), "category", "key").distinct()
    some = today.select(F.lit(date).alias("report_date")).distinct()
    older = memory.join(F.broadcast(some), "report_date", "left_anti")
    fresh = F.datediff(F.lit(date).cast("date"), F.col("report_date").cast("date")) <= days
    return older.where(fresh).select("report_date", "category", "key").unionByName(today)


def first_seen(old: DataFrame, new: DataFrame, as_of: Column, days: int = SNAPSHOT_DAYS) -> DataFrame:
    """The earliest snapshot (repo, stars, at) of each repository, without those older than ``days``."""
    both = old.select("repo", "stars", "at").unionByName(new.select("repo", "stars", "at"))
    kept = both.groupBy("repo").agg(F.min_by("stars", "at").alias("stars"), F.min("at").alias("at"))
    return kept.where(F.col("at") >= as_of - F.expr(f"interval {days} days"))


def growth(current: DataFrame, snapshots: DataFrame, as_of: Column, min_days: int = GROWTH_MIN_DAYS) -> DataFrame:
    """``current`` (repo, stars) with ``growth``: stars won since a snapshot at least ``min_days`` old, else null."""
    past = snapshots.where(F.col("at") <= as_of - F.expr(f"interval {min_days} days")).select("repo", F.col("stars").alias("_past"))
    return current.join(past, "repo", "left").withColumn("growth", F.when(F.col("_past").isNotNull(), F.greatest(F.lit(0), F.col("stars") - F.col("_past")))).drop("_past")
