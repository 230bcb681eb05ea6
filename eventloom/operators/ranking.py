"""Top-N, quotas, caps, candidate cuts, windows by day, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import day_diff, within_days


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` rows of each group with their rank. The filter on the rank lets each partition keep only its own first ``n``."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top_n_with_quota(df: DataFrame, keys: list[str], order: list[Column], n: int, special: Column, rank: str = "rank_no") -> DataFrame:
    """As ``top_n``, with exactly the best special row of a group, if it has one, in the first place and no other special row."""
    marked = df.withColumn("_sp", F.coalesce(special, F.lit(False)))
    own = Window.partitionBy(*keys, "_sp").orderBy(*order)
    # no group can give more than n rows of either kind, so each kind is cut before the two are ranked together
    marked = marked.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).where(~F.col("_sp") | (F.col("_r") == 1))
    return top_n(marked, keys, [F.col("_sp").desc(), *order], n, rank).drop("_sp", "_r")


def cap_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key in arrival order; rows with a null or blank key all stay."""
    blank = F.coalesce(F.trim(key), F.lit("")) == ""
    capped = top_n(df.where(~blank), [key], order, n, "_r").drop("_r")
    return capped.unionByName(df.where(blank))


def candidate_cut(df: DataFrame, order: list[Column], n: int, least: int = 6) -> DataFrame:
    """The ``max(2n, least)`` best rows overall, which go to the expensive stage (a distributed top-k, no global sort)."""
    return df.orderBy(*order).limit(max(2 * n, least))


def in_window(df: DataFrame, report_date: Column, time: str, category: str, days: dict[str, int], other: int = 1) -> DataFrame:
    """Rows whose day lies in the window of their category; rows without date are out."""
    keep = F.lit(False)
    known = F.lit(False)
    for name, n in days.items():
        keep = keep | ((F.col(category) == name) & within_days(report_date, F.col(time), n))
        known = known | (F.col(category) == name)
    return df.where(keep | (~known & within_days(report_date, F.col(time), other)))


def expand_low_volume(df: DataFrame, report_date: Column, time: str, short: int = 3, long: int = 5, least: int = 2) -> DataFrame:
    """Rows of the short window if it has ``least``, else of the long one. The count is one aggregate row, joined back."""
    diff = day_diff(report_date, F.col(time))
    rows = df.withColumn("_d", diff).where(F.col("_d").between(0, long - 1))
    count = rows.agg(F.count_if(F.col("_d") < short).alias("_n"))
    return rows.crossJoin(F.broadcast(count)).where((F.col("_n") < least) | (F.col("_d") < short)).drop("_d", "_n")


def influence(institution: Column, hint: Column, known: list[str]) -> Column:
    """Rank of a paper: 2 for a known institution, 2 for a venue or state of the art, 1 for many citations, less 1 for low influence."""
    h = F.coalesce(hint, F.lit(""))
    return (
        F.when(F.exists(F.array(*[F.lit(k.lower()) for k in known]), lambda k: F.contains(F.lower(F.coalesce(institution, F.lit(""))), k)), 2).otherwise(0)
        + F.when(h.rlike("(?i)顶会|sota|热议"), 2).otherwise(0)
        + F.when(F.contains(h, F.lit("高引用")), 1).otherwise(0)
        - F.when(F.contains(h, F.lit("low_influence")), 1).otherwise(0)
    )


def page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """One page of a sorted listing; numbers below the first page mean the first."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
