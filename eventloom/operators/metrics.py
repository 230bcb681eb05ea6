"""Aggregates: quality metrics, histograms, health folds, inverted indexes, running sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.records import half_up


def quality_metrics(feedback: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row over the last ``days``: total, mean scores, consistency (within half a point) and satisfaction (4 or more) in percent; 0 when empty."""
    rows = feedback.where((F.col("created_at") >= as_of - F.expr(f"interval {days} days")) & (F.col("created_at") <= as_of))
    scored = F.col("human_score").isNotNull()
    percent = lambda cond: F.coalesce(half_up(100.0 * F.count_if(scored & cond) / F.nullif(F.count_if(scored), F.lit(0)), 1), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"),
        F.coalesce(half_up(F.avg(F.coalesce("agent_score", F.lit(0.0))), 2), F.lit(0.0)).alias("avg_agent"),
        F.coalesce(half_up(F.avg("human_score"), 2), F.lit(0.0)).alias("avg_human"),
        percent(F.abs(F.coalesce("agent_score", F.lit(0.0)) - F.col("human_score")) <= 0.5).alias("consistency"),
        percent(F.col("human_score") >= 4).alias("satisfaction"),
    )


def tag_histogram(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def empty_groups(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Wanted keys of which ``df`` has no row."""
    return wanted.join(df.select(key).distinct(), key, "left_anti")


def health(events: DataFrame, key: str, order: str, ok: Column, error: str) -> DataFrame:
    """(key, fail_count, last_error, last_ok): failures since the last success, the last error ever (cut to 300), the last state.

    A mergeable aggregate: the time of the last success first, then the failures after it; no window over a key.
    """
    rows = events.withColumn("_ok", ok)
    last = rows.groupBy(key).agg(
        F.max(F.when(F.col("_ok"), F.col(order))).alias("_t"), F.max_by(F.substring(error, 1, 300), F.when(~F.col("_ok"), F.col(order))).alias("last_error"), F.max_by("_ok", order).alias("last_ok")
    )
    fails = rows.where("not _ok").join(last.select(key, "_t"), key).where(F.col("_t").isNull() | (F.col(order) > F.col("_t"))).groupBy(key).agg(F.count("*").alias("fail_count"))
    return last.join(fails, key, "left").select(key, F.coalesce("fail_count", F.lit(0)).alias("fail_count"), "last_error", "last_ok")


def failure_runs(events: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """(key, run_no, n, first, last) of every unbroken run of failures (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("_ok", ok).withColumn("run_no", F.sum(F.col("_ok").cast("int")).over(w))
    return rows.where("not _ok").groupBy(key, "run_no").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def inverted_to_text(index: Column, limit: int | None = 600) -> Column:
    """The text of a map from words to positions, cut to ``limit`` characters (None: whole)."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    whole = F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")
    return whole if limit is None else F.substring(whole, 1, limit)


def text_to_inverted(text: Column) -> Column:
    """The map from words to positions of a text."""
    words = F.split(text, " ")
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("value"))))


def carry_section(lines: DataFrame, file: str, line_no: str, section: Column) -> DataFrame:
    """``lines`` with ``section``: the last heading at or before each line of its file. A file is one document, so its lines are bounded."""
    w = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(section, ignorenulls=True).over(w))
