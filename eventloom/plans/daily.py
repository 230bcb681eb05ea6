"""The daily dataflow as one lazy plan: window, merge, score, memory, anti-join with keep-best, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.records import accuracy, half_up, importance, passes_rules, scored_sources
from eventloom.functions.dates import flexible_date, source_has_date
from eventloom.functions.text import dedup_key, strip
from eventloom.operators import clusters, lookups, memory, merge, ranking
from eventloom.session import cut_lineage

#: Days of the display window, by category.
WINDOW_DAYS = {"paper": 7, "enterprise": 5, "opensource": 1}
#: Likeness from which two titles of a run are one story; titles of repositories are made by rule and are not compared.
LIKE, LIKE_PAPER = 0.55, 0.72


def daily_candidates(events: DataFrame, day: Column, days: int = 7) -> DataFrame:
    """(category, user_id, key, score, n_events, day) of each key with rows in the window that ends at ``day``."""
    age = F.datediff(day, F.col("ts").cast("date"))
    rows = events.where(age.between(0, days - 1)).groupBy(F.col("event_type").alias("category"), "user_id").agg(F.count("*").alias("n_events"), F.max("value").alias("best"))
    score = half_up(F.least(F.lit(5.0), F.col("best") / 100.0) * 0.6 + F.least(F.lit(1.0), F.col("n_events") * 0.3))
    return rows.select("category", "user_id", F.concat_ws("|", "category", F.col("user_id").cast("string")).alias("key"), score.alias("score"), "n_events")


def daily_top_n(events: DataFrame, as_of: str, n: int = 5, back: int = 3) -> DataFrame:
    """(category, rank, user_id, score, n_events): the day's best that none of the ``back`` days before had picked."""
    order = [F.col("score").desc(), F.col("key")]
    day = F.lit(as_of).cast("date")
    memory_rows = None
    for k in range(1, back + 1):
        before = F.date_sub(day, k)
        picks = ranking.top_n(daily_candidates(events, before), ["category"], order, n).select(before.cast("string").alias("report_date"), "category", "key")
        memory_rows = picks if memory_rows is None else memory_rows.unionByName(picks)
    fresh = memory.unreported_or_best(daily_candidates(events, day), memory_rows, F.lit(as_of), order)
    return ranking.top_n(fresh, ["category"], order, n, "rank").select("category", "rank", "user_id", "score", "n_events")


def standardise(events: DataFrame) -> DataFrame:
    """Events with a plain category, a day or null, evidence with a credibility, and text without stray blanks."""
    return events.withColumns(
        {
            "category": F.lower(F.trim("module")),
            "title": F.when(strip("title") != "", strip("title")).otherwise(F.lit("未命名事件")),
            "company": strip("company"),
            "product": strip("product"),
            "time": flexible_date("time"),
            "source": scored_sources(F.col("source")),
        }
    )


def scored(events: DataFrame) -> DataFrame:
    dated = F.exists("source", source_has_date)
    acc = accuracy(F.col("source"))
    return events.withColumn("accuracy_score", acc).withColumn("importance_score", importance(F.col("accuracy_score"), F.col("source"), F.col("sub_tags"), F.col("category"), dated))


def run_leaders(rows: DataFrame, run: Column, pool: DataFrame | None = None) -> DataFrame:
    """(uid, leader) of standardised events by ``row_id``: the first of the run and category with its strong key, else the first
    with a title like it. Companies are named as in ``pool`` where it is given, else as typed."""
    named = rows.select("row_id", "category", "company", "product", "title", run.alias("run"))
    named = named.withColumn("company_norm", F.col("company")) if pool is None else lookups.first_alias_match(named, "company", pool)
    like = F.when(F.col("category") == "paper", F.lit(LIKE_PAPER)).when(F.coalesce(F.col("category") != "opensource", F.lit(True)), F.lit(LIKE))
    key = merge.strong_key(F.col("category"), F.col("company_norm"), F.col("product"), F.col("title"))
    blocks = named.select(F.to_json(F.struct("category", "run")).alias("block"), "row_id", "title", key.alias("key"), like.alias("like"))
    return clusters.leader_clusters(blocks, "block", "row_id", "title", "row_id", "like", "key")


def reported_keys(events: DataFrame, report_date: str) -> DataFrame:
    """(report_date, category, key) of the saved events that reports before ``report_date`` had; ``added_at`` is the report's day."""
    rows = standardise(events.where((F.col("status") == "reported") & (F.col("added_at") < report_date)))
    return rows.select(F.col("added_at").alias("report_date"), "category", dedup_key("title").alias("key")).where("key <> ''").distinct()


def report_picks(events: DataFrame, report_date: str, reported: DataFrame | None = None, n: int = 5, pool: DataFrame | None = None) -> DataFrame:
    """The whole chain from saved events to ranked picks of one day. The events in the window are the day's run: stories alike
    are merged, then equal keys of several sources, before the rules apply; what ``reported`` (report_date, category, key)
    has is left out."""
    day = F.lit(report_date)
    rows = standardise(merge.latest(events, ["event_id"], ["row_id"]))
    # what is in the window is a small part of all events and is used several times
    rows = cut_lineage(ranking.in_window(rows, day, "time", "category", WINDOW_DAYS))
    rows = cut_lineage(merge.merge_leaders(rows, run_leaders(rows, day, pool), "row_id"))
    merged = merge.merge_cross_source(rows, merge.cross_source_key(F.col("category"), F.col("company"), F.col("product"), F.col("title"), day, F.col("time")), "row_id")
    merged = merged.where(passes_rules(F.col("title"), F.col("description"), F.col("source")))
    merged = scored(merged).withColumn("key", dedup_key("title"))
    order = [F.col("importance_score").desc(), F.col("row_id")]
    if reported is not None:
        merged = memory.unreported_or_best(merged, reported, day, order)
    return ranking.top_n_with_quota(merged, ["category"], order, n, (F.col("category") == "enterprise") & (F.col("sub_type") == "investment"))
