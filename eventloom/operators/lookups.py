"""Lookups, joins with dimension tables, fallback chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import strip
from eventloom.session import broadcast_if_small

#: Failures in a row from which a source is left alone.
BREAKER_THRESHOLD = 10


def matching(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal in all given columns; a condition of None is no condition. Filters reach the scan."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def open_sources(sources: DataFrame, health: DataFrame, threshold: int = BREAKER_THRESHOLD) -> DataFrame:
    """The sources that have not failed ``threshold`` times in a row; unknown ones are open."""
    return sources.join(health.where(F.col("fail_count") >= threshold).select("source_key"), "source_key", "left_anti")


def first_alias_match(names: DataFrame, name: str, pool: DataFrame, order: str = "company_id", min_alias: int = 1, without: tuple[str, ...] = ()) -> DataFrame:
    """``names`` with ``company_norm``: the first entry in pool order whose name equals, or one of whose aliases is contained in
    the text (case aside); else the text trimmed.

    Only distinct texts meet the pool. The pool is a dimension table; its aliases are broadcast if their number is bounded,
    and the containment join is then a broadcast nested loop over distinct texts.
    """
    alias = F.explode(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    aliases = pool.select(F.col(order).alias("_o"), "company", alias.alias("_a")).where((F.length("_a") >= min_alias) & ~F.col("_a").isin(*([w.lower() for w in without] or [""])))
    texts = names.select(F.col(name).alias("_t")).where("_t is not null").distinct()
    by_alias = texts.join(broadcast_if_small(aliases), F.contains(F.lower("_t"), F.col("_a"))).select("_t", "_o", "company")
    by_name = texts.join(pool.select(F.col(order).alias("_o"), "company"), F.col("_t") == F.col("company")).select("_t", "_o", "company")
    first = by_alias.unionByName(by_name).groupBy("_t").agg(F.min_by("company", "_o").alias("_c"))
    return names.join(first, names[name] == first["_t"], "left").withColumn("company_norm", F.coalesce("_c", strip(name))).drop("_t", "_c")


def sections(modules: list[str], picks: DataFrame, note: str = "no entries today") -> DataFrame:
    """(module, n, note): every requested module with the number of its picks, a note where it has none."""
    spark = picks.sparkSession
    wanted = spark.createDataFrame([(m, k) for k, m in enumerate(modules)], "module string, ord int")
    counts = picks.groupBy("module").agg(F.count("*").alias("n"))
    return wanted.join(counts, "module", "left").select("module", "ord", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(note)).alias("note"))


def first_non_empty(chain: list[Callable[[], DataFrame]], least: int = 1) -> DataFrame:
    """The first source of a chain that has ``least`` rows, else the last. Each is probed with a limit, never counted whole."""
    df = chain[0]()
    for source in chain[1:]:
        if df.limit(least).count() >= least:
            return df
        df = source()
    return df


def relaxing(df: DataFrame, strict: Column, relaxed: Column) -> DataFrame:
    """Rows of the strict condition; if there is none, of the relaxed one."""
    return first_non_empty([lambda: df.where(strict), lambda: df.where(relaxed)])


def union_with_fallback(main: DataFrame, fallback: DataFrame, least: int) -> DataFrame:
    """``main``, and ``fallback`` as well if ``main`` has fewer than ``least`` rows, in one plan: the count is one row, joined to the fallback."""
    few = main.limit(least).agg(F.count("*").alias("_n")).where(F.col("_n") < least)
    return main.unionByName(fallback.crossJoin(F.broadcast(few)).drop("_n"))


def with_staleness(cache: DataFrame, written_at: str, as_of: Column, max_hours: int) -> DataFrame:
    """A cache read with ``stale``: whether it is older than ``max_hours``."""
    return cache.withColumn("stale", (as_of.cast("long") - F.col(written_at).cast("timestamp").cast("long")) > max_hours * 3600)


def mark_stale(df: DataFrame, sources: str, text: str, note: str = "(cached)") -> DataFrame:
    """Rows from a stale cache, with a piece of evidence and a note that say so."""
    stamp = F.struct(F.lit("").alias("url"), F.lit("cache").alias("source_type"), F.lit("local cache").alias("name"), F.lit(1.0).alias("credibility_score"), F.lit(None).cast("string").alias("published_at"))
    return df.withColumn(sources, F.array_append(sources, stamp)).withColumn(text, F.concat_ws(" ", text, F.lit(note)))


def corroborate(df: DataFrame, hits: DataFrame, uid: str, sources: str, least: float = 4.0, most: int = 3) -> DataFrame:
    """``df`` with up to ``most`` new pieces of credible evidence from ``hits`` (uid, ord, evidence)."""
    good = hits.where(F.col("evidence.credibility_score") >= least)
    first = Window.partitionBy(uid).orderBy("ord")
    good = good.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    more = good.groupBy(uid).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "evidence"))), lambda x: x["evidence"]).alias("_more"))
    urls = F.transform(F.col(sources), lambda s: s["url"])
    return df.join(more, uid, "left").withColumn(sources, F.when(F.col("_more").isNull(), F.col(sources)).otherwise(F.concat(sources, F.filter("_more", lambda s: ~F.array_contains(urls, s["url"]))))).drop("_more")


def with_restated(picks: DataFrame, restated: DataFrame) -> DataFrame:
    """``picks`` with ``title_zh`` and ``description_zh`` of ``restated`` (event_id, title, body) where they are given; the first
    restatement of an event holds."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = restated.groupBy("event_id").agg(F.first(blank("title"), ignorenulls=True).alias("title_zh"), F.first(blank("body"), ignorenulls=True).alias("description_zh"))
    return picks.join(one, "event_id", "left")


def search_matches(hits: DataFrame, pool: DataFrame, words: list[str], most: int = 6, min_alias: int = 3) -> DataFrame:
    """Search hits (file, pos, title, snippet) for companies without a feed of their own, with ``company``: the first in pool order
    with an alias of ``min_alias`` characters in a text that has one of ``words`` too; the first ``most`` of each file."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    rows = hits.withColumn("_t", text).where(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w)))
    named = F.array_union(F.array("company"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = pool.select("company_id", "company", F.explode(F.transform(named, F.lower)).alias("_a")).where(F.length("_a") >= min_alias)
    found = rows.join(broadcast_if_small(names), F.contains("_t", F.col("_a"))).groupBy("file", "pos").agg(F.min_by("company", "company_id").alias("company"))
    first = Window.partitionBy("file").orderBy("pos")
    return rows.drop("_t").join(found, ["file", "pos"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r")
