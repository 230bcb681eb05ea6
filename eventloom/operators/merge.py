"""Merging of records with equal keys, and of their evidence. All grouping is by hash aggregation with partial merge.

First and last are by an explicit sequence column, so results do not depend on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import time_bucket
from eventloom.functions.text import core_noun, dedup_key, let
from eventloom.functions.web import url_host, url_key

EVIDENCE = "array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>"


def merge_evidence(sources: Column) -> Column:
    """Evidence without empty URLs, one entry for each URL: at the place of its first, with the values of its last."""
    kept = F.filter(F.coalesce(sources, F.array().cast(EVIDENCE)), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    last = lambda ss: F.transform(F.array_distinct(F.transform(ss, lambda s: s["url"])), lambda u: F.element_at(F.filter(ss, lambda s: s["url"] == u), -1))
    return let(kept, last)


def add_new_hosts(first: Column, more: Column) -> Column:
    """``first`` with those of ``more`` that have a URL whose host it does not have yet; what is no URL counts as its own host."""
    host = lambda s: F.coalesce(url_host(s["url"]), s["url"], F.lit(""))
    new = let(F.transform(first, host), lambda hosts: F.filter(more, lambda s: (F.coalesce(s["url"], F.lit("")) != "") & ~F.array_contains(hosts, host(s))))
    return F.concat(first, new)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order`` (last-wins upsert). A null key is a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return latest(both, keys, ["_gen"]).drop("_gen")


def merge_feedback(stored: DataFrame, filed: DataFrame) -> DataFrame:
    """Feedback of both places by id; the file's holds; newest first."""
    return upsert(stored, filed, ["id"]).orderBy(F.col("created_at").desc(), "id")


#: Numbers of the sequence in one bucket of a running value.
BUCKET_ROWS = 1_000_000


def max_before(df: DataFrame, key: str, seq: str, value: str, out: str, bucket: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``out``: the highest ``value`` of the key's rows before each in the order of ``seq``, null for the first.

    The running value is kept within (key, bucket of ``seq``); the buckets' own maxima, one row each, carry it across, so
    that no task sorts a whole key.
    """
    rows = df.withColumn("_b", F.floor(F.col(seq) / bucket))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.max(value).over(before(key, "_b").orderBy(seq)))
    edges = rows.groupBy(key, "_b").agg(F.max(value).alias("_m")).withColumn("_over", F.max("_m").over(before(key).orderBy("_b"))).drop("_m")
    return rows.join(edges, [key, "_b"]).withColumn(out, F.greatest("_in", "_over")).drop("_b", "_in", "_over")


def evidence_by_key(df: DataFrame, key: str, seq: str, source: str) -> DataFrame:
    """(key, source): the evidence of each key's rows, one entry for each URL, at the place of its first, with the values of its
    last. Equal URLs are brought together before a key is; null keys are left out."""
    flat = df.where(F.col(key).isNotNull()).select(key, F.col(seq).alias("_q"), F.posexplode(F.col(source)).alias("_p", "_s")).where(F.coalesce("_s.url", F.lit("")) != "")
    spot = F.struct("_q", "_p")
    one = flat.groupBy(key, F.col("_s.url").alias("_u")).agg(F.min(spot).alias("_first"), F.max_by("_s", spot).alias("_s"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_s"))), lambda x: x["_s"]).cast(EVIDENCE).alias(source))


def merge_by_url(df: DataFrame, url: str, stars: str, seq: str, description: str, tags: str, source: str | None = None) -> DataFrame:
    """One row for each URL (case and closing slash aside): the first one's place, the most stars, the description
    and tags that were gathered at strict increases of the stars, and with ``source`` the evidence of all. Rows without
    URL are dropped.

    Increases are found by a running maximum; tags and evidence are made distinct before a URL's are brought together.
    """
    rows = df.withColumn("_key", url_key(url)).where("_key <> ''").withColumn("_s", F.coalesce(F.col(stars), F.lit(0)))
    rows = max_before(rows, "_key", seq, "_s", "_max")
    rises = F.col("_max").isNull() | (F.col("_s") > F.col("_max"))
    told = F.when(rises & (F.coalesce(F.col(description), F.lit("")) != ""), F.col(seq))
    out = rows.groupBy("_key").agg(F.min_by(url, seq).alias(url), F.min(seq).alias(seq), F.max("_s").alias(stars), F.max_by(description, told).alias(description))
    spots = rows.where(rises).select("_key", F.col(seq).alias("_q"), F.posexplode(tags).alias("_p", "_t")).groupBy("_key", "_t").agg(F.min(F.struct("_q", "_p")).alias("_first"))
    tagged = spots.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_t"))), lambda x: x["_t"]).alias(tags))
    out = out.join(tagged, "_key", "left").withColumn(tags, F.coalesce(tags, F.array().cast("array<string>")))
    if source:
        out = out.join(evidence_by_key(rows, "_key", seq, source), "_key", "left").withColumn(source, F.coalesce(source, F.array().cast(EVIDENCE)))
    return out.select(url, seq, stars, description, tags, *([source] if source else []))


def cross_source_key(category: Column, company: Column, product: Column, title: Column, report_date: Column, time: Column) -> Column:
    """The exact key under which events of several sources are one: a repository by name, else category, company, title
    key and day bucket. Null where there is no title key."""
    key = dedup_key(title)
    other = F.concat_ws("|", category, F.lower(F.coalesce(company, F.lit(""))), key, time_bucket(report_date, time))
    repo = F.lower(F.trim(F.coalesce(product, F.lit(""))))
    return F.when((category == "opensource") & (repo != ""), F.concat(F.lit("opensource|"), repo)).when(key != "", other)


def strong_key(category: Column, company: Column, product: Column, title: Column) -> Column:
    """The key under which events of one run are surely one: category, company and noun, empty parts left out. The noun is
    the product of repositories and papers, else the title's core noun or the product."""
    given = lambda c: F.when(c != "", c)
    noun = F.when(category.isin("opensource", "paper"), given(product)).otherwise(F.coalesce(given(core_noun(title)), given(product)))
    return F.concat_ws("|", given(category), given(company), noun)


def _merged(df: DataFrame, key: str, seq: str, fill: tuple[str, ...]) -> DataFrame:
    """One row for each ``key``: the first one's in the order of ``seq``, with the longest description (the earliest of
    equals), all evidence, and of ``fill`` the first values that are given."""
    kinds = dict(df.dtypes)

    def given(c: str) -> Column:
        if kinds[c] == "string":
            return F.length(F.trim(c)) > 0
        return F.size(c) > 0 if kinds[c].startswith(("map", "array")) else F.col(c).isNotNull()

    made = {c: F.min_by(c, F.when(given(c), F.col(seq))) for c in fill if c in kinds}
    if "description" in kinds:
        made["description"] = F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col(seq)))
    others = [c for c in df.columns if c not in (seq, key, "source")]  # seq comes last: an alias before the others would hide the column from them
    out = df.groupBy(key).agg(*[made.get(c, F.min_by(c, seq)).alias(c) for c in others], F.min(seq).alias(seq))
    if "source" in kinds:
        out = out.join(evidence_by_key(df, key, seq, "source"), key, "left").withColumn("source", F.coalesce("source", F.array().cast(EVIDENCE)))
    return out


def merge_leaders(df: DataFrame, leaders: DataFrame, uid: str) -> DataFrame:
    """One row for each leader of ``leaders`` (uid, leader): its own, with the longest description (the earliest of equals),
    all evidence, and the first entities that are given. Leaders come first in the order of ``uid``."""
    rows = df.join(leaders.select(F.col("uid").alias(uid), F.col("leader").alias("_leader")), uid)
    return _merged(rows, "_leader", uid, ("entities",)).select(*df.columns)


def merge_cross_source(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """One row for each key: the first one's, with the longest description (the earliest of equals), the first company,
    product, entities and insight that are given, and all evidence. Rows without key pass."""
    rows = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("\x00"), F.col(seq).cast("string"))))  # none but the row itself
    return _merged(rows, "_key", seq, ("company", "product", "entities", "insight")).select(*df.columns)


def merge_papers(df: DataFrame, leaders: DataFrame, uid: str) -> DataFrame:
    """One row for each leader of ``leaders`` (uid, leader): its own, with the evidence of the others whose host was not there
    before, one entry for each URL. What is no URL counts as its own host."""
    rows = df.join(leaders.select(F.col("uid").alias(uid), F.col("leader").alias("_leader")), uid)
    flat = rows.select("_leader", F.col(uid).alias("_q"), F.posexplode(F.coalesce("source", F.array().cast(EVIDENCE))).alias("_p", "_s"))
    host = F.coalesce(url_host("_s.url"), F.col("_s.url"), F.lit(""))
    flat = flat.withColumn("_host", host).where((F.col("_q") == F.col("_leader")) | (F.coalesce("_s.url", F.lit("")) != ""))
    first = flat.groupBy("_leader", "_host").agg(F.min("_q").alias("_q"))
    spot = F.struct("_q", "_p")
    kept = flat.join(first, ["_leader", "_host", "_q"]).groupBy("_leader", F.coalesce("_s.url", F.lit("")).alias("_u")).agg(F.min(spot).alias("_first"), F.max_by("_s", spot).alias("_s"))
    sources = kept.groupBy("_leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_s"))), lambda x: x["_s"]).cast(EVIDENCE).alias("_sources"))
    own = df.join(leaders.where("uid = leader").select(F.col("uid").alias(uid)), uid)
    return own.join(sources, F.col(uid) == F.col("_leader"), "left").withColumn("source", F.coalesce("_sources", F.array().cast(EVIDENCE))).select(*df.columns)


def append_or_replace(stored: DataFrame, record: DataFrame) -> DataFrame:
    """Feedback with one more record, or with it in place of the one of its id; newest first."""
    return merge_feedback(stored, record)


def feedback_with_event(feedback: DataFrame, events: DataFrame) -> DataFrame:
    """``feedback`` (event_id, report_id, …) with the agent's score and the report of its event: the event's importance, 0
    for an unknown event, and the report of its day if it was reported, else the report that was stated."""
    known = latest(events.select("event_id", "importance_score", "status", "added_at", "row_id"), ["event_id"], ["row_id"]).drop("row_id")
    report = F.when(F.col("status") == "reported", F.concat(F.lit("report_"), F.regexp_replace(F.coalesce("added_at", F.lit("")), "-", ""))).otherwise(F.coalesce("report_id", F.lit("")))
    score = F.coalesce(F.nanvl("importance_score", F.lit(None).cast("double")), F.lit(0.0))
    return feedback.join(known, "event_id", "left").withColumn("report_id", report).withColumn("agent_score", score).drop("importance_score", "status", "added_at")
