"""Queries of the relational and scalar operators over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import dates, records, text, web
from eventloom.operators import clusters, joins, lookups, memory, merge, metrics, ranking
from eventloom.plans import daily
from eventloom.session import table

AS_OF = "2026-08-31"
EVENT_DAY = "2024-01-15"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _std(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "standard_events")


# ---- fragments of SQL -------------------------------------------------------------------------------------------
_CAT = "lower(trim(module))"
_DAY = (
    "CASE WHEN regexp_matches(coalesce(time,''), '(\\d{4})-(\\d{1,2})-(\\d{1,2})') THEN regexp_extract(time,'(\\d{4})-(\\d{1,2})-(\\d{1,2})',1) || '-' || lpad(regexp_extract(time,'(\\d{4})-(\\d{1,2})-(\\d{1,2})',2),2,'0') || '-' || lpad(regexp_extract(time,'(\\d{4})-(\\d{1,2})-(\\d{1,2})',3),2,'0')"
    " WHEN regexp_matches(coalesce(time,''), '(\\d{4})[年./](\\d{1,2})[月./](\\d{1,2})日?') THEN regexp_extract(time,'(\\d{4})[年./](\\d{1,2})[月./](\\d{1,2})日?',1) || '-' || lpad(regexp_extract(time,'(\\d{4})[年./](\\d{1,2})[月./](\\d{1,2})日?',2),2,'0') || '-' || lpad(regexp_extract(time,'(\\d{4})[年./](\\d{1,2})[月./](\\d{1,2})日?',3),2,'0')"
    " WHEN regexp_matches(coalesce(time,''), '^\\s*(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\\s*)?(\\d{1,2})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+(\\d{4})\\b') THEN"
    " regexp_extract(time,'(\\d{1,2})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+(\\d{4})\\b',3) || '-' || lpad(CAST(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], regexp_extract(time,'(\\d{1,2})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+(\\d{4})\\b',2)) AS VARCHAR),2,'0') || '-' || lpad(regexp_extract(time,'(\\d{1,2})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+(\\d{4})\\b',1),2,'0') END"
)
_STOP = "[" + ",".join(f"'{w}'" for w in text.DEDUP_STOP_WORDS) + "]"
_KEY = (
    "substr(array_to_string(list_filter([array_to_string(regexp_extract_all(lower(coalesce(title,'')), '[\\x{4e00}-\\x{9fa5}]{2,}')[1:4], ' '),"
    f" array_to_string(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), ' ')], lambda p: p <> ''), ' '), 1, 80)"
)


def _cred(url: str, kind: str) -> str:
    any_of = lambda ds: "|".join(x.replace(".", "\\.") for x in ds)
    return (
        f"CASE WHEN {kind} IN ('github_repo','arxiv','official_rss','official') THEN 5.0 WHEN regexp_matches(lower(coalesce({url},'')), '{any_of(web.TOP_DOMAINS)}') THEN 5.0"
        f" WHEN regexp_matches(lower(coalesce({url},'')), '{any_of(web.HIGH_DOMAINS)}') THEN 4.5 WHEN regexp_matches(lower(coalesce({url},'')), '{any_of(web.MEDIA_DOMAINS)}') THEN 4.0"
        f" WHEN regexp_matches(lower(coalesce({url},'')), '{any_of(web.FORUM_DOMAINS)}') THEN 3.0 WHEN coalesce({url},'') = '' THEN 1.0 ELSE 2.0 END"
    )


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x},''), '^[\\s\\x{{00A0}}\\x{{3000}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{3000}}\\x{{FEFF}}]+$', '', 'g')"


_FIRST_PARTY = ",".join(f"'{t}'" for t in dates.FIRST_PARTY_TYPES)
_DATED = f"len(list_filter(source, lambda s: coalesce(s.published_at,'') <> '' OR coalesce(s.source_type IN ({_FIRST_PARTY}), false) OR regexp_matches(coalesce(s.url,''), '/(20\\d{{2}})/(\\d{{1,2}})/(\\d{{1,2}})/'))) > 0"
_BEST = f"list_max(list_transform(source, lambda s: coalesce(s.credibility_score, {_cred('s.url', 's.source_type')})))"
_ACC = (
    f"CASE WHEN coalesce(len(source),0) = 0 THEN 1.0 ELSE greatest(1.0, least(5.0, floor((CASE WHEN {_BEST} >= 4.5 THEN 5.0 WHEN {_BEST} >= 4 THEN 4.0 WHEN {_BEST} >= 3 THEN 3.0 ELSE 1.0 END"
    f" + CASE WHEN len(source) >= 2 THEN least(0.5, (len(source)-1)*0.25) ELSE 0 END - CASE WHEN {_DATED} THEN 0 ELSE 1.5 END) * 10 + 0.5) / 10)) END"
)


# ---- the daily report -------------------------------------------------------------------------------------------
def _daily_sql(as_of: str, n: int, back: int) -> str:
    cand = (
        "SELECT event_type AS category, user_id, event_type || '|' || CAST(user_id AS VARCHAR) AS k, count(*) AS n_events,"
        " floor((0.6*least(5.0, max(value)/100.0) + least(1.0, 0.3*count(*)))*10+0.5)/10 AS score FROM events WHERE date_diff('day', CAST(ts AS DATE), {d}) BETWEEN 0 AND 6 GROUP BY ALL"
    )
    days = [f"DATE '{as_of}' - {k}" for k in range(1, back + 1)]
    mem = " UNION ALL ".join(
        f"SELECT category, k, {k + 1} AS age FROM ({cand.format(d=d)}) QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, k) <= {n}" for k, d in enumerate(days)
    )
    return f"""
        WITH c AS ({cand.format(d=f"DATE '{as_of}'")}),
        m AS (SELECT DISTINCT category, k FROM ({mem}) WHERE age <= {memory.OTHER_DAYS}),
        f AS (SELECT c.*, m.k IS NOT NULL AS reported, row_number() OVER (PARTITION BY c.category ORDER BY score DESC, c.k) AS r,
                     count(*) FILTER (m.k IS NULL) OVER (PARTITION BY c.category) AS fresh
              FROM c LEFT JOIN m ON c.category = m.category AND c.k = m.k)
        SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, k) AS INTEGER) AS rank, user_id, score, n_events
        FROM f WHERE NOT reported OR (fresh = 0 AND r = 1)
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, k) <= {n}"""


@query("daily_topn", _daily_sql(EVENT_DAY, 5, 3))
def daily_topn(spark: SparkSession, d: str) -> DataFrame:
    return daily.daily_top_n(table(spark, d, "events"), EVENT_DAY)


def _memory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and reported keys made from the events of a day and of the days before it."""
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    keys = ev.select("day", F.col("event_type").alias("category"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), "value", "event_id")
    cand = keys.where(F.col("day") == F.lit(EVENT_DAY).cast("date")).groupBy("category", "key").agg(F.max("value").alias("score"))
    mem = keys.where((F.col("day") < F.lit(EVENT_DAY).cast("date")) & (F.col("value") > 20)).select(F.col("day").cast("string").alias("report_date"), "category", "key").distinct()
    return cand, mem


_MEM_SQL = f"""
    WITH keys AS (SELECT CAST(ts AS DATE) AS day, event_type AS category, event_type || '|' || CAST(user_id AS VARCHAR) AS key, value FROM events),
    c AS (SELECT category, key, max(value) AS score FROM keys WHERE day = DATE '{EVENT_DAY}' GROUP BY ALL),
    m AS (SELECT DISTINCT category, key FROM keys WHERE day < DATE '{EVENT_DAY}' AND value > 20 AND date_diff('day', day, DATE '{EVENT_DAY}') BETWEEN 0 AND {memory.OTHER_DAYS})"""


@query("reported_antijoin", _MEM_SQL + " SELECT c.* FROM c ANTI JOIN m ON c.category = m.category AND c.key = m.key")
def reported_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return memory.unreported(*_memory(spark, d), F.lit(EVENT_DAY))


@query(
    "reported_antijoin_keep_best",
    _MEM_SQL
    + """, j AS (SELECT c.*, m.key IS NOT NULL AS hit, count(*) FILTER (m.key IS NULL) OVER (PARTITION BY c.category) AS fresh,
                row_number() OVER (PARTITION BY c.category ORDER BY score DESC, c.key) AS r
           FROM c LEFT JOIN m ON c.category = m.category AND c.key = m.key)
    SELECT category, key, score FROM j WHERE NOT hit OR (fresh = 0 AND r = 1)""",
)
def reported_antijoin_keep_best(spark: SparkSession, d: str) -> DataFrame:
    return memory.unreported_or_best(*_memory(spark, d), F.lit(EVENT_DAY), [F.col("score").desc(), F.col("key")])


@query(
    "reported_memory_ttl",
    f"""WITH keys AS (SELECT CAST(ts AS DATE) AS day, event_type AS category, event_type || '|' || CAST(user_id AS VARCHAR) AS key, value FROM events)
        SELECT DISTINCT strftime(day, '%Y-%m-%d') AS report_date, category, key FROM keys
        WHERE (day < DATE '{EVENT_DAY}' AND value > 20 AND date_diff('day', day, DATE '{EVENT_DAY}') <= 14) OR day = DATE '{EVENT_DAY}'""",
)
def reported_memory_ttl(spark: SparkSession, d: str) -> DataFrame:
    cand, mem = _memory(spark, d)
    return memory.remember(mem, EVENT_DAY, cand)


# ---- ranking ----------------------------------------------------------------------------------------------------
_CLEAN_SCORE = "importance_score IS NOT NULL AND NOT isnan(importance_score)"


@query(
    "topn_with_quota",
    f"""WITH s AS (SELECT row_id, {_CAT} AS category, importance_score AS score, coalesce(sub_type = 'investment', false) AS sp FROM standard_events WHERE {_CLEAN_SCORE}),
        r AS (SELECT *, row_number() OVER (PARTITION BY category, sp ORDER BY score DESC, row_id) AS k FROM s),
        t AS (SELECT category, row_id, score, row_number() OVER (PARTITION BY category ORDER BY sp DESC, score DESC, row_id) AS rank_no FROM r WHERE NOT sp OR k = 1)
        SELECT category, row_id, score, CAST(rank_no AS INTEGER) AS rank_no FROM t WHERE rank_no <= 5""",
)
def topn_with_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).select("row_id", F.lower(F.trim("module")).alias("category"), F.col("importance_score").alias("score"), "sub_type").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return ranking.top_n_with_quota(rows, ["category"], [F.col("score").desc(), F.col("row_id")], 5, F.col("sub_type") == "investment").select("category", "row_id", "score", "rank_no")


@query(
    "window_filter",
    f"""WITH s AS (SELECT row_id, {_CAT} AS category, {_DAY} AS day FROM standard_events)
        SELECT category, day, count(*) AS n FROM s
        WHERE date_diff('day', TRY_CAST(day AS DATE), DATE '{AS_OF}') BETWEEN 0 AND CASE category WHEN 'paper' THEN 6 WHEN 'enterprise' THEN 4 ELSE 0 END GROUP BY ALL""",
)
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).select("row_id", F.lower(F.trim("module")).alias("category"), dates.flexible_date("time").alias("day"))
    return ranking.in_window(rows, F.lit(AS_OF), "day", "category", daily.WINDOW_DAYS).groupBy("category", "day").agg(F.count("*").alias("n"))


@query(
    "window_low_volume_expand",
    f"""WITH s AS (SELECT row_id, TRY_CAST({_DAY} AS DATE) AS day FROM standard_events WHERE {_CAT} = 'enterprise'),
        w AS (SELECT *, date_diff('day', day, DATE '{AS_OF}') AS diff FROM s), p AS (SELECT * FROM w WHERE diff BETWEEN 0 AND 4)
        SELECT row_id, strftime(day, '%Y-%m-%d') AS day FROM p WHERE (SELECT count(*) FROM p WHERE diff < 3) < 2 OR diff < 3""",
)
def window_low_volume_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).where(F.lower(F.trim("module")) == "enterprise").select("row_id", dates.flexible_date("time").alias("day"))
    return ranking.expand_low_volume(rows, F.lit(AS_OF), "day")


@query("cap_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k"), "o_custkey", "o_orderkey")
    return ranking.cap_per_key(rows, "k", [F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("candidate_cut", "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def candidate_cut(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("score"))
    return ranking.candidate_cut(rows, [F.col("score").desc(), F.col("o_orderkey")], 5)


@query(
    "influence_rank",
    """SELECT row_id, CAST((CASE WHEN contains(lower(coalesce(company,'')), 'labs') OR contains(lower(coalesce(company,'')), 'institute') THEN 2 ELSE 0 END)
              + (CASE WHEN regexp_matches(coalesce(description,''), '(?i)顶会|sota|热议') THEN 2 ELSE 0 END) + (CASE WHEN contains(coalesce(description,''), '高引用') THEN 1 ELSE 0 END)
              - (CASE WHEN contains(coalesce(description,''), 'low_influence') THEN 1 ELSE 0 END) AS INTEGER) AS influence FROM standard_events""",
)
def influence_rank(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", ranking.influence(F.col("company"), F.col("description"), ["labs", "institute"]).alias("influence"))


# ---- merging ----------------------------------------------------------------------------------------------------
@query(
    "merge_by_url",
    """WITH r AS (SELECT snap_id, repo_url, coalesce(stars,0) AS s, fetched_at, regexp_replace(lower(trim(coalesce(repo_url,''))), '/+$', '') AS k FROM star_snapshots),
       q AS (SELECT *, max(s) OVER (PARTITION BY k ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r WHERE k <> ''),
       g AS (SELECT k, fetched_at, min(snap_id) AS i FROM q WHERE (m IS NULL OR s > m) AND fetched_at IS NOT NULL GROUP BY ALL), t AS (SELECT k, string_agg(fetched_at, '|' ORDER BY i) AS tags FROM g GROUP BY k),
       o AS (SELECT k, arg_min(repo_url, snap_id) AS repo_url, min(snap_id) AS snap_id, max(s) AS stars, arg_max(fetched_at, CASE WHEN (m IS NULL OR s > m) AND coalesce(fetched_at,'') <> '' THEN snap_id END) AS fetched_at FROM q GROUP BY k)
       SELECT repo_url, snap_id, stars, fetched_at, coalesce(tags, '') AS tags FROM o LEFT JOIN t USING (k)""",
)
def merge_by_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "star_snapshots").withColumn("tags", F.filter(F.array("fetched_at"), lambda t: t.isNotNull()))
    out = merge.merge_by_url(rows, "repo_url", "stars", "snap_id", "fetched_at", "tags")
    return out.select("repo_url", "snap_id", "stars", "fetched_at", F.array_join("tags", "|").alias("tags"))


@query(
    "merge_cross_source",
    f"""WITH s AS (SELECT row_id, {_CAT} AS category, {_strip('company')} AS company, {_strip('product')} AS product, CASE WHEN {_strip('title')} <> '' THEN {_strip('title')} ELSE '未命名事件' END AS title, description, source,
                   coalesce(CAST(least(7, greatest(0, date_diff('day', TRY_CAST({_DAY} AS DATE), DATE '{AS_OF}'))) AS VARCHAR), 'no-date') AS bucket FROM standard_events),
        v AS (SELECT *, {_KEY} AS tk FROM s),
        k AS (SELECT *, CASE WHEN category = 'opensource' AND lower(product) <> '' THEN 'opensource|' || lower(product)
                             WHEN tk <> '' THEN category || '|' || lower(company) || '|' || tk || '|' || bucket END AS gk FROM v),
        g0 AS (SELECT *, coalesce(gk, '#' || row_id) AS g FROM k),
        u AS (SELECT g, x.url AS url, min(row(row_id, i)) AS first_at, arg_max(coalesce(x.name,''), row(row_id, i)) AS name FROM (SELECT g, row_id, i, source[i] AS x FROM g0, unnest(range(1, len(source)+1)) AS t(i)) WHERE coalesce(x.url,'') <> '' GROUP BY g, x.url),
        e AS (SELECT g, string_agg(url || '=' || name, ' ' ORDER BY first_at) AS evidence FROM u GROUP BY g),
        o AS (SELECT g, min(row_id) AS row_id, arg_min(title, row_id) AS title, arg_max(description, row(length(coalesce(description,'')), -row_id)) AS description, arg_min(company, CASE WHEN length(trim(company)) > 0 THEN row_id END) AS company,
                     arg_min(product, CASE WHEN length(trim(product)) > 0 THEN row_id END) AS product FROM g0 GROUP BY g)
        SELECT row_id, title, description, company, product, coalesce(evidence, '') AS evidence FROM o LEFT JOIN e USING (g)""",
)
def merge_cross_source(spark: SparkSession, d: str) -> DataFrame:
    rows = daily.standardise(_std(spark, d)).select("row_id", "category", "company", "product", F.col("title"), "description", "source", "time")
    key = merge.cross_source_key(F.col("category"), F.col("company"), F.col("product"), F.col("title"), F.lit(AS_OF), F.col("time"))
    out = merge.merge_cross_source(rows, key, "row_id")
    evidence = F.array_join(F.transform("source", lambda s: F.concat(s["url"], F.lit("="), F.coalesce(s["name"], F.lit("")))), " ")
    return out.select("row_id", "title", "description", "company", "product", evidence.alias("evidence"))


@query(
    "source_merge_last_wins",
    """WITH f AS (SELECT row_id, i, source[i] AS s FROM standard_events, unnest(range(1, len(source)+1)) AS t(i)),
       u AS (SELECT row_id, s.url AS url, min(i) AS first_at, arg_max(s.name, i) AS name FROM f WHERE coalesce(s.url,'') <> '' GROUP BY ALL)
       SELECT row_id, string_agg(url || '=' || coalesce(name,''), ' ' ORDER BY first_at) AS merged FROM u GROUP BY row_id""",
)
def source_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    merged = _std(spark, d).select("row_id", merge.merge_evidence(F.col("source")).alias("m")).where(F.size("m") > 0)
    return merged.select("row_id", F.array_join(F.transform("m", lambda s: F.concat(s["url"], F.lit("="), F.coalesce(s["name"], F.lit("")))), " ").alias("merged"))


@query("upsert_latest", "SELECT event_id, row_id, status, CASE WHEN NOT isnan(importance_score) THEN importance_score END AS score FROM standard_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY row_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).select("event_id", "row_id", "status", F.nanvl("importance_score", F.lit(None).cast("double")).alias("score"))
    cut = rows.agg(F.max("row_id").alias("m"))
    both = rows.crossJoin(F.broadcast(cut))
    old, new = (merge.latest(both.where(c).drop("m"), ["event_id"], ["row_id"]) for c in (F.col("row_id") <= F.col("m") / 2, F.col("row_id") > F.col("m") / 2))
    return merge.upsert(old, new, ["event_id"])


@query(
    "title_similarity_join",
    """WITH t AS (SELECT DISTINCT lower(title) AS t FROM standard_events WHERE coalesce(title,'') <> ''),
       w AS (SELECT t, list_distinct(list_filter(string_split(trim(regexp_replace(t, '[^\\x{4e00}-\\x{9fa5}a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS ws FROM t),
       f AS (SELECT t, len(ws) AS n, unnest(ws) AS x FROM w),
       p AS (SELECT a.t AS title_a, b.t AS title_b, a.n AS na, b.n AS nb, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.t < b.t AND a.n >= 0.85*b.n - 1e-9 AND b.n >= 0.85*a.n - 1e-9 GROUP BY ALL)
       SELECT title_a, title_b, c / (na + nb - c) AS similarity FROM p WHERE c / (na + nb - c) >= 0.85""",
)
def title_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.title_links(_std(spark, d), "title", 0.85)


@query("leader_cluster_dedup")
def leader_cluster_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Leaders of the events of each run, as the reference merges them: its rule is applied to the events of one run, and
    ``added_at`` is the run's day."""
    return daily.run_leaders(daily.standardise(_std(spark, d)), F.col("added_at"), table(spark, d, "enterprise_pool"))


@query("paper_dedup")
def paper_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Papers by product id or title, over the whole table in the order of the rows."""
    rows = _std(spark, d).where(F.lower(F.trim("module")) == "paper")
    pid = F.regexp_replace(F.lower("product"), "^arxiv:", "")
    tkey = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9\x{4e00}-\x{9fa5}]+", " "))
    return clusters.first_by_either_key(rows.select("row_id", pid.alias("pid"), tkey.alias("tkey")), "row_id", "pid", "tkey", "row_id")


# ---- state ------------------------------------------------------------------------------------------------------
_SNAP = "WITH s AS (SELECT repo_url AS repo, stars, CAST(trim(replace(fetched_at,'T',' ')) AS TIMESTAMPTZ) AS t, snap_id FROM star_snapshots WHERE stars >= 0)"


def _snaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "star_snapshots").where("stars >= 0").select(F.col("repo_url").alias("repo"), "stars", F.try_to_timestamp(F.trim("fetched_at")).alias("at"), "snap_id")


@query(
    "snapshot_ttl",
    _SNAP + f", f AS (SELECT repo, min(t) AS at0 FROM s GROUP BY repo) SELECT repo, epoch_us(at0) AS at_us FROM f WHERE at0 >= TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 8 DAY",
)
def snapshot_ttl(spark: SparkSession, d: str) -> DataFrame:
    rows = _snaps(spark, d)
    split = F.lit(AS_OF).cast("timestamp") - F.expr("interval 30 days")
    kept = memory.first_seen(rows.where(F.col("at") < split), rows.where(F.col("at") >= split), F.lit(AS_OF).cast("timestamp"))
    return kept.select("repo", F.unix_micros("at").alias("at_us"))


@query(
    "snapshot_growth",
    _SNAP
    + f""", c AS (SELECT repo, arg_max(stars, row(t, snap_id)) AS stars FROM s GROUP BY repo), p AS (SELECT repo, arg_max(stars, row(t, snap_id)) AS past FROM s WHERE t <= TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 5 DAY GROUP BY repo)
       SELECT c.repo, c.stars, CASE WHEN past IS NOT NULL THEN greatest(0, c.stars - past) END AS growth FROM c LEFT JOIN p USING (repo)""",
)
def snapshot_growth(spark: SparkSession, d: str) -> DataFrame:
    rows, as_of = _snaps(spark, d), F.lit(AS_OF).cast("timestamp")
    last = lambda df: df.groupBy("repo").agg(F.max_by("stars", F.struct("at", "snap_id")).alias("stars"), F.max("at").alias("at"))
    past = last(rows.where(F.col("at") <= as_of - F.expr("interval 5 days")))
    return memory.growth(last(rows).select("repo", "stars"), past, as_of)


@query(
    "source_health_fold",
    """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, props FROM events),
       l AS (SELECT user_id, max(CASE WHEN ok THEN event_id END) AS t, arg_max(props, CASE WHEN NOT ok THEN event_id END) AS last_error, arg_max(ok, event_id) AS last_ok FROM e GROUP BY user_id)
       SELECT l.user_id, (SELECT count(*) FROM e WHERE e.user_id = l.user_id AND NOT ok AND (t IS NULL OR event_id > t)) AS fail_count, last_error, last_ok FROM l""",
)
def source_health_fold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.health(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "error", "props")


@query(
    "breaker_filter",
    """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), l AS (SELECT user_id, max(CASE WHEN ok THEN event_id END) AS t FROM e GROUP BY user_id),
       f AS (SELECT l.user_id, count(*) FILTER (NOT ok AND (t IS NULL OR event_id > t)) AS n FROM l JOIN e USING (user_id) GROUP BY ALL) SELECT user_id AS source_key FROM f WHERE n < 1""",
)
def breaker_filter(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    health = metrics.health(ev, "user_id", "event_id", F.col("event_type") != "error", "props").withColumnRenamed("user_id", "source_key")
    return lookups.open_sources(ev.select(F.col("user_id").alias("source_key")).distinct(), health, threshold=1)


@query(
    "failure_runs",
    """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM events)
       SELECT user_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM e WHERE NOT ok GROUP BY user_id, run_no""",
)
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failure_runs(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "error")


# ---- aggregates -------------------------------------------------------------------------------------------------
@query(
    "quality_metrics",
    f"""WITH f AS (SELECT CASE WHEN NOT isnan(importance_score) THEN importance_score END AS a, CASE WHEN NOT isnan(accuracy_score) THEN accuracy_score END AS h FROM standard_events
                   WHERE created_at >= TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 30 DAY AND created_at <= TIMESTAMPTZ '{AS_OF} 00:00:00+00')
        SELECT count(*) AS total, coalesce(floor(avg(coalesce(a,0))*100+0.5)/100,0) AS avg_agent, coalesce(floor(avg(h)*100+0.5)/100,0) AS avg_human,
               coalesce(floor(100.0*count(*) FILTER (h IS NOT NULL AND abs(coalesce(a,0)-h) <= 0.5)/nullif(count(h),0)*10+0.5)/10,0) AS consistency,
               coalesce(floor(100.0*count(*) FILTER (h >= 4)/nullif(count(h),0)*10+0.5)/10,0) AS satisfaction FROM f""",
)
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    plain = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = _std(spark, d).select(plain("importance_score").alias("agent_score"), plain("accuracy_score").alias("human_score"), "created_at")
    return metrics.quality_metrics(rows, F.lit(AS_OF).cast("timestamp"), 30)


@query("tag_histogram", "SELECT tag, count(*) AS n FROM (SELECT unnest(sub_tags) AS tag FROM standard_events) GROUP BY tag")
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tag_histogram(_std(spark, d), "sub_tags")


@query("status_histogram", "SELECT status, count(*) AS n FROM standard_events GROUP BY status")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_std(spark, d), "status")


@query("empty_modules", "SELECT n_name AS module FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def empty_modules(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    some = table(spark, d, "supplier").where("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("module"))
    return metrics.empty_groups(nation.select(F.col("n_name").alias("module")), some, "module")


@query(
    "sections_left_join",
    """WITH c AS (SELECT lower(trim(module)) AS module, count(*) AS n FROM standard_events WHERE status = 'reported' GROUP BY 1)
       SELECT m.module, CAST(m.ord AS INTEGER) AS ord, coalesce(n,0) AS n, CASE WHEN coalesce(n,0) = 0 THEN 'no entries today' END AS note
       FROM (VALUES ('paper',0),('opensource',1),('enterprise',2),('policy',3)) AS m(module, ord) LEFT JOIN c USING (module)""",
)
def sections_left_join(spark: SparkSession, d: str) -> DataFrame:
    picks = _std(spark, d).where("status = 'reported'").select(F.lower(F.trim("module")).alias("module"))
    return lookups.sections(["paper", "opensource", "enterprise", "policy"], picks)


@query(
    "hq_join",
    f"""WITH hq AS (SELECT row_id, importance_score, {_CAT} AS category FROM standard_events WHERE {_CLEAN_SCORE} QUALIFY row_number() OVER (PARTITION BY {_CAT} ORDER BY importance_score DESC, row_id) <= 50)
        SELECT hq.category, hq.row_id, e.event_id, e.status FROM hq JOIN standard_events e USING (row_id)""",
)
def hq_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).withColumn("category", F.lower(F.trim("module"))).where(F.col("importance_score").isNotNull() & ~F.isnan("importance_score"))
    hq = ranking.top_n(rows.select("category", "row_id", "importance_score"), ["category"], [F.col("importance_score").desc(), F.col("row_id")], 50).select("category", "row_id")
    return hq.join(_std(spark, d).select("row_id", "event_id", "status"), "row_id").select("category", "row_id", "event_id", "status")


@query(
    "alias_match_first",
    f"""WITH a AS (SELECT company_id AS o, company, lower(unnest(aliases)) AS al FROM enterprise_pool), t AS (SELECT DISTINCT company AS t FROM standard_events WHERE company IS NOT NULL),
       h AS (SELECT t, o, a.company FROM t JOIN a ON contains(lower(t), al) AND al <> '' UNION ALL SELECT t, company_id, company FROM t JOIN enterprise_pool p ON t.t = p.company),
       f AS (SELECT t, arg_min(company, o) AS c FROM h GROUP BY t)
       SELECT row_id, coalesce(c, {_strip('company')}) AS company_norm FROM standard_events LEFT JOIN f ON company = t""",
)
def alias_match_first(spark: SparkSession, d: str) -> DataFrame:
    return lookups.first_alias_match(_std(spark, d).select("row_id", "company"), "company", table(spark, d, "enterprise_pool")).select("row_id", "company_norm")


@query(
    "domain_credibility",
    f"""WITH s AS (SELECT unnest(source) AS s FROM standard_events), u AS (SELECT DISTINCT s.url AS url, s.source_type AS source_type FROM s)
        SELECT source_type, {_cred('url', 'source_type')} AS credibility, count(*) AS n FROM u GROUP BY ALL""",
)
def domain_credibility(spark: SparkSession, d: str) -> DataFrame:
    urls = _std(spark, d).select(F.explode("source").alias("s")).select("s.url", "s.source_type").distinct()
    return urls.groupBy("source_type", web.credibility("url", "source_type").alias("credibility")).agg(F.count("*").alias("n"))


# ---- scores and classes -----------------------------------------------------------------------------------------
@query("accuracy_score", f"SELECT row_id, {_ACC} AS accuracy FROM standard_events")
def accuracy_score(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", records.accuracy(F.col("source")).alias("accuracy"))


_TAGC = lambda p: f"len(list_filter(coalesce(sub_tags, []), lambda t: regexp_matches(t, '{p}')))"
_HOT = "[" + ",".join(f"'{t}'" for t in records.HOT_TAGS) + "]"


@query(
    "importance_score",
    f"""SELECT row_id, least(5.0, floor(({_ACC} * 0.6 + least(1.0, coalesce(len(source),0) * 0.3) + len(list_filter(coalesce(sub_tags, []), lambda t: list_contains({_HOT}, t))) * 0.2
          + CASE {_CAT} WHEN 'opensource' THEN {_TAGC('(?i)star|fork|contributor|community')} WHEN 'paper' THEN {_TAGC('(?i)顶会|sota|热议|机构|影响力')} WHEN 'enterprise' THEN {_TAGC('(?i)投融资|战略|头部')} ELSE 0 END * 0.3
          - CASE WHEN {_DATED} THEN 0 ELSE 1.5 END) * 10 + 0.5) / 10) AS importance FROM standard_events""",
)
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return daily.scored(daily.standardise(_std(spark, d))).select("row_id", F.col("importance_score").alias("importance"))


def _count_sql(words: list[str], weight: int = 1) -> str:
    return " + ".join(f"(CASE WHEN contains(x, '{w}') THEN {weight} ELSE 0 END)" for w in words)


@query(
    "classify_rule",
    f"""WITH s AS (SELECT row_id, coalesce(title,'') || ' ' || coalesce(description,'') AS x FROM standard_events)
        SELECT row_id, CASE WHEN {_count_sql(records.INVESTMENT_WORDS)} + {' + '.join(f"(CASE WHEN regexp_matches(x, '(?i)\\b{w}\\b') THEN 2 ELSE 0 END)" for w in records.INVESTMENT_WORDS_EN)} > {_count_sql(records.PRODUCT_WORDS)}
               THEN 'investment' ELSE 'product' END AS kind FROM s""",
)
def classify_rule(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", records.classify("title", "description").alias("kind"))


@query("rule_filter", "SELECT row_id FROM standard_events WHERE NOT regexp_matches(lower(coalesce(title,'') || ' ' || coalesce(description,'')), '" + "|".join(records.AD_WORDS) + "') AND coalesce(len(source),0) > 0")
def rule_filter(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).where(records.passes_rules(F.col("title"), F.col("description"), F.col("source"))).select("row_id")


@query(
    "build_facts",
    """SELECT row_id, concat_ws('; ', CASE WHEN coalesce(company,'') <> '' THEN 'company=' || company END, CASE WHEN coalesce(product,'') <> '' THEN 'product=' || product END,
              'id=' || format('{:,}', row_id), CASE WHEN coalesce(sub_type,'') <> '' THEN 'kind=' || sub_type END) AS facts FROM standard_events""",
)
def build_facts(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", records.facts([("company", F.col("company")), ("product", F.col("product")), ("id", records.thousands(F.col("row_id"))), ("kind", F.col("sub_type"))]).alias("facts"))


# ---- scalars ----------------------------------------------------------------------------------------------------
_B = r"[\s\x{00A0}\x{3000}\x{FEFF}]+"


@query(
    "clean_text",
    rf"SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(description,''), '{_B}', ' ', 'g'), ' +([，。；：、！？）】」』])', '\1', 'g'), '([（【「『]) +', '\1', 'g')) AS cleaned FROM standard_events",
)
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", text.clean_text("description").alias("cleaned"))


@query("norm_dedup_key", f"SELECT row_id, {_KEY} AS key FROM standard_events")
def norm_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", text.dedup_key("title").alias("key"))


@query("flexible_date", f"SELECT row_id, {_DAY} AS day FROM standard_events")
def flexible_date(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", dates.flexible_date("time").alias("day"))


@query(
    "stable_id",
    f"""SELECT row_id, CASE WHEN coalesce(product,'') <> '' OR lower(trim(coalesce(title,''))) <> '' THEN 'evt_' || substr({_CAT},1,2) || '_' || substr(sha256({_CAT} || '|' || coalesce(product,'') || '|' || lower(trim(coalesce(title,'')))),1,12) END AS stable_id FROM standard_events""",
)
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", text.stable_id(F.lower(F.trim("module")), "product", "title").alias("stable_id"))


@query(
    "amount_wan",
    r"""WITH s AS (SELECT row_id, coalesce(title,'') || ' ' || coalesce(description,'') AS x FROM standard_events)
        SELECT row_id, CASE WHEN regexp_matches(x,'(\d+(?:\.\d+)?)\s*亿') THEN CAST(regexp_extract(x,'(\d+(?:\.\d+)?)\s*亿',1) AS DOUBLE)*10000
               WHEN regexp_matches(x,'(\d+(?:\.\d+)?)\s*万') THEN CAST(regexp_extract(x,'(\d+(?:\.\d+)?)\s*万',1) AS DOUBLE)
               WHEN regexp_matches(x,'(?i)\$\s*(\d+(?:\.\d+)?)\s*([MBK])') THEN floor(CAST(regexp_extract(x,'(?i)\$\s*(\d+(?:\.\d+)?)\s*([MBK])',1) AS DOUBLE)
                    * CASE upper(regexp_extract(x,'(?i)\$\s*(\d+(?:\.\d+)?)\s*([MBK])',2)) WHEN 'M' THEN 100.0 WHEN 'B' THEN 10000.0 ELSE 0.1 END * 7.2 + 0.5)
               WHEN regexp_matches(x,'(?i)(\d+(?:\.\d+)?)\s*(?:百万|M)\s*美元?') THEN floor(CAST(regexp_extract(x,'(?i)(\d+(?:\.\d+)?)\s*(?:百万|M)\s*美元?',1) AS DOUBLE)*100*7.2+0.5)
               WHEN regexp_matches(x,'(\d+(?:\.\d+)?)\s*千万\s*美元?') THEN floor(CAST(regexp_extract(x,'(\d+(?:\.\d+)?)\s*千万\s*美元?',1) AS DOUBLE)*1000*7.2+0.5)
               WHEN regexp_matches(x,'(\d+(?:\.\d+)?)\s*美元') THEN CAST(regexp_extract(x,'(\d+(?:\.\d+)?)\s*美元',1) AS DOUBLE) END AS wan FROM s""",
)
def amount_wan(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", records.amount_in_wan(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))).alias("wan"))


@query("url_host", r"SELECT row_id, lower(nullif(regexp_extract(coalesce(source[1].url,''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1), '')) AS host FROM standard_events")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", web.url_host(F.try_element_at("source", F.lit(1))["url"]).alias("host"))


@query(
    "url_date",
    r"""WITH u AS (SELECT row_id, coalesce(source[1].url,'') AS u FROM standard_events)
        SELECT row_id, TRY_CAST(CASE WHEN regexp_matches(u,'/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)') THEN regexp_extract(u,'/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)',1) || '-' || lpad(regexp_extract(u,'/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)',2),2,'0')
               || '-' || lpad(regexp_extract(u,'/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)',3),2,'0') END AS DATE) AS day FROM u""",
)
def url_date(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", dates.url_date(F.try_element_at("source", F.lit(1))["url"]).alias("day"))


@query("inverted_index_roundtrip", "SELECT item_id, text AS rebuilt FROM eval_items")
def inverted_index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", metrics.inverted_to_text(metrics.text_to_inverted(F.col("text")), None).alias("rebuilt"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", records.parse_json("props", "k bigint")["k"].alias("k"))


@query(
    "markdown_sections",
    r"""WITH l AS (SELECT doc_id, i AS line_no, string_split(replace(text, E'\r\n', E'\n'), E'\n')[i+1] AS line FROM documents, unnest(range(0, len(string_split(replace(text, E'\r\n', E'\n'), E'\n')))) AS t(i)),
       h AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '^##\s+(.+?)\s*$', 1), '') AS head, line FROM l),
       c AS (SELECT doc_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, line FROM h)
       SELECT doc_id, section, count(*) AS n FROM c WHERE line <> '' GROUP BY ALL""",
)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    marked = metrics.carry_section(lines, "doc_id", "line_no", F.nullif(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1), F.lit("")))
    return marked.where("line <> ''").groupBy("doc_id", "section").agg(F.count("*").alias("n"))


# ---- lookups ----------------------------------------------------------------------------------------------------
@query("paginate", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(table(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("recent_runs", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type")


@query("dynamic_filter", "SELECT row_id, event_id, CASE WHEN NOT isnan(importance_score) THEN importance_score END AS score FROM standard_events WHERE module = 'enterprise' AND status = 'reported'")
def dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = lookups.matching(_std(spark, d), module="enterprise", status="reported", time=None)
    rows = rows.select("row_id", "event_id", F.nanvl("importance_score", F.lit(None).cast("double")).alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), "row_id")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookups.matching(table(spark, d, "orders"), o_orderkey=7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("union_fallback", "SELECT s_suppkey AS k, 'main' AS origin FROM supplier WHERE s_acctbal > 1e9 UNION ALL SELECT c_custkey, 'fallback' FROM customer WHERE (SELECT count(*) FROM supplier WHERE s_acctbal > 1e9) < 5")
def union_fallback(spark: SparkSession, d: str) -> DataFrame:
    main = table(spark, d, "supplier").where("s_acctbal > 1e9").select(F.col("s_suppkey").alias("k"), F.lit("main").alias("origin"))
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("fallback").alias("origin"))
    return lookups.union_with_fallback(main, other, 5)


@query(
    "standardize_union",
    f"""SELECT 'standard_events' AS origin, {_CAT} AS category, count(*) AS n, count({_DAY}) AS dated FROM standard_events GROUP BY ALL
        UNION ALL SELECT 'enterprise_raw_events', {_CAT}, count(*), count({_DAY.replace('time', 'published_at')}) FROM enterprise_raw_events GROUP BY ALL""",
)
def standardize_union(spark: SparkSession, d: str) -> DataFrame:
    one = _std(spark, d).select(F.lit("standard_events").alias("origin"), "module", "time")
    two = table(spark, d, "enterprise_raw_events").select(F.lit("enterprise_raw_events").alias("origin"), "module", F.col("published_at").alias("time"))
    both = one.unionByName(two).select("origin", F.lower(F.trim("module")).alias("category"), dates.flexible_date("time").alias("day"))
    return both.groupBy("origin", "category").agg(F.count("*").alias("n"), F.count("day").alias("dated"))


@query("report_picks")
def report_picks(spark: SparkSession, d: str) -> DataFrame:
    """The whole daily chain over the saved events, less what reports of earlier days had."""
    rows = _std(spark, d)
    picks = daily.report_picks(rows, AS_OF, daily.reported_keys(rows, AS_OF), pool=table(spark, d, "enterprise_pool"))
    return picks.select("category", "rank_no", "row_id", "title", "importance_score")
