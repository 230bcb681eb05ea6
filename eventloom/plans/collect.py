"""Collectors as compositions of readers: what the sources delivered, merged, ordered, and standardised by module.

Readers and caches are handed in; fetching is not their business. A fallback is only read when what comes before is too little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import flexible_date
from eventloom.functions.records import scored_sources, title_from_description
from eventloom.functions.reports import financing_or_product
from eventloom.functions.text import clean_text, col, stable_id
from eventloom.operators import clusters, lookups, merge, ranking

Source = Callable[[], DataFrame]

# Headlines that are no events of the domain (stock markets, job hunting, hiring, collections).
NOISE = [
    "恒指|恒生指数|上证|深证|创业板|A股|港股|美股|开盘|收盘|涨跌幅|涨幅|跌幅|涨停|跌停|股指|大盘|行情|股价|市值蒸发|盘中",
    "面经|秋招|春招|校招|社招|内推|offer|笔试|面试|简历|hr|hrbp",
    "招聘|招人|扩招|裁员|降薪|年终奖",
    "AI设计日报|AI 设计日报|每日精选|今日精选|合集|盘点|top10|top 10|榜单",
]
# Organisations outside the pool, in the order in which they are tried, and aliases that tell too little.
KNOWN_ORGANISATIONS = [
    "hugging face", "huggingface", "stability ai", "stability", "mistral", "cohere", "x ai", "xai", "perplexity", "nvidia", "英伟达", "microsoft", "微软", "amazon", "亚马逊", "apple", "苹果", "tesla", "特斯拉",
    "meta", "百度", "华为", "小米", "京东", "美团", "字节跳动",
]
LOW_ALIASES = ("seed", "阿里", "facebook")
# A headline's subject before what it does.
_SUBJECT_EN = r"([A-Z][A-Za-z0-9&\-]+(?:\s+[A-Z][A-Za-z0-9&\-]+){0,2})\s+(?:raises?|secured?|gets?|lands?|closes?|acquires?|acquisition|reaches|valued|launches|unveils?|debuts?|backs?|backing|banks?|rolls?)"
_SUBJECT_ZH = r"^([\x{4e00}-\x{9fa5}A-Za-z0-9]{2,20}?)(?:完成|宣布|获得|启动|发布|推出)"


def in_order(frames: list[DataFrame]) -> DataFrame:
    """All rows with ``seq``, numbers that rise in the order of the frames and of their rows."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumn("seq", F.monotonically_increasing_id())


def open_source(tracks: list[DataFrame], alternatives: list[Source], order_seq: bool = True) -> DataFrame:
    """Repositories of all tracks, or where they give none of the first alternative that gives some (other listings, a search,
    a cache); one row for each URL with the evidence of all, most stars first."""
    found = lookups.first_non_empty([lambda: in_order(tracks), *[lambda a=a: in_order([a()]) for a in alternatives]])
    one = merge.merge_by_url(found, "repo_url", "stars", "seq", "description", "tech_tags", "source_urls")
    rest = [c for c in found.columns if c not in one.columns]
    first = found.select("seq", *rest)
    return one.join(first, "seq").orderBy(F.desc("stars"), "seq") if order_seq else one.join(first, "seq")


def noise(title: Column | str) -> Column:
    """Whether a headline is none of an event of the domain."""
    return F.coalesce(col(title), F.lit("")).rlike("(?i)" + "|".join(NOISE))


def pool_mentions(items: DataFrame, pool: DataFrame, most: int = 6) -> DataFrame:
    """Feed items (file, pos, title, snippet) about a company of the pool, with ``company``: the first in pool order with an alias
    in the text, if the title has one of its aliases too. Noise is dropped; the first ``most`` of each feed."""
    rows = items.where(~noise("title")).withColumn("_text", F.concat_ws(" ", "title", "snippet"))
    named = F.array_union(F.array("company"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = pool.select("company_id", "company", F.explode(F.transform(named, F.lower)).alias("_a")).where((F.length("_a") >= 2) & ~F.col("_a").isin(*LOW_ALIASES))
    hits = rows.join(lookups.broadcast_if_small(names), F.contains(F.lower("_text"), F.col("_a")))
    per = hits.groupBy("file", "pos", "company_id", "company").agg(F.bool_or(F.contains(F.lower("title"), F.col("_a"))).alias("_in_title"))
    first = Window.partitionBy("file", "pos").orderBy("company_id")
    of = per.withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) & F.col("_in_title")).select("file", "pos", "company")
    return ranking.top_n(rows.join(of, ["file", "pos"]).drop("_text"), ["file"], [F.col("pos")], most, "_n").drop("_n")


def recent_media(items: DataFrame, report_date: Column, signal: str, hours: int = 72, most: int = 14) -> DataFrame:
    """Dated feed items about the domain (``signal`` is a pattern for title and snippet), from ``hours`` before the report's noon on."""
    noon = F.timestamp_seconds(F.unix_seconds(report_date.cast("timestamp")) + 43_200)
    age = (F.unix_seconds(noon) - F.unix_seconds(F.col("published_at").try_cast("timestamp"))) / 3600
    kept = items.where(age.between(0, hours)).where(~noise("title") & F.concat_ws(" ", "title", "snippet").rlike(signal))
    return kept.orderBy("file", "pos").limit(most)


def resolve_company(df: DataFrame, uid: str, title: str, text: str, pool: DataFrame) -> DataFrame:
    """``df`` with ``company_found``: the first company in pool order with a name of two characters or more in title or text; else
    a known organisation in them; else the subject of an English, then of a Chinese headline; else ''."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    names = pool.select("company_id", "company", F.explode(F.concat(F.array("company"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a"))
    names = lookups.broadcast_if_small(names.select("company_id", "company", F.lower("_a").alias("_a")).where(F.length("_a") >= 2))
    hits = df.select(uid, whole.alias("_w")).join(names, F.contains("_w", "_a")).groupBy(uid).agg(F.min_by("company", "company_id").alias("_pool"))
    known = F.coalesce(*[F.when(F.contains(whole, F.lit(n)), F.lit(n[0].upper() + n[1:])) for n in KNOWN_ORGANISATIONS])
    subject = lambda p: F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), p, 1), F.lit(""))
    english = F.when(~subject(_SUBJECT_EN).isin("The", "This", "It"), subject(_SUBJECT_EN))
    return df.join(hits, uid, "left").withColumn("company_found", F.coalesce("_pool", known, english, subject(_SUBJECT_ZH), F.lit(""))).drop("_pool")


def enterprise(branches: list[DataFrame], run: Column, per_company: int = 2, alike: float = 0.85) -> DataFrame:
    """Company news of all branches (title, content, company, published_at, source_urls): classified, titles of a run at
    least ``alike`` merged into the first with the evidence of all, at most ``per_company`` of a named company, newest first."""
    rows = in_order(branches)
    of = financing_or_product(F.col("title"), F.col("content"))
    rows = rows.withColumn("_f", of).withColumn("sub_type", F.col("_f.sub_type")).withColumn("found", F.struct("_f.amount_wan", "_f.round", "_f.investors", "_f.product")).drop("_f")
    leaders = clusters.leader_clusters(rows.select(run.cast("string").alias("block"), "seq", "title"), "block", "seq", "title", "seq", alike)
    merged = merge.merge_leaders(rows.withColumnRenamed("source_urls", "source"), leaders, "seq").withColumnRenamed("source", "source_urls")
    return ranking.cap_per_key(merged, "company", [F.col("seq")], per_company).orderBy(F.desc_nulls_last("published_at"), "seq")


_EVENT = ("event_id", "title", "category", "sub_type", "sub_tags", "company", "product", "source", "time", "added_at", "description", "status")


def _finished(df: DataFrame, module: str, day: Column, key: Column) -> DataFrame:
    title = F.when(clean_text("title") != "", clean_text("title")).otherwise(F.lit("未命名事件"))
    rows = df.withColumns({"category": F.lit(module), "added_at": day.cast("string"), "status": F.lit("processed"), "source": scored_sources(F.col("source_urls")), "event_id": stable_id(F.lit(module), key, "title"), "_title": title})
    return rows.withColumn("title", F.col("_title")).select(*_EVENT)


def standard_repositories(raw: DataFrame, day: Column) -> DataFrame:
    """Repositories as events: named by their own first clause, never as an update that nobody stated."""
    told = clean_text("description")
    title = title_from_description(F.col("project_name"), F.col("description"))
    rows = raw.withColumns({
        "title": title, "_d": F.when(told != "", told).otherwise(F.concat("project_name", F.lit("（"), F.coalesce("owner", F.lit("")), F.lit("）近期活跃更新"))), "time": flexible_date("updated_at"), "company": F.col("owner"),
        "product": F.col("project_name"), "sub_tags": F.coalesce("tech_tags", F.array().cast("array<string>")), "sub_type": F.lit(None).cast("string"),
    })
    return _finished(rows.withColumn("description", F.col("_d")), "opensource", day, F.coalesce("repo_url", F.lit("")))


def standard_papers(raw: DataFrame, day: Column) -> DataFrame:
    """Papers as events, abstracts cut to 1,500 characters as the values to match have them."""
    rows = raw.withColumns({
        "description": F.substring(clean_text("abstract"), 1, 1500), "time": flexible_date("published_at"), "company": F.col("institution"), "product": F.col("paper_id"), "sub_tags": F.array("category"),
        "sub_type": F.lit(None).cast("string"),
    })
    return _finished(rows, "paper", day, F.coalesce("paper_id", F.lit("")))


def standard_company_news(raw: DataFrame, day: Column, pool: DataFrame) -> DataFrame:
    """Company news as events, companies named as in the pool, keyed by their first source."""
    named = lookups.first_alias_match(raw, "company", pool)
    rows = named.withColumns({
        "description": clean_text("content"), "time": flexible_date("published_at"), "company": F.col("company_norm"), "product": F.nullif(F.try_element_at("fields", F.lit("product")), F.lit("")),
        "sub_tags": F.array(F.when(F.col("sub_type") == "investment", F.lit("投融资")).otherwise(F.lit("产品战略"))),
    })
    return _finished(rows, "enterprise", day, F.coalesce(F.try_element_at("source_urls", F.lit(1))["url"], F.lit("")))


def quality_violations(report: DataFrame, events: DataFrame, sections: DataFrame) -> DataFrame:
    """(issue): what a report lacks. ``report`` is one row (date, summary, future_watch, markdown), ``events`` (section, title,
    source), ``sections`` (module, n, note)."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    of = lambda df, cond, text: df.where(cond).select(text.alias("issue"))
    unsourced = events.where(~F.coalesce(F.exists("source", lambda s: F.coalesce(s["url"], F.lit("")) != ""), F.lit(False))).groupBy("section").agg(F.min("title").alias("title"))
    checks = [
        of(report, empty(F.col("summary")) | empty(F.col("future_watch")), F.lit("summary/future_watch 缺失")),
        of(unsourced, F.lit(True), F.concat(F.lit("事件无来源: "), F.coalesce("title", F.lit("")))),
        of(report, F.col("markdown").rlike(r"\{\{|\}\}|TODO|TBD"), F.lit("存在占位符")),
        of(report, ~F.contains(F.coalesce("markdown", F.lit("")), F.col("date").cast("string")), F.lit("日报日期缺失")),
        of(sections, (F.col("n") == 0) & empty(F.col("note")), F.concat(F.lit("模块 "), F.col("module"), F.lit(" 无标注"))),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def with_defaults(report: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report and its sections with what they may lack filled in."""
    watch = F.when(F.coalesce("future_watch", F.lit("")) == "", F.lit("建议持续关注入选事件主体的后续动态。")).otherwise(F.col("future_watch"))
    note = F.when((F.col("n") == 0) & (F.coalesce("note", F.lit("")) == ""), F.lit("今日无重大动态")).otherwise(F.col("note"))
    return report.withColumn("future_watch", watch), sections.withColumn("note", note)


def narrative(sections: DataFrame, date: str) -> DataFrame:
    """(summary, total): how many events a report has, by module in the order of ``ord``."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("ord", F.concat(F.col("module"), F.lit(" "), F.col("n").cast("string"), F.lit(" 条")).alias("t"))))), lambda x: x["t"]), "，")
    total = F.coalesce(F.sum("n"), F.lit(0))
    some = F.concat(F.lit(f"今日 {date} 共收录 "), total.cast("string"), F.lit(" 条 AI 行业高价值动态："), listed, F.lit("。整体来看，开源生态与学术研究保持活跃，企业端以产品与战略动态为主。"))
    none = F.lit(f"今日 {date} 未采集到重大 AI 行业动态，各模块均标注「今日无重大动态」。")
    return sections.agg(F.when(total == 0, none).otherwise(some).alias("summary"), total.alias("total"))
