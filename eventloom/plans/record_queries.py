"""Queries of the operators on single records and of listings over them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import dates, records, reports, text, web
from eventloom.operators import lookups, merge, ranking
from eventloom.plans import collect
from eventloom.plans.reference_queries import _ACC, _B, _CAT, _DAY, _KEY, AS_OF, _cred, _std, _strip, query
from eventloom.session import table

_HAN = r"\x{4e00}-\x{9fa5}"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x},''), '{_B}', ' ', 'g'), ' +([，。；：、！？）】」』])', '\1', 'g'), '([（【「『]) +', '\1', 'g'))"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enterprise_raw_events")


def _quoted(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---- standardising and collecting ---------------------------------------------------------------------------------
_NAMED = f"""a AS (SELECT company_id AS o, company, lower(unnest(aliases)) AS al FROM enterprise_pool), t AS (SELECT DISTINCT company AS t FROM enterprise_raw_events WHERE company IS NOT NULL),
       h AS (SELECT t, o, a.company FROM t JOIN a ON contains(lower(t), al) AND al <> '' UNION ALL SELECT t, company_id, company FROM t JOIN enterprise_pool p ON t.t = p.company),
       f AS (SELECT t, arg_min(company, o) AS c FROM h GROUP BY t)"""


@query(
    "standardize_enterprise",
    f"""WITH {_NAMED}, r AS (SELECT raw_id, title, {_clean('title')} AS clean, {_clean('content')} AS description, {_DAY.replace('time', 'published_at')} AS day, coalesce(c, {_strip('company')}) AS company_norm, sub_type,
                   coalesce(source_urls[1].url, '') AS pk, nullif(fields['product'], '') AS product,
                   array_to_string(list_transform(source_urls, lambda s: coalesce(s.url,'') || '=' || CAST(coalesce(s.credibility_score, {_cred('s.url', 's.source_type')}) AS VARCHAR)), ' ') AS evidence
              FROM enterprise_raw_events LEFT JOIN f ON enterprise_raw_events.company = t)
        SELECT CASE WHEN pk <> '' OR lower(trim(coalesce(title,''))) <> '' THEN 'evt_en_' || substr(sha256('enterprise|' || pk || '|' || lower(trim(coalesce(title,'')))), 1, 12) END AS event_id,
               CASE WHEN clean <> '' THEN clean ELSE '未命名事件' END AS title, description, day AS time, company_norm AS company, product, CASE WHEN sub_type = 'investment' THEN '投融资' ELSE '产品战略' END AS tag, coalesce(evidence,'') AS evidence FROM r""",
)
def standardize_enterprise(spark: SparkSession, d: str) -> DataFrame:
    out = collect.standard_company_news(_raw(spark, d), F.lit(AS_OF), table(spark, d, "enterprise_pool"))
    evidence = F.array_join(F.transform("source", lambda s: F.concat(F.coalesce(s["url"], F.lit("")), F.lit("="), s["credibility_score"].cast("string"))), " ")
    return out.select("event_id", "title", "description", "time", "company", "product", F.col("sub_tags")[0].alias("tag"), evidence.alias("evidence"))


_X = "coalesce(title,'') || ' ' || coalesce(content,'')"
_KIND = (
    f"CASE WHEN {' + '.join(f'CAST(contains(x, {chr(39)}{w}{chr(39)}) AS INT)' for w in records.INVESTMENT_WORDS)} + 2 * ({' + '.join(f'CAST(regexp_matches(x, {chr(39)}(?i)' + chr(92) + f'b{w}' + chr(92) + f'b{chr(39)}) AS INT)' for w in records.INVESTMENT_WORDS_EN)})"
    f" > {' + '.join(f'CAST(contains(x, {chr(39)}{w}{chr(39)}) AS INT)' for w in records.PRODUCT_WORDS)} THEN 'investment' ELSE 'product' END"
)
_ROUND_SQL = reports._ROUND
_PRODUCT_SQL = reports._PRODUCT


def _amount_sql(x: str) -> str:
    yi, wan, usd = r"(\d+(?:\.\d+)?)\s*亿\s*(?:元)?(?:人民币)?", r"(\d+(?:\.\d+)?)\s*万\s*(?:元)?(?:人民币)?", r"(?i)\$\s*(\d+(?:\.\d+)?)\s*(M|B)"
    number = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN CAST(regexp_extract({x}, '{p}', 1) AS DOUBLE)" for p in (yi, wan, usd))
    return f"(CASE {number} END) * CASE WHEN contains({x}, '亿') THEN 10000.0 WHEN contains({x}, '万') THEN 1.0 WHEN upper(regexp_extract({x}, '{usd}', 2)) = 'B' THEN 10000.0 ELSE 100.0 END"


_BACKERS = "list_filter(list_transform(regexp_split_to_array(regexp_extract(x, '由(.{2,30}?)(?:领投|参投|投资|注资)', 1), '、|,|，|和|及'), lambda s: trim(s)), lambda s: s <> '')[1:5]"


@query(
    "classify_extract",
    f"""WITH s AS (SELECT raw_id, {_X} AS x FROM enterprise_raw_events), k AS (SELECT raw_id, x, {_KIND} AS sub_type FROM s)
        SELECT raw_id, sub_type, CASE WHEN sub_type = 'investment' THEN floor({_amount_sql('x')} + 0.5) END AS amount_wan, CASE WHEN sub_type = 'investment' THEN nullif(regexp_extract(x, '{_ROUND_SQL}', 1), '') END AS round,
               CASE WHEN sub_type = 'investment' THEN nullif(array_to_string({_BACKERS}, '/'), '') END AS investors, CASE WHEN sub_type = 'product' THEN nullif(regexp_extract(x, '{_PRODUCT_SQL}', 1), '') END AS product FROM k""",
)
def classify_extract(spark: SparkSession, d: str) -> DataFrame:
    f = reports.financing_or_product(F.col("title"), F.col("content"))
    return _raw(spark, d).select("raw_id", f.alias("f")).select("raw_id", "f.sub_type", "f.amount_wan", "f.round", F.array_join("f.investors", "/").alias("investors"), "f.product")


@query(
    "resolve_company",
    f"""WITH e AS (SELECT raw_id, coalesce(title,'') AS title, lower(coalesce(title,'') || ' ' || coalesce(content,'')) AS w FROM enterprise_raw_events),
       n AS (SELECT company_id, company, lower(unnest(list_concat([company], coalesce(aliases, [])))) AS al FROM enterprise_pool),
       p AS (SELECT raw_id, arg_min(company, company_id) AS c FROM e JOIN n ON length(al) >= 2 AND contains(w, al) GROUP BY raw_id)
       SELECT raw_id, coalesce(c, {", ".join(f"CASE WHEN contains(w, '{n}') THEN '{n[0].upper() + n[1:]}' END" for n in collect.KNOWN_ORGANISATIONS)},
              CASE WHEN regexp_extract(title, '{collect._SUBJECT_EN}', 1) NOT IN ('', 'The', 'This', 'It') THEN regexp_extract(title, '{collect._SUBJECT_EN}', 1) END, regexp_extract(title, '{collect._SUBJECT_ZH}', 1)) AS company_found
       FROM e LEFT JOIN p USING (raw_id)""",
)
def resolve_company(spark: SparkSession, d: str) -> DataFrame:
    return collect.resolve_company(_raw(spark, d), "raw_id", "title", "content", table(spark, d, "enterprise_pool")).select("raw_id", "company_found")


# ---- what a report says -----------------------------------------------------------------------------------------
def _by_module(words: dict[str, str]) -> str:
    return f"CASE {_CAT} WHEN 'opensource' THEN '{words['opensource']}' WHEN 'paper' THEN '{words['paper']}' ELSE '{words['other']}' END"


@query(
    "insight_rule",
    f"""SELECT row_id, substr('事件为「' || coalesce(title,'') || '」。' || substr({_clean('description')}, 1, 80), 1, 120) AS what,
               '该事件属于' || {_by_module(reports.FIELD)} || '领域的重要进展，主体为' || coalesce(nullif(company,''), '相关企业') || coalesce('（' || nullif(product,'') || '）', '') || '，对关注 AI 行业动态的受众具有参考价值。' AS why,
               '事件反映出 AI ' || {_by_module(reports.TREND)} || '仍在快速演进。' AS trend, '{reports.IMPACT}' AS impact, '{reports.ACTION}' AS action FROM standard_events""",
)
def insight_rule(spark: SparkSession, d: str) -> DataFrame:
    i = reports.insight(F.col("title"), F.col("description"), F.lower(F.trim("module")), F.col("company"), F.col("product"))
    return _std(spark, d).select("row_id", i.alias("i")).select("row_id", "i.*")


@query(
    "importance_with_insight",
    f"""WITH t AS (SELECT t1.row_id, t1.acc FROM (SELECT row_id, {_ACC} AS acc FROM standard_events) t1)
        SELECT row_id, least(5.0, floor((acc * 0.6 + 0.6 + 0.3 - 0.0) * 10 + 0.5) / 10) AS importance FROM t""",
)
def importance_with_insight(spark: SparkSession, d: str) -> DataFrame:
    """Two dated sources, no tags, an insight: the accuracy's share and what these add."""
    none = F.array().cast("array<string>")
    two = F.array(*[F.struct(F.lit("u").alias("url"))] * 2)
    rows = _std(spark, d).select("row_id", records.accuracy(F.col("source")).alias("acc"))
    return rows.select("row_id", records.importance(F.col("acc"), two, none, F.lit("paper"), F.lit(True), F.lit(True)).alias("importance"))


@query(
    "rank_reason",
    f"""WITH s AS (SELECT row_id, {_ACC} AS a FROM standard_events), r AS (SELECT e.raw_id, '（事件数据：' || nullif(array_to_string(list_transform(list_filter(map_entries(e.fields), lambda x: coalesce(x.value,'') <> ''), lambda x: x.key || '=' || x.value), '，'), '') || '）' AS facts FROM enterprise_raw_events e)
        SELECT row_id, '综合评分 ' || regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || '（真实性 ' || regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || '）' || coalesce('；' || regexp_replace(facts, '[（）]', '', 'g'), '') AS zh,
               'Composite score ' || regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || ' (authenticity ' || regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || ')' || coalesce('; ' || regexp_replace(facts, '[（）]', '', 'g'), '') AS en
        FROM s LEFT JOIN r ON row_id = raw_id""",
)
def rank_reason(spark: SparkSession, d: str) -> DataFrame:
    facts = _raw(spark, d).select(F.col("raw_id").alias("row_id"), reports.field_facts(F.col("fields")).alias("facts"))
    rows = _std(spark, d).select("row_id", records.accuracy(F.col("source")).alias("a")).join(facts, "row_id", "left")
    return rows.select("row_id", reports.rank_reason(F.col("a"), F.col("a"), F.col("facts")).alias("r")).select("row_id", "r.*")


@query(
    "reflection_query",
    f"""WITH s AS (SELECT row_id, company, coalesce(title,'') AS title, list_filter(regexp_extract_all(coalesce(title,''), '(?i)[a-z0-9][a-z0-9-]*'), lambda w: NOT list_contains({_quoted(reports.QUERY_STOP_WORDS)}, lower(w)))[1:3] AS ws FROM standard_events),
        p AS (SELECT *, concat_ws(' ', CASE WHEN regexp_matches(coalesce(company,''), '[{_HAN}A-Za-z]') THEN company END, nullif(array_to_string(ws, ' '), '')) AS q FROM s)
        SELECT row_id, CASE WHEN q <> '' THEN q ELSE substr(title, 1, 40) END AS query FROM p""",
)
def reflection_query(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", reports.search_query(F.col("title"), F.col("company")).alias("query"))


@query(
    "venue_hint",
    f"""WITH s AS (SELECT row_id, coalesce(description,'') || CASE row_id % 4 WHEN 0 THEN ' Accepted by ICML 2026' WHEN 1 THEN ' accepted at the Turing Forum' WHEN 2 THEN ' state-of-the-art' ELSE '' END AS x FROM standard_events),
        v AS (SELECT *, trim(regexp_extract(x, '(?i)((?:{"|".join(reports.VENUES)})\\s*(?:20\\d{{2}}|''\\d{{2}})?)', 1)) AS known, regexp_extract(x, 'accepted\\s+(?:by|to|at|for|in)\\s+(?:(?:the|a)\\s+)?([A-Z][A-Za-z0-9+\\-.]{{2,}})', 1) AS named FROM s)
        SELECT row_id, CASE WHEN regexp_matches(x, '(?i)accept') THEN coalesce(coalesce(nullif(known,''), CASE WHEN lower(named) NOT IN ('appear','publication','proceedings','conference','journal','workshop','') THEN named END) || ' 录用', '顶会录用')
                            WHEN regexp_matches(x, '(?i)sota|state-of-the-art|state of the art') THEN '疑似 SOTA' END AS hint FROM v""",
)
def venue_hint(spark: SparkSession, d: str) -> DataFrame:
    """Hints from descriptions, to which comments of four kinds are added, since the tables have no comments."""
    kind = F.col("row_id") % 4
    more = F.when(kind == 0, F.lit(" Accepted by ICML 2026")).when(kind == 1, F.lit(" accepted at the Turing Forum")).when(kind == 2, F.lit(" state-of-the-art")).otherwise(F.lit(""))
    return _std(spark, d).select("row_id", reports.influence_hint(F.concat(F.coalesce("description", F.lit("")), more)).alias("hint"))


@query(
    "field_facts",
    """WITH s AS (SELECT raw_id, array_to_string(list_transform(list_filter(map_entries(fields), lambda x: coalesce(x.value,'') <> ''), lambda x: x.key || '=' || x.value), '，') AS j FROM enterprise_raw_events)
       SELECT raw_id, CASE WHEN coalesce(j,'') <> '' THEN '（事件数据：' || j || '）' ELSE '' END AS facts FROM s""",
)
def field_facts(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("raw_id", reports.field_facts(F.col("fields")).alias("facts"))


@query(
    "comment_filter",
    """WITH s AS (SELECT row_id, trim(CASE row_id % 3 WHEN 0 THEN '事件为「' || coalesce(title,'') WHEN 1 THEN substr(coalesce(description,''), 1, 60) ELSE coalesce(title,'') END) AS c, trim(coalesce(description,'')) AS b FROM standard_events)
       SELECT row_id, CASE WHEN c = '' OR starts_with(c, '事件为「') OR (b <> '' AND starts_with(b, substr(c, 1, 50))) THEN '' ELSE c END AS shown FROM s""",
)
def comment_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("row_id") % 3
    c = F.trim(F.when(kind == 0, F.concat(F.lit("事件为「"), F.coalesce("title", F.lit("")))).when(kind == 1, F.substring(F.coalesce("description", F.lit("")), 1, 60)).otherwise(F.coalesce("title", F.lit(""))))
    return _std(spark, d).select("row_id", reports.comment_shown(c, F.col("description")).alias("shown"))


@query(
    "insight_lines",
    f"""WITH s AS (SELECT row_id, list_filter([trim(coalesce(title,'')), trim(coalesce(description,'')), trim(coalesce(category,''))], lambda x: regexp_matches(x, '[{_HAN}]')) AS p FROM standard_events)
        SELECT row_id, CASE WHEN len(p) > 0 THEN substr(array_to_string(p, '；'), 1, 300) END AS line FROM s""",
)
def insight_lines(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", reports.insight_summary(F.col("title"), F.col("description"), F.col("category")).alias("line"))


@query(
    "narrative",
    f"""WITH m AS (SELECT * FROM (VALUES ('paper',0),('opensource',1),('enterprise',2),('policy',3)) AS m(module, ord)), c AS (SELECT {_CAT} AS module, count(*) AS n FROM standard_events WHERE status = 'reported' GROUP BY 1),
        s AS (SELECT m.module, ord, coalesce(n,0) AS n FROM m LEFT JOIN c USING (module))
        SELECT CASE WHEN sum(n) = 0 THEN '今日 {AS_OF} 未采集到重大 AI 行业动态，各模块均标注「今日无重大动态」。' ELSE '今日 {AS_OF} 共收录 ' || CAST(sum(n) AS BIGINT) || ' 条 AI 行业高价值动态：' || string_agg(module || ' ' || n || ' 条', '，' ORDER BY ord) FILTER (n > 0)
               || '。整体来看，开源生态与学术研究保持活跃，企业端以产品与战略动态为主。' END AS summary, CAST(sum(n) AS BIGINT) AS total FROM s""",
)
def narrative(spark: SparkSession, d: str) -> DataFrame:
    picks = _std(spark, d).where("status = 'reported'").select(F.lower(F.trim("module")).alias("module"))
    return collect.narrative(lookups.sections(["paper", "opensource", "enterprise", "policy"], picks), AS_OF)


@query(
    "quality_violations",
    f"""WITH e AS (SELECT {_CAT} AS section, title, source FROM standard_events WHERE status = 'reported'),
        u AS (SELECT section, min(title) AS title FROM e WHERE NOT coalesce(len(list_filter(source, lambda s: coalesce(s.url,'') <> '')) > 0, false) GROUP BY section)
        SELECT 'summary/future_watch 缺失' AS issue UNION ALL SELECT '事件无来源: ' || coalesce(title,'') FROM u UNION ALL SELECT '存在占位符' UNION ALL SELECT '日报日期缺失'
        UNION ALL SELECT '模块 ' || m || ' 无标注' FROM (VALUES ('policy')) AS x(m)""",
)
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every violation once: a report without outlook and date and with a placeholder, an empty section without note."""
    report = spark.range(1).select(F.lit(AS_OF).alias("date"), F.lit("s").alias("summary"), F.lit("").alias("future_watch"), F.lit("TBD").alias("markdown"))
    events = _std(spark, d).where("status = 'reported'").select(F.lower(F.trim("module")).alias("section"), "title", "source")
    parts = lookups.sections(["policy"], events.select(F.col("section").alias("module"))).withColumn("note", F.lit(None).cast("string"))
    return collect.quality_violations(report, events, parts)


# ---- texts ------------------------------------------------------------------------------------------------------
@query(
    "core_noun",
    f"""WITH s AS (SELECT row_id, coalesce(title,'') AS title, regexp_extract_all(lower(coalesce(title,'')), '[a-z0-9][a-z0-9-]*') AS ws FROM standard_events),
        w AS (SELECT row_id, i, k, array_to_string(ws[i:i+k-1], ' ') AS t FROM s, range(1, 400) AS a(i), range(2, 6) AS b(k) WHERE i + k - 1 <= len(ws) AND NOT list_contains({_quoted(text.NOUN_STOP_WORDS)}, ws[i])),
        l AS (SELECT row_id, t FROM w QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(t) DESC, i, k) = 1),
        h AS (SELECT row_id, t FROM (SELECT row_id, unnest(regexp_extract_all(title, '[{_HAN}]{{2,}}')) AS t, generate_subscripts(regexp_extract_all(title, '[{_HAN}]{{2,}}'), 1) AS i FROM s) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(t) DESC, i) = 1)
        SELECT s.row_id, CASE WHEN length(coalesce(l.t,'')) >= 6 THEN l.t WHEN length(coalesce(h.t,'')) >= 2 THEN h.t ELSE coalesce(l.t,'') END AS noun FROM s LEFT JOIN l USING (row_id) LEFT JOIN h ON h.row_id = s.row_id""",
)
def core_noun(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", text.core_noun("title").alias("noun"))


def _strip_sql(x: str, rounds: int = 3) -> str:
    for _ in range(rounds):
        x = f"regexp_replace(regexp_replace({x}, '<!\\[CDATA\\[|\\]\\]>', '', 'g'), '<[^>]+>', ' ', 'g')"
        for name, char in web._ENTITIES:
            x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
        x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim({x})"


@query("strip_tags", f"SELECT row_id, {_strip_sql('coalesce(description, chr(32))')} AS plain FROM standard_events")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tables' entities are wrapped once at most, so three rounds are all that the SQL needs."""
    return _std(spark, d).select("row_id", web.strip_tags("description").alias("plain"))


_TOKENS = r"'\d+(?:[.,]\d+)?(?:万|亿|%|％|k|m|K|M)?'"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_WITH_UNIT = _DIGITS + " || lower(regexp_extract({0}, '(万|亿|%|％|k|m|K|M)$', 1))"


@query(
    "number_traceability",
    f"""WITH s AS (SELECT row_id, regexp_extract_all(coalesce(title,''), {_TOKENS}) AS ts, regexp_extract_all(coalesce(description,''), {_TOKENS}) AS ds, list_transform(regexp_extract_all(coalesce(description,''), '\\d+[.,]\\d+'), lambda t: replace(t, ',', '.')) AS plain FROM standard_events),
        a AS (SELECT row_id, ts, list_concat(ds, list_transform(ds, lambda t: {_DIGITS.format('t')}), list_transform(ds, lambda t: {_WITH_UNIT.format('t')}), plain) AS ok FROM s),
        b AS (SELECT row_id, list_filter(ts, lambda t: NOT (list_contains(ok, t) OR list_contains(ok, {_DIGITS.format('t')}) OR list_contains(ok, {_WITH_UNIT.format('t')}) OR list_contains(ok, replace(t, ',', '.')))) AS bad FROM a)
        SELECT row_id, CAST(len(bad) AS INTEGER) AS n_bad, array_to_string(bad, ' ') AS bad FROM b""",
)
def number_traceability(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of titles that the descriptions do not have."""
    rows = _std(spark, d).select("row_id", text.untraceable_numbers("title", text.allowed_numbers("description")).alias("bad"))
    return rows.select("row_id", F.size("bad").alias("n_bad"), F.array_join("bad", " ").alias("bad"))


_STAR = r"(?i)(\d+(?:\.\d+)?)\s*[k万]?\s*star"


@query(
    "extract_entities",
    f"""WITH s AS (SELECT row_id, concat_ws(' ', title, description) AS x FROM standard_events)
        SELECT row_id, {_amount_sql('x')} AS amount, nullif(regexp_extract(x, '{records._ROUNDS}', 1), '') AS round, nullif(array_to_string({_BACKERS}, '/'), '') AS investors,
               CASE WHEN regexp_matches(x, '{_STAR}') THEN CAST(regexp_extract(x, '{_STAR}', 1) AS DOUBLE) * CASE WHEN contains(lower(x), 'k star') THEN 1000 ELSE 1 END * CASE WHEN regexp_matches(x, '万 ?star') THEN 10000 ELSE 1 END END AS star_count,
               nullif(array_to_string(list_filter({_quoted(records.TECH_TAGS)}, lambda t: contains(x, t)), '/'), '') AS tech_tags FROM s""",
)
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).select("row_id", records.extract_entities(F.concat_ws(" ", "title", "description")).alias("e")).select("row_id", "e.*")
    return rows.withColumns({"investors": F.array_join("investors", "/"), "tech_tags": F.array_join("tech_tags", "/")})


@query(
    "scalar_helpers",
    rf"""SELECT row_id, CASE WHEN length(coalesce(title,'')) > 20 THEN substr(title, 1, 20) || '…' ELSE coalesce(title,'') END AS cut, CAST(nullif(regexp_extract(replace(coalesce(title,''), ',', ''), '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number,
               regexp_replace(coalesce(title,''), '[^A-Za-z0-9._-]', '_', 'g') AS file_key, regexp_replace(coalesce(title,''), '\s+-\s+[^-]+$', '') AS headline, regexp_matches(coalesce(title,''), '[{_HAN}]') AS han,
               CASE WHEN coalesce(title,'') = '' THEN 0.0 ELSE length(regexp_replace(title, '[^{_HAN}]', '', 'g')) / length(title) END AS han_share,
               replace(replace(replace(replace(coalesce(title,''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, CASE WHEN accuracy_score >= 5 OR isnan(accuracy_score) THEN 'S' WHEN accuracy_score >= 4.5 THEN 'A' WHEN accuracy_score >= 4 THEN 'B' WHEN accuracy_score >= 3 THEN 'C' ELSE 'D' END AS level,
               CASE WHEN row_id * 10 + 3 >= 10000 THEN printf('%.2f', (row_id * 10 + 3) / 10000.0) || '亿元' ELSE CAST(row_id * 10 + 3 AS VARCHAR) || '万元' END AS money, 'report_' || replace(added_at, '-', '') AS report,
               regexp_replace(lower(coalesce(product,'')), '^arxiv:', '') AS paper, trim(regexp_replace(lower(coalesce(title,'')), '[^a-z0-9{_HAN}]+', ' ', 'g')) AS paper_title FROM standard_events""",
)
def scalar_helpers(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select(
        "row_id", text.truncate("title", 20).alias("cut"), text.first_number("title").alias("number"), text.safe_key("title").alias("file_key"), web.strip_publisher("title").alias("headline"), text.has_han("title").alias("han"),
        text.han_ratio("title").alias("han_share"), text.escape_html("title").alias("html"), web.credibility_level(F.col("accuracy_score")).alias("level"), records.format_wan((F.col("row_id") * 10 + 3).cast("double")).alias("money"),
        text.report_id("added_at").alias("report"), reports.paper_key(F.col("product")).alias("paper"), reports.paper_title_key(F.col("title")).alias("paper_title"),
    )


# ---- listings, lookups, state -----------------------------------------------------------------------------------
@query("report_count", "SELECT count(*) AS n, count(DISTINCT added_at) AS days FROM standard_events WHERE status = 'reported'")
def report_count(spark: SparkSession, d: str) -> DataFrame:
    return lookups.matching(_std(spark, d), status="reported").agg(F.count("*").alias("n"), F.countDistinct("added_at").alias("days"))


@query("pool_decode", "SELECT company_id, company, CAST(len(aliases) AS INTEGER) AS n_aliases, array_to_string(aliases, '|') AS aliases, array_to_string(official_sources, '|') AS sources FROM enterprise_pool")
def pool_decode(spark: SparkSession, d: str) -> DataFrame:
    """The pool as it is stored, arrays as JSON text, and decoded again."""
    stored = table(spark, d, "enterprise_pool").select("company_id", "company", F.to_json("aliases").alias("aliases"), F.to_json("official_sources").alias("sources"))
    read = stored.select("company_id", "company", *[F.from_json(c, "array<string>").alias(c) for c in ("aliases", "sources")])
    return read.select("company_id", "company", F.size("aliases").alias("n_aliases"), F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"))


@query("health_listing", "SELECT user_id AS source_key, max(ts) AS updated_at, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def health_listing(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").groupBy(F.col("user_id").alias("source_key")).agg(F.max("ts").alias("updated_at"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return ev.orderBy(F.desc("updated_at"), "source_key")


@query("events_by_time", f"SELECT row_id, {_DAY} AS day FROM standard_events ORDER BY day DESC NULLS LAST, row_id LIMIT 200")
def events_by_time(spark: SparkSession, d: str) -> DataFrame:
    return _std(spark, d).select("row_id", dates.flexible_date("time").alias("day")).orderBy(F.desc_nulls_last("day"), "row_id").limit(200)


@query(
    "derive_status",
    f"""WITH r AS (SELECT row_id, title, description, source, importance_score AS i FROM standard_events), k AS (SELECT row_id FROM r WHERE i IS NOT NULL AND NOT isnan(i) ORDER BY i DESC, row_id LIMIT 100)
        SELECT row_id, CASE WHEN regexp_matches(lower(coalesce(title,'') || ' ' || coalesce(description,'')), '{"|".join(records.AD_WORDS)}') OR coalesce(len(source),0) = 0 THEN 'dropped' WHEN row_id IN (SELECT row_id FROM k) THEN 'reported' ELSE 'evaluated' END AS derived FROM r""",
)
def derive_status(spark: SparkSession, d: str) -> DataFrame:
    """The status that the plan gives a record, rather than an update of it: dropped by the rules, among the best hundred, or evaluated."""
    rows = _std(spark, d)
    scored = rows.where(F.col("importance_score").isNotNull() & ~F.isnan("importance_score"))
    best = ranking.candidate_cut(scored.select("row_id", "importance_score"), [F.desc("importance_score"), F.col("row_id")], 50).select("row_id", F.lit(True).alias("_best"))
    passed = records.passes_rules(F.col("title"), F.col("description"), F.col("source"))
    return rows.join(F.broadcast(best), "row_id", "left").select("row_id", F.when(~passed, "dropped").when(F.col("_best"), "reported").otherwise("evaluated").alias("derived"))


def _feedback(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Feedback as stored and as filed, made from two stretches of the events that overlap."""
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id"), F.col("event_type").alias("problem"), F.col("ts").alias("created_at"), F.round("value", 3).alias("human_score"))
    stored, filed = rows.where("event_id % 3 < 2").drop("event_id"), rows.where("event_id % 3 > 0").withColumn("problem", F.lit("filed")).drop("event_id")
    return stored, filed


@query(
    "feedback_merge",
    "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 > 0 THEN 'filed' ELSE event_type END AS problem, ts AS created_at, round(value, 3) AS human_score FROM events",
)
def feedback_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_feedback(*_feedback(spark, d))


@query(
    "feedback_append",
    "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id = 5 THEN 'anew' ELSE event_type END AS problem FROM events WHERE event_id % 3 < 2 UNION ALL SELECT '5', 'anew' WHERE (SELECT count(*) FROM events WHERE event_id = 5 AND event_id % 3 < 2) = 0",
)
def feedback_append(spark: SparkSession, d: str) -> DataFrame:
    """Feedback with the record of one id in place of the one that is there."""
    stored, _ = _feedback(spark, d)
    one = table(spark, d, "events").where("event_id = 5").select(F.lit("5").alias("id"), F.lit("anew").alias("problem"), F.col("ts").alias("created_at"), F.round("value", 3).alias("human_score"))
    return merge.append_or_replace(stored, one).select("id", "problem")


@query(
    "feedback_event_lookup",
    """WITH l AS (SELECT event_id, importance_score AS i, status, added_at FROM standard_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY row_id DESC) = 1),
       f AS (SELECT row_id AS id, CASE WHEN row_id % 5 = 0 THEN 'unknown' ELSE event_id END AS event_id FROM standard_events)
       SELECT id, CASE WHEN l.i IS NULL OR isnan(l.i) THEN 0.0 ELSE l.i END AS agent_score, CASE WHEN status = 'reported' THEN 'report_' || replace(coalesce(added_at,''), '-', '') ELSE 'stated' END AS report_id FROM f LEFT JOIN l USING (event_id)""",
)
def feedback_event_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d)
    given = rows.select(F.col("row_id").alias("id"), F.when(F.col("row_id") % 5 == 0, F.lit("unknown")).otherwise(F.col("event_id")).alias("event_id"), F.lit("stated").alias("report_id"))
    return merge.feedback_with_event(given, rows).select("id", "agent_score", "report_id")


@query(
    "dashboard_scalars",
    f"""SELECT count(*) AS n_events, count(*) FILTER (status = 'reported') AS n_reported, count(DISTINCT {_CAT}) AS n_modules, floor(100.0 * count(*) FILTER (status = 'reported') / count(*) * 10 + 0.5) / 10 AS done_percent FROM standard_events""",
)
def dashboard_scalars(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("status") == "reported")
    return _std(spark, d).agg(F.count("*").alias("n_events"), done.alias("n_reported"), F.countDistinct(F.lower(F.trim("module"))).alias("n_modules"), records.half_up(100.0 * done / F.count("*"), 1).alias("done_percent"))


@query(
    "new_hosts",
    r"""WITH s AS (SELECT row_id, list_transform(coalesce(source, []), lambda s: coalesce(nullif(lower(regexp_extract(coalesce(s.url,''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)), ''), s.url, '')) AS hosts FROM standard_events)
        SELECT row_id, CAST(least(len(hosts), 1) + len(list_filter(hosts[2:], lambda h: h <> '' AND h <> hosts[1])) AS INTEGER) AS n FROM s""",
)
def new_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The first piece of evidence with those of the others whose host it does not have."""
    src = F.coalesce("source", F.array().cast(merge.EVIDENCE))
    return _std(spark, d).select("row_id", F.size(merge.add_new_hosts(F.slice(src, 1, 1), F.slice(src, 2, F.greatest(F.size(src), F.lit(1))))).alias("n"))


@query(
    "corroborate",
    """WITH s AS (SELECT row_id, coalesce(source, []) AS src FROM standard_events), h AS (SELECT event_id AS row_id, i, 'https://hit.example/' || (event_id + i) AS url FROM events, range(0, 5) AS r(i)),
       g AS (SELECT row_id, i, url, row_number() OVER (PARTITION BY row_id ORDER BY i) AS r FROM h WHERE i % 2 = 0), m AS (SELECT row_id, count(*) AS n FROM g WHERE r <= 3 GROUP BY row_id)
       SELECT row_id, CAST(len(src) + coalesce(n,0) AS INTEGER) AS n FROM s LEFT JOIN m USING (row_id)""",
)
def corroborate(spark: SparkSession, d: str) -> DataFrame:
    """Search hits made up for the records of some ids: every other one is credible, three at most are added."""
    hits = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    evidence = F.struct(F.concat(F.lit("https://hit.example/"), (F.col("row_id") + F.col("ord")).cast("string")).alias("url"), F.lit("search").alias("source_type"), F.lit("hit").alias("name"), F.when(F.col("ord") % 2 == 0, 4.5).otherwise(2.0).alias("credibility_score"), F.lit(None).cast("string").alias("published_at"))
    rows = _std(spark, d).select("row_id", F.coalesce("source", F.array().cast(merge.EVIDENCE)).alias("source"))
    return lookups.corroborate(rows, hits.select("row_id", "ord", evidence.alias("evidence")), "row_id", "source").select("row_id", F.size("source").alias("n"))


@query(
    "cache_staleness",
    f"SELECT raw_id, (epoch(TIMESTAMPTZ '{AS_OF} 00:00:00+00') - floor(epoch(fetched_at))) > 36 * 3600 AS stale, CAST(coalesce(len(source_urls),0) + 1 AS INTEGER) AS n, concat_ws(' ', title, '(cached)') AS title FROM enterprise_raw_events WHERE source_urls IS NOT NULL",
)
def cache_staleness(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw(spark, d).where("source_urls is not null").select("raw_id", "title", "source_urls", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    old = lookups.with_staleness(rows, "fetched_at", F.lit(AS_OF).cast("timestamp"), 36)
    return lookups.mark_stale(old, "source_urls", "title").select("raw_id", "stale", F.size("source_urls").alias("n"), "title")


@query("relaxed_filter", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def relaxed_filter(spark: SparkSession, d: str) -> DataFrame:
    return lookups.relaxing(table(spark, d, "supplier"), F.col("s_acctbal") > 1e9, F.col("s_acctbal") > 5000).select("s_suppkey")


@query(
    "merge_evidence_by_key",
    f"""WITH s AS (SELECT row_id, {_KEY} AS k, source FROM standard_events), f AS (SELECT k, row_id, i, source[i] AS s FROM s, unnest(range(1, len(source)+1)) AS t(i) WHERE k <> ''),
        u AS (SELECT k, s.url AS url, min(row(row_id, i)) AS first_at, arg_max(s.name, row(row_id, i)) AS name FROM f WHERE coalesce(s.url,'') <> '' GROUP BY k, s.url)
        SELECT k AS key, string_agg(url || '=' || coalesce(name,''), ' ' ORDER BY first_at) AS merged FROM u GROUP BY k""",
)
def merge_evidence_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d).select("row_id", F.nullif(text.dedup_key("title"), F.lit("")).alias("key"), "source")
    out = merge.evidence_by_key(rows, "key", "row_id", "source")
    return out.select("key", F.array_join(F.transform("source", lambda s: F.concat(s["url"], F.lit("="), F.coalesce(s["name"], F.lit("")))), " ").alias("merged"))



@query(
    "iso_dates",
    f"""SELECT row_id, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS moment, strftime(created_at - INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS before,
               strftime(created_at - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS week FROM standard_events""",
)
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("created_at")
    return _std(spark, d).select("row_id", dates.iso_date(at).alias("day"), dates.iso_datetime(at).alias("moment"), dates.hours_ago(at, 36).alias("before"), dates.days_ago(at, 7).alias("week"))


@query("raw_by_module", "SELECT raw_id, epoch_us(fetched_at) AS fetched_us FROM enterprise_raw_events WHERE module = 'enterprise'")
def raw_by_module(spark: SparkSession, d: str) -> DataFrame:
    return lookups.matching(_raw(spark, d), module="enterprise").orderBy(F.desc("fetched_at"), "raw_id").select("raw_id", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"))


@query(
    "restate_join",
    f"""WITH r AS (SELECT event_id, arg_min(nullif(trim(title),''), row_id) AS t FROM (SELECT * FROM standard_events WHERE row_id % 3 = 0) GROUP BY event_id), p AS (SELECT row_id, event_id FROM standard_events WHERE {_CAT} = 'paper')
        SELECT row_id, t AS title_zh FROM p LEFT JOIN r USING (event_id)""",
)
def restate_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _std(spark, d)
    first = rows.where("row_id % 3 = 0").groupBy("event_id").agg(F.min_by(F.nullif(F.trim("title"), F.lit("")), F.when(F.length(F.trim("title")) > 0, F.col("row_id"))).alias("title")).withColumn("body", F.lit(""))
    return lookups.with_restated(rows.where(F.lower(F.trim("module")) == "paper").select("row_id", "event_id"), first).select("row_id", "title_zh")


@query(
    "search_fallback",
    """WITH h AS (SELECT raw_id, lower(concat_ws(' ', title, content)) AS t FROM enterprise_raw_events), w AS (SELECT * FROM h WHERE contains(t, 'model') OR contains(t, '模型')),
       n AS (SELECT company_id, company, lower(unnest(list_concat([company], coalesce(aliases, [])))) AS al FROM enterprise_pool)
       SELECT raw_id AS pos, arg_min(company, company_id) AS company FROM w JOIN n ON length(al) >= 3 AND contains(t, al) GROUP BY raw_id""",
)
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = _raw(spark, d).select(F.col("raw_id").cast("string").alias("file"), F.col("raw_id").alias("pos"), "title", F.col("content").alias("snippet"))
    return lookups.search_matches(hits, table(spark, d, "enterprise_pool"), ["model", "模型"]).select("pos", "company")
