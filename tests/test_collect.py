"""Collectors, standardising by module, report expressions, evidence merging and their edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom import schema, session
from eventloom.functions import records, reports, text, web
from eventloom.operators import merge
from eventloom.plans import collect, daily
from eventloom.sources import payloads

EV = "struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>"
POOL = [(1, "OpenThing", ["open thing", "开放"]), (2, "BigCo", ["bigco", "大公司"])]


def one(spark, expr, *args, schema=None):
    df = spark.createDataFrame([args], schema or ", ".join(f"c{k} string" for k in range(len(args))))
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(POOL, "company_id long, company string, aliases array<string>")


def repo(name, url, stars, description="", tags=(), kind="github_repo"):
    return (name, url, "own", stars, None, None, None, None, None, "2026-01-02", "2026-08-30", list(tags), description, [(url, kind, "n", None, None)])


def test_open_source_merges_by_url_and_falls_back(spark):
    first = spark.createDataFrame([repo("a", "https://h/o/a", 5, "one", ["x"]), repo("b", "https://h/o/b", 9)], schema.OPEN_SOURCE_RAW)
    second = spark.createDataFrame([repo("a2", "https://H/o/A/", 7, "two", ["y", "x"], "gitee"), repo("none", None, 3)], schema.OPEN_SOURCE_RAW)
    empty = first.limit(0)
    got = collect.open_source([first, second], []).collect()
    assert [(r.repo_url, r.stars, r.description, r.tech_tags, [s.url for s in r.source_urls]) for r in got] == [
        ("https://h/o/b", 9, None, [], ["https://h/o/b"]), ("https://h/o/a", 7, "two", ["x", "y"], ["https://h/o/a", "https://H/o/A/"]),
    ]
    read = []
    fallback = lambda k, df: lambda: read.append(k) or df
    got = collect.open_source([empty], [fallback(1, empty), fallback(2, second), fallback(3, first)]).collect()
    assert [r.project_name for r in got] == ["a2"] and 3 not in read


def test_standardise_each_module(spark, pool):
    day = F.lit("2026-08-31")
    repos = spark.createDataFrame([repo("kit", "https://h/o/kit", 5, "A toolkit. More"), repo("bare", "https://h/o/bare", 5, "")], schema.OPEN_SOURCE_RAW)
    got = {r["product"]: r for r in collect.standard_repositories(repos, day).collect()}
    assert got["kit"].title == "kit：A toolkit" and got["kit"].time == "2026-08-30" and got["kit"].company == "own" and got["kit"].source[0].credibility_score == 5.0
    assert (got["bare"].title, got["bare"].description) == ("bare 开源项目", "bare（own）近期活跃更新") and got["kit"].event_id.startswith("evt_op_")
    papers = spark.createDataFrame([("p1", " A  title ", ["n"], "Lab", "2026/8/5", "x" * 2000, "cs.AI", None, [])], schema.PAPER_RAW)
    p = collect.standard_papers(papers, day).first()
    assert (p.title, len(p.description), p.time, p.company, p["product"], p.sub_tags) == ("A title", 1500, "2026-08-05", "Lab", "p1", ["cs.AI"])
    news = spark.createDataFrame([("investment", "the OPEN THING firm", "", "2026-8-1", " c ", {"product": "Kit"}, [], [("http://x/1", "media", "m", None, None)]), ("product", None, None, "soon", None, None, None, None)], schema.ENTERPRISE_RAW)
    a, b = sorted(collect.standard_company_news(news, day, pool).collect(), key=lambda r: r.sub_type)
    assert (a.company, a["product"], a.sub_tags, a.time, a.title, a.added_at) == ("OpenThing", "Kit", ["投融资"], "2026-08-01", "未命名事件", "2026-08-31")
    assert (b.company, b["product"], b.sub_tags, b.time, b.event_id, b.source) == ("", None, ["产品战略"], None, None, [])


def test_company_resolution(spark, pool):
    rows = [(1, "News of 大公司", ""), (2, "NVIDIA chips", ""), (3, "Gamma Tools raises $5M", ""), (4, "The raises", ""), (5, "某某公司完成融资", ""), (6, None, None), (7, "x", "made by open thing and bigco")]
    got = {r.k: r.company_found for r in collect.resolve_company(spark.createDataFrame(rows, "k int, title string, text string"), "k", "title", "text", pool).collect()}
    assert got == {1: "BigCo", 2: "Nvidia", 3: "Gamma Tools", 4: "", 5: "某某公司", 6: "", 7: "OpenThing"}


def test_feed_items_about_the_pool(spark, pool):
    items = spark.createDataFrame([("f", 0, "BigCo ships", ""), ("f", 1, "someone ships", "with bigco"), ("f", 2, "BigCo 股价上涨", ""), ("f", 3, "OPEN thing and BigCo", ""), ("f", 4, "大公司 again", "")], "file string, pos int, title string, snippet string")
    got = collect.pool_mentions(items, pool, most=2)
    assert sorted((r.pos, r.company) for r in got.collect()) == [(0, "BigCo"), (3, "OpenThing")]


def test_recent_media(spark):
    items = spark.createDataFrame([("f", 0, "new LLM", "", "2026-08-31"), ("f", 1, "new LLM", "", "2026-08-20"), ("f", 2, "new LLM", "", None), ("f", 3, "gardens", "", "2026-08-31"), ("f", 4, "LLM 招聘", "", "2026-08-31")], "file string, pos int, title string, snippet string, published_at string")
    assert [r.pos for r in collect.recent_media(items, F.lit("2026-08-31"), r"(?i)\bllm\b").collect()] == [0]


def test_enterprise_digest(spark):
    kind = f"title string, content string, company string, published_at string, source_urls array<{EV}>"
    ev = lambda u: [(u, "media", "m", None, None)]
    a = spark.createDataFrame([("Firm raises money in round two now", "c", "Firm", "2026-08-02", ev("http://a")), ("Firm ships kit", "发布 X模型", "Firm", "2026-08-03", ev("http://b")), ("Firm third", "c", "Firm", "2026-08-04", ev("http://c"))], kind)
    b = spark.createDataFrame([("FIRM raises money in round two now", "longer", "Other", "2026-08-05", ev("http://d")), ("no company 1", "", "", None, ev("")), ("no company 2", "", None, None, None), ("no company 3", "", "", None, [])], kind)
    got = collect.enterprise([a, b], F.lit("2026-08-31")).collect()
    assert [r.title for r in got] == ["Firm ships kit", "Firm raises money in round two now", "no company 1", "no company 2", "no company 3"]
    assert [s.url for s in got[1].source_urls] == ["http://a", "http://d"] and got[1].sub_type == "investment" and got[0].found["product"] == "X模型"


def test_merging_keeps_the_first_and_fills(spark):
    kind = f"row_id long, k string, title string, description string, company string, product string, entities map<string,string>, insight struct<what:string>, source array<{EV}>"
    rows = [
        (3, "a", "t3", "longest of all", "c", None, {"e": "1"}, ("w",), [("u1", "x", "new", None, None)]), (1, "a", "t1", "short", " ", "p", {}, None, [("u1", "x", "old", None, None), ("", "x", "no url", None, None), ("u2", "x", "n", None, None)]),
        (2, None, "t2", None, None, None, None, None, None),
    ]
    got = sorted(merge.merge_cross_source(spark.createDataFrame(rows, kind), F.col("k"), "row_id").collect())
    assert [r.row_id for r in got] == [1, 2]
    r = got[0]
    assert (r.title, r.description, r.company, r["product"], r.entities, r.insight.what) == ("t1", "longest of all", "c", "p", {"e": "1"}, "w")
    assert [(s.url, s.name) for s in r.source] == [("u1", "new"), ("u2", "n")] and got[1].source == []


def test_running_maximum_in_buckets(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, rng.randint(0, 50)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    seen, want = {}, {}
    for k, seq, v in rows:
        want[seq] = seen.get(k)
        seen[k] = max(v, seen.get(k, v))
    for bucket in (7, 100, 10**6):
        assert {r.seq: r.m for r in merge.max_before(df, "k", "seq", "v", "m", bucket).collect()} == want


def test_new_hosts(spark):
    ev = lambda *urls: [(u, "t", "n", None, None) for u in urls]
    got = one(spark, merge.add_new_hosts, ev("https://a.example/1", "plain"), ev("https://A.example/2", "https://b.example/1", "plain", "", None, "other"), schema=f"a array<{EV}>, b array<{EV}>")
    assert [s.url for s in got] == ["https://a.example/1", "plain", "https://b.example/1", "other"]


def test_feedback(spark):
    events = spark.createDataFrame([("e1", 2.5, "evaluated", "2026-08-01", 1), ("e1", 4.5, "reported", "2026-08-02", 2), ("e2", float("nan"), "evaluated", None, 3)], "event_id string, importance_score double, status string, added_at string, row_id long")
    given = spark.createDataFrame([("f1", "e1", "r"), ("f2", "e2", "r"), ("f3", "gone", None)], "id string, event_id string, report_id string")
    got = {r.id: (r.agent_score, r.report_id) for r in merge.feedback_with_event(given, events).collect()}
    assert got == {"f1": (4.5, "report_20260802"), "f2": (0.0, "r"), "f3": (0.0, "")}
    kind = "id string, created_at string, s int"
    old = spark.createDataFrame([("1", "2026-01-01", 1), ("2", "2026-01-02", 1)], kind)
    assert [tuple(r) for r in merge.append_or_replace(old, spark.createDataFrame([("1", "2026-01-03", 9)], kind)).collect()] == [("1", "2026-01-03", 9), ("2", "2026-01-02", 1)]


@pytest.mark.parametrize("raw,want", [
    ("&#20320;&#22909; &#39;x&#39;", "你好 'x'"), ("&amp;amp;amp;lt;b&amp;amp;amp;gt;deep&amp;amp;lt;/b&amp;amp;gt;", "deep"), ("<![CDATA[ a <i>b</i> ]]>", "a b"), ("1 < 2 and 3", "1 < 2 and 3"),
    ("&#38;#38;lt;p&#38;gt; end", "end"), ("&#1114112;&#55296;ok", "ok"), ("a&nbsp;b\n\tc", "a b c"), ("", ""), (None, ""),
])
def test_markup_to_the_fixpoint(spark, raw, want):
    assert one(spark, web.strip_tags, raw, schema="c string") == want


def test_importance_with_insight(spark):
    """An investment tag adds 0.3, an insight 0.3; a missing date takes 1.5; 5 is the most."""
    def score(tags=(), n=1, dated=True, told=False, acc=4.0):
        src = F.array(*[F.struct(F.lit("u").alias("url"))] * n)
        return spark.range(1).select(records.importance(F.lit(acc), src, F.array(*[F.lit(t) for t in tags]).cast("array<string>"), F.lit("enterprise"), F.lit(dated), F.lit(told)).alias("x")).first().x

    base = score()
    assert score(["投融资"]) == pytest.approx(base + 0.3) and score(told=True) == pytest.approx(base + 0.3) and score(dated=False) == pytest.approx(base - 1.5)
    assert score(n=3) > base and score(["投融资"] * 9, acc=5.0) == 5.0


def test_numbers_in_reasons(spark):
    facts = one(spark, lambda h: reports.paper_facts(F.lit("Lab"), h, F.array(F.lit("a"), F.lit("b"))), "高引用(60)")
    assert facts == "（论文数据：机构=Lab，被引=60，影响力信号=高引用(60)，作者数=2）"
    assert one(spark, lambda s: reports.repository_facts(s, F.lit(12), F.lit(0), F.lit(3), F.lit(None).cast("long"), F.lit("Py")), 12345, schema="s long") == "（社区数据：stars=12,345，周增长=+12，open_issues=3，语言=Py）"
    r = one(spark, lambda i: reports.rank_reason(i, F.lit(4.0), F.lit("（社区数据：stars=5）")), 4.5, schema="i double")
    assert (r.zh, r.en) == ("综合评分 4.5（真实性 4）；社区数据：stars=5", "Composite score 4.5 (authenticity 4); 社区数据：stars=5")


@pytest.mark.parametrize("comment,want", [
    ("Accepted by ACL 2026", "ACL 2026 录用"), ("accepted at the Turing Forum", "Turing 录用"), ("to appear, accepted for Publication", "顶会录用"), ("a state-of-the-art result", "疑似 SOTA"), ("12 pages", None), (None, None),
])
def test_venues(spark, comment, want):
    assert one(spark, reports.influence_hint, comment, schema="c string") == want


def test_texts_about_a_subject(spark):
    def related(subject, body, company=None):
        return one(spark, text.related, subject, body, company, schema="a string, b string, c string")

    assert related("New Qwen3.8-Max model", "谈 qwen3.8-Max 的文章") and related("发布消息", "腾讯云推出", "腾讯") and related("x", "from ACME today", "Acme")
    assert not related("This with that", "other words") and not related("发布更新", "今日发布") and not related("Anything", None) and not related(None, "text")
    assert related("视觉模型", "视觉模型很好") and one(spark, reports.institution_of, "affiliation: Some Lab; x") == "Some Lab"


def test_small_text_helpers(spark):
    assert one(spark, lambda n: records.title_from_description(n, F.lit("word " * 20)), "kit").endswith("word") and len(one(spark, lambda n: records.title_from_description(n, F.lit("word " * 20)), "kit")) <= 64
    assert one(spark, lambda x: web.strip_head_words(x, ["News", "Product"]), "News Product A headline News") == "A headline"
    assert one(spark, reports.comment_shown, "Same start", "Same start and more") == "" and one(spark, reports.comment_shown, "Own words", "text") == "Own words"
    assert one(spark, lambda t, d: reports.needs_restating(t, d), "中文", "english") and not one(spark, lambda t, d: reports.needs_restating(t, d), "中文", "中文")
    assert one(spark, lambda a, b: reports.in_language(a, b, True), "en", "") == "en" and one(spark, lambda a, b: reports.in_language(a, b, True), "en", "中") == "中"
    assert one(spark, reports.search_query, "The new Kit announces speed for all", "Firm") == "Firm Kit speed all" and one(spark, reports.search_query, "发布", "") == "发布"
    assert not one(spark, lambda b: reports.restated_body_ok(b, F.lit("s"), F.lit(True)), "short") and one(spark, lambda b: reports.restated_comment_ok(b, F.lit(True)), "x" * 15)


def test_defaults_and_violations(spark):
    report = spark.createDataFrame([("2026-08-31", "s", "", "# 2026-08-31")], "date string, summary string, future_watch string, markdown string")
    sections = spark.createDataFrame([("paper", 0, None, 0)], "module string, n long, note string, ord int")
    events = spark.createDataFrame([("paper", "t", [("", "x", "n", None, None)])], f"section string, title string, source array<{EV}>")
    assert sorted(r.issue for r in collect.quality_violations(report, events, sections).collect()) == ["summary/future_watch 缺失", "事件无来源: t", "模块 paper 无标注"]
    report, sections = collect.with_defaults(report, sections)
    assert collect.quality_violations(report, events.limit(0), sections).count() == 0
    assert collect.narrative(sections, "2026-08-31").first().total == 0


def test_delivered_order_and_search(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(json.dumps(content) if not isinstance(content, str) else content, encoding="utf-8")
        return str(tmp_path / name)

    models = put("m.json", [{"id": f"o/n{k}", "likes": k} for k in range(10)])
    assert sorted(r.project_name for r in payloads.model_listing(spark, models, per_query=3).collect()) == ["n0", "n1", "n2"]
    day = put("d.json", [{"paper": {"id": f"p{k}", "title": "t", "summary": "s", "upvotes": k}, "publishedAt": "2026-01-01T00"} for k in range(20)])
    assert {r.paper_id for r in payloads.daily_papers(spark, day).collect()} == {f"p{k}" for k in range(15)}
    hits = put("h.json", {"hits": [{"title": "a", "url": "u", "created_at": "2026-08-30T01:00:00Z", "story_text": "<p>x</p>"}, {"title": "old", "created_at": "2026-01-01T00:00:00Z"}, {"title": "", "created_at": "2026-08-30T01:00:00Z"}]})
    assert [(r.title, r.link, r.snippet) for r in payloads.search_hits(spark, hits, F.lit("2026-08-31"), 3).collect()] == [("a", "u", "x")]
    feed = put("n.xml", "<rss>" + "".join(f"<item><title>Head {k} - Paper</title><link>l{k}</link>{'<pubDate>Tue, 25 Aug 2026 00:30:00 GMT</pubDate>' if k else ''}</item>" for k in range(9)) + "</rss>")
    assert [r.title for r in payloads.news_query(spark, feed).orderBy("pos").collect()] == [f"Head {k}" for k in range(1, 7)]


def test_a_cluster_without_checkpoint_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, *_):
            return None

    fake = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_broadcast_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], {"a": "b"})], "a string, b array<int>, c map<string,string>")
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(session.broadcast_if_small(df)) and session.broadcast_if_small(df, 500) is df and hinted(session.broadcast_if_small(df.limit(0)))


def test_dedup_of_a_run(spark):
    """Same company, verb-only difference, same day: one; other language, company or day: apart; equal repository: one."""
    kind = f"row_id long, category string, company string, product string, title string, description string, time string, source array<{EV}>"
    ev = lambda u: [(u, "media", "m", None, None)]
    rows = [
        (1, "enterprise", "Firm", None, "Tool launches AI agent", "d", "2026-08-31", ev("a")), (2, "enterprise", "Firm", None, "Tool releases AI agent", "longer", "2026-08-31", ev("b")), (3, "enterprise", "Firm", None, "工具发布智能体", "d", "2026-08-31", ev("c")),
        (4, "enterprise", "Else", None, "Tool launches AI agent", "d", "2026-08-31", ev("d")), (5, "enterprise", "Firm", None, "Tool launches AI agent", "d", "2026-08-30", ev("e")), (6, "opensource", "o", "own/repo", "x", "d", "2026-08-01", ev("f")),
        (7, "opensource", "p", "OWN/repo", "y", "d", "2026-08-20", ev("g")),
    ]
    df = spark.createDataFrame(rows, kind)
    key = merge.cross_source_key(F.col("category"), F.col("company"), F.col("product"), F.col("title"), F.lit("2026-08-31"), F.col("time"))
    got = {r.row_id: (r.description, len(r.source)) for r in merge.merge_cross_source(df, key, "row_id").collect()}
    assert got == {1: ("longer", 2), 3: ("d", 1), 4: ("d", 1), 5: ("d", 1), 6: ("d", 2)}
    assert daily.WINDOW_DAYS["paper"] == 7


def test_papers_take_sources_of_new_hosts(spark):
    ev = lambda *urls: [(u, "t", f"n{k}", None, None) for k, u in enumerate(urls)]
    rows = [(1, "A", ev("https://a.example/1", "")), (2, "B", ev("https://A.example/9", "https://b.example/1", "https://b.example/2", "")), (3, "C", ev("https://b.example/3", "https://c.example/1")), (4, "D", None)]
    df = spark.createDataFrame(rows, f"row_id long, title string, source array<{EV}>")
    leaders = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "uid long, leader long")
    got = {r.row_id: (r.title, [s.url for s in r.source]) for r in merge.merge_papers(df, leaders, "row_id").collect()}
    assert got == {1: ("A", ["https://a.example/1", "", "https://b.example/1", "https://b.example/2", "https://c.example/1"]), 4: ("D", [])}


def test_details_of_cards_and_tracks(spark, tmp_path):
    cards = spark.createDataFrame([("f", "/news/a", "card A", 0), ("f", "https://o.example/b", "card B", 1)], "file string, href string, text string, pos int")
    pages = spark.createDataFrame([("https://h.example/news/a", "Title A", "body")], "url string, title string, body string")
    assert sorted((r.url, r.title, r.body) for r in payloads.with_details(cards, pages, "https://h.example/").collect()) == [("https://h.example/news/a", "Title A", "body"), ("https://o.example/b", "card B", None)]
    item = lambda n, pushed: {"name": n, "html_url": f"https://h/o/{n}", "stargazers_count": 1, "pushed_at": pushed}
    (tmp_path / "q.json").write_text(json.dumps({"items": [item("fresh", "2026-08-30T00:00:00Z"), item("stale", "2026-08-01T00:00:00Z"), item("never", None)]}))
    path, now = str(tmp_path / "q.json"), F.lit("2026-08-31 12:00:00")
    assert [r.project_name for r in payloads.github_repositories(spark, path, as_of=now, pushed_within_hours=72).collect()] == ["fresh"]
    assert payloads.github_repositories(spark, path).count() == 3
