import json

import pytest
from pyspark.sql import functions as F

from eventloom import sources
from eventloom.sources import payloads, registry, sinks


@pytest.fixture()
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(path)

    return write


def test_github_first_query_wins(spark, put, tmp_path):
    item = lambda n, url, stars: {"name": n, "html_url": url, "stargazers_count": stars, "owner": {"login": "o"}, "created_at": "2026-01-02T03:04:05Z", "topics": ["llm"]}
    put("q/1.json", {"items": [item("a", "https://h/o/a", 5), item("b", "https://h/o/b", 6)]})
    put("q/2.json", {"items": [item("a2", "https://H/o/a/", 9), item("c", "https://h/o/c", 1)]})
    put("q/3.json", "not json at all")
    got = payloads.github_repositories(spark, str(tmp_path / "q")).orderBy("seq")
    assert [(r.project_name, r.stars, r.created_at) for r in got.collect()] == [("a", 5, "2026-01-02"), ("b", 6, "2026-01-02"), ("c", 1, "2026-01-02")]
    assert payloads.github_repositories(spark, str(tmp_path / "q"), per_query=1).count() == 1  # the first of both queries is one repository


def test_listings(spark, put):
    studios = put("s.json", {"Data": {"Studios": [{"Name": "n", "Path": "o", "Stars": 3, "GmtModified": "2026-02-03 01:00"}]}})
    assert payloads.studio_listing(spark, studios).first().updated_at == "2026-02-03"
    models = put("m.json", [{"id": "own/name", "likes": 4, "tags": ["x", "pipeline:y"]}, {"id": "bare", "likes": 9}])
    assert [(r.owner, r.project_name) for r in payloads.model_listing(spark, models).orderBy("stars").collect()] == [("own", "name"), ("", "bare")]
    assert payloads.model_listing(spark, models).orderBy("stars").first().tech_tags == ["x"]
    gitee = put("g.json", [{"full_name": "o/n", "name": "n", "html_url": "u", "stargazers_count": 1}])
    assert payloads.gitee_repositories(spark, gitee).first().owner == "o"


def test_papers(spark, put):
    atom = put("a.xml", "<feed><entry><id>http://arxiv.org/abs/2601.00001v2</id><title>A\n title</title><summary> S </summary><published>2026-01-03T00:00:00Z</published><author><name>N</name></author><category term='cs.AI'/></entry></feed>")
    r = payloads.arxiv_entries(spark, atom).first()
    assert (r.paper_id, r.title, r.published_at, r.authors, r.category) == ("2601.00001", "A title", "2026-01-03", ["N"], "cs.AI")
    works = put("w.json", {"results": [{"id": "https://x/W1", "display_name": "T", "cited_by_count": 60, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]})
    r = payloads.openalex_works(spark, works).first()
    assert (r.paper_id, r.abstract, r.influence_hint) == ("W1", "a b a", "高引用(60)")
    day = put("d.json", [{"paper": {"id": "p", "title": "t", "summary": "s", "upvotes": 21}, "publishedAt": "2026-01-01T00"}])
    assert payloads.daily_papers(spark, day).first().influence_hint == "HF 热议(21)"


def test_feeds_and_pages(spark, put):
    feed = put("f.xml", "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Tue, 25 Aug 2026 00:30:00 GMT</pubDate><description>&lt;p&gt;text&lt;/p&gt;</description></item>"
               "<entry><title>C</title><link href=\"http://x/2\"/><updated>2026-08-26T00:00:00Z</updated></entry></rss>")  # fmt: skip
    got = [(r.title, r.link, r.published_at, r.snippet) for r in payloads.feed_items(spark, feed).orderBy("pos").collect()]
    assert got == [("A & B", "http://x/1", "2026-08-25", "text"), ("C", "http://x/2", "2026-08-26", "")]
    page = put("p.html", '<title>T</title><h1>Head</h1><a href="/news/a">One <b>x</b></a><a href="/news/a">Two</a><a href="/other">No</a><p>' + "long paragraph text here " * 3 + "</p>")
    assert [(r.href, r.text) for r in payloads.html_cards(spark, page, "/news/").collect()] == [("/news/a", "One x")]
    r = payloads.articles(spark, page).first()
    assert r.title == "T" and r.body.startswith("Head long paragraph")
    mods = put("m.html", '<p>x</p><section class="module"><h2>One</h2>a</section><section class="module"><h2>Two</h2>b</section>')
    assert [r.module for r in payloads.html_modules(spark, mods).orderBy("pos").collect()] == ["One", "Two"]


def test_reports_and_state(spark, put, tmp_path):
    put("r/2026-01-01/report_20260101.md", "# R\n## Papers\n### 1. First\ntext\n### 2. Second\n## Firms\n### 1. Third\n")
    got = payloads.report_lines(spark, str(tmp_path / "r/*/*.md")).orderBy("line_no")
    assert [(r.section, r.title) for r in got.collect()] == [("Papers", "First"), ("Papers", "Second"), ("Firms", "Third")]
    assert payloads.report_files(spark, str(tmp_path / "r")).first().date == "2026-01-01"
    state = put("t.json", {"2026-01-01": {"paper": ["k1", "k2"], "x": []}})
    assert sorted(tuple(r) for r in payloads.reported_titles(spark, state).collect()) == [("2026-01-01", "paper", "k1"), ("2026-01-01", "paper", "k2")]
    assert payloads.feedback_file(spark, str(tmp_path / "none.json")).count() == 0
    assert payloads.feedback_file(spark, put("bad.json", "{oops")).count() == 0
    assert payloads.feedback_file(spark, put("fb.json", [{"id": "1", "human_score": 4.0}])).first().human_score == 4.0
    cache = put("c.json", {"meta": {"written_at": "2026-01-01T00:00:00Z"}, "items": ["a"]})
    assert [payloads.cache_entries(spark, cache, F.lit(t).cast("timestamp"), 36).first().stale for t in ("2026-01-02 00:00:00", "2026-01-03 00:00:00")] == [False, True]
    assert payloads.env_settings("A=1\n# c\nB='x'\nnoise", {"A": "2", "Z": "3"}) == {"A": "2", "B": "x"}


def test_registry(spark):
    assert {"github", "feeds", "reports"} <= set(registry.names()) and sources is not None
    with pytest.raises(KeyError):
        registry.source("nothing")
    registry.register("one")(lambda s, o: s.range(o["n"]))
    registry.register("two")(lambda s, o: s.range(1).withColumn("x", F.lit(1)))
    assert registry.collect(spark, {"one": {"n": 2}, "two": {}}).groupBy("origin").count().count() == 2
    with pytest.raises(ValueError):
        registry.register("one")(lambda s, o: None)


def test_sinks(spark, tmp_path):
    picks = spark.createDataFrame([("paper", 2, "B", None, None), ("paper", 1, "A", "d", "http://x"), ("firm", 1, "C", "", "http://y")], "module string, rank_no int, title string, description string, url string")
    text = sinks.report_markdown(picks, "2026-01-01").first().content
    assert text.index("## firm") < text.index("## paper") and text.index("### 1. A") < text.index("### 2. B")
    sinks.write_report(sinks.report_markdown(picks, "2026-01-01"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.strip() == text.strip()
    items = spark.createDataFrame([("t & u", "l", "2026-01-02", "d"), ("v", "l", "2026-01-03", None)], "title string, link string, published_at string, description string")
    doc = sinks.rss(items, "T", "L", F.col("published_at").desc()).first().value
    assert doc.index("<title>v") < doc.index("t &amp; u")
    path = str(tmp_path / "part")
    sinks.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "d string, v int"), path, ["d"])
    sinks.overwrite_partitions(spark.createDataFrame([("b", 2)], "d string, v int"), path, ["d"])
    assert sorted((r.d, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]
    traced = sinks.trace(sinks.trace(items, "log", "s1", "t", F.col("title"), F.lit("now")), "log", "s2", "t", F.col("title"), F.lit("now"))
    assert [x.stage for x in traced.first().log] == ["s1", "s2"]
