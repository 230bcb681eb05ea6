import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, records, text, web


def value(spark, expr, *args, schema=None):
    df = spark.createDataFrame([args], schema or ", ".join(f"c{k} string" for k in range(len(args))))
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("2026-8-5", "2026-08-05"), ("Tue, 25 Aug 2026 00:30:00 GMT", "2026-08-25"), ("Mon, 24 Aug 2026 17:00:00 +0800", "2026-08-24"), ("2026年8月25日", "2026-08-25"), ("2026/08/31", "2026-08-31"), ("未知日期", None), ("", None), (None, None)])
def test_flexible_date(spark, raw, want):
    assert value(spark, dates.flexible_date, raw) == want


def test_relative_date(spark):
    as_of = F.lit("2026-08-10 12:00:00").cast("timestamp")
    assert value(spark, lambda c: dates.flexible_date(c, as_of), "3 天前") == "2026-08-07"
    assert value(spark, lambda c: dates.flexible_date(c), "3 天前") is None


@pytest.mark.parametrize("raw,want", [("5000万人民币", 5000.0), ("1.5亿", 15000.0), ("$100M", 72000.0), ("$2B", 144000.0), ("none", None), (None, None)])
def test_amount(spark, raw, want):
    assert value(spark, records.amount_in_wan, raw) == want


def test_similarity(spark):
    assert value(spark, text.similarity, "Tool launches AI agent", "Tool releases AI agent") == pytest.approx(0.6)
    assert value(spark, text.similarity, "ABC", "abc") == 1.0
    assert value(spark, text.similarity, "", "abc") == 0.0
    assert value(spark, text.similarity, None, "abc") == 0.0


def test_core_noun(spark):
    assert value(spark, text.core_noun, "Introducing Some Model 5") == "some model 5"
    assert value(spark, text.core_noun, "某某模型发布") == "某某模型发布"
    assert value(spark, text.core_noun, None) == ""


def test_dedup_key(spark):
    assert value(spark, text.dedup_key, "Tool launches the AI Agent!") == "tool ai agent"
    assert value(spark, text.dedup_key, "某某模型发布 Model3") == "某某模型发布 model3"
    assert len(value(spark, text.dedup_key, "word" * 400)) == 80
    assert value(spark, text.dedup_key, None) == ""


def test_entities_and_class(spark):
    e = value(spark, records.extract_entities, "某公司由红杉、高瓴领投完成 5 亿元 B 轮融资")
    assert (e["amount"], e["round"], e["investors"]) == (50000.0, "B 轮", ["红杉", "高瓴"])
    assert value(spark, records.extract_entities, "该项目获得 1.2k stars")["star_count"] == 1200
    assert value(spark, records.classify, "Firm raises $10M Series A", "") == "investment"
    assert value(spark, records.classify, "某公司 发布 X-6 模型", None) == "product"


EVIDENCE = "s array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>"


@pytest.mark.parametrize("sources,want", [([(5.0, True)], 5.0), ([(4.0, True)], 4.0), ([(4.0, True), (4.0, True)], 4.3), ([(4.0, False)], 2.5), ([], 1.0), (None, 1.0)])
def test_accuracy(spark, sources, want):
    rows = None if sources is None else [("http://x/y", "media", "n", c, "2026-01-01" if dated else None) for c, dated in sources]
    assert value(spark, records.accuracy, rows, schema=EVIDENCE) == pytest.approx(want)


def test_numbers(spark):
    df = spark.createDataFrame([("grew 28% to 154,670 users and 3.5M", "28% of 154670 now 99")], "a string, b string")
    got = df.select(text.untraceable_numbers(F.col("b"), text.allowed_numbers(F.col("a"))).alias("bad")).first().bad
    assert got == ["99"]


def test_markup(spark):
    assert value(spark, web.strip_tags, "&lt;p&gt;a &amp;amp; <b>b</b>&lt;/p&gt;") == "a & b"
    assert value(spark, web.clean_xml, "<t><![CDATA[ a  b ]]></t>") == "a b"
    page = "<h1>Head</h1><p>short</p><p>" + "long enough paragraph " * 4 + "</p>"
    assert value(spark, web.article_body, page).startswith("Head long enough")
    assert value(spark, web.url_host, "HTTPS://u@Host.Example:8080/x?y") == "host.example:8080"
    assert value(spark, web.url_host, "nothing") is None
    assert str(value(spark, dates.url_date, "https://x.example/2026/8/3/abc")) == "2026-08-03"
    assert value(spark, dates.url_date, "https://x.example/2026/13/3/abc") is None


@pytest.mark.parametrize("raw", ['{"a": [1, 2', '```json\n{"a": [1, 2]}\n```', 'text before {"a": [1, 2]} and after', '{"a": [1, 2], "b": "cut o'])
def test_json_repair(spark, raw):
    assert value(spark, lambda c: records.parse_json(c, "a array<int>, b string"), raw)["a"] == [1, 2]


def test_clean_text(spark):
    assert value(spark, text.clean_text, " a\r\n b 　（ c ） 。") == "a b （c）。"
    assert value(spark, text.clean_text, None) == ""


def test_half_up(spark):
    got = spark.range(1).select(records.half_up(F.lit(-0.25)).alias("a"), records.half_up(F.lit(0.25)).alias("b")).first()
    assert (got.a, got.b) == (-0.2, 0.3)
