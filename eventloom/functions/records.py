"""Expressions over whole records: amounts, classes, entities, scores, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.dates import source_has_date
from eventloom.functions.text import clean_text, col, strip
from eventloom.functions.web import credibility

# Words that speak for a class, and topics that are tagged.
INVESTMENT_WORDS = ["融资", "投资", "并购", "上市", "股权", "定增", "IPO", "估值", "收购", "轮"]
INVESTMENT_WORDS_EN = ["funding", "raises", "raised", "series a", "series b", "series c", "valuation", "valued at", "acquisition", "acquires", "backing", "backed by", "ipo", "merger"]
PRODUCT_WORDS = ["发布", "更新", "上线", "产品", "版本", "合作", "战略", "开源", "API", "定价", "模型", "推出", "宣布"]
TECH_TAGS = ["LLM", "Agent", "RAG", "MCP", "多模态", "推理", "强化学习", "GPU", "大模型", "开源模型"]
HOT_TAGS = ["大模型", "Agent", "RAG", "MCP", "多模态", "AI Infra", "开源模型"]
AD_WORDS = ["限时优惠", "点击购买", "广告", "sponsored", "推广合作", "加微信", "扫码咨询"]
_ROUNDS = r"(天使轮|种子轮|A\s*\+?\s*轮|B\s*\+?\s*轮|C\s*\+?\s*轮|D\s*\+?\s*轮|E\s*\+?\s*轮|Pre-?A\s*轮|Pre-?B\s*轮|Pre-?IPO\s*轮|战略融资|IPO|并购)"


def half_up(x: Column, digits: int = 1) -> Column:
    """Rounded with halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


# Notations of money in the order in which they are tried, with the factor to ten thousand yuan and whether the
# result is rounded. A rate of 7.2 holds for dollars; a billion counts a hundred millions, as the values to match have it.
_AMOUNTS = [
    (r"(\d+(?:\.\d+)?)\s*亿", 10000.0, False),
    (r"(\d+(?:\.\d+)?)\s*万", 1.0, False),
    (r"(?i)\$\s*(\d+(?:\.\d+)?)\s*([MBK])", {"M": 720.0, "B": 72000.0, "K": 0.72}, True),
    (r"(?i)(\d+(?:\.\d+)?)\s*(?:百万|M)\s*美元?", 720.0, True),
    (r"(\d+(?:\.\d+)?)\s*千万\s*美元?", 7200.0, True),
    (r"(\d+(?:\.\d+)?)\s*美元", 1.0, False),
]


def amount_in_wan(x: Column | str) -> Column:
    """An amount of money in units of ten thousand yuan, by the first notation that occurs; null if none does."""
    x = F.coalesce(col(x), F.lit(""))
    out = F.lit(None).cast("double")
    for pattern, factor, rounded in reversed(_AMOUNTS):
        number = F.regexp_extract(x, pattern, 1).try_cast("double")
        if isinstance(factor, dict):
            unit = F.upper(F.regexp_extract(x, pattern, 2))
            number = number * F.element_at(F.create_map(*[F.lit(v) for kv in factor.items() for v in kv]), F.when(x.rlike(pattern), unit))
        else:
            number = number * factor
        out = F.when(x.rlike(pattern), half_up(number, 0) if rounded else number).otherwise(out)
    return out


def format_wan(x: Column) -> Column:
    return F.when(x >= 10000, F.concat(F.format_string("%.2f", x / 10000), F.lit("亿元"))).otherwise(F.concat(half_up(x, 0).cast("long").cast("string"), F.lit("万元")))


def _hits(text: Column, words: list[str], weight: int = 1) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int") * weight
    return total


def classify(title: Column | str, content: Column | str) -> Column:
    """``investment`` if the words for it outweigh those for a product, else ``product``; English ones count twice.

    English words are found by one pass over the text, since none of them lies in or reaches into another.
    """
    text = F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(content), F.lit("")))
    english = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({'|'.join(INVESTMENT_WORDS_EN)})\b"), 1), F.lower))) * 2
    return F.when(_hits(text, INVESTMENT_WORDS) + english > _hits(text, PRODUCT_WORDS), F.lit("investment")).otherwise(F.lit("product"))


def extract_entities(text: Column | str) -> Column:
    """struct(amount, round, investors, star_count, tech_tags) by patterns; what is not found is null."""
    x = F.coalesce(col(text), F.lit(""))
    yi, wan, usd = r"(\d+(?:\.\d+)?)\s*亿\s*(?:元)?(?:人民币)?", r"(\d+(?:\.\d+)?)\s*万\s*(?:元)?(?:人民币)?", r"(?i)\$\s*(\d+(?:\.\d+)?)\s*(M|B)"
    raw = F.when(x.rlike(yi), F.regexp_extract(x, yi, 1)).when(x.rlike(wan), F.regexp_extract(x, wan, 1)).when(x.rlike(usd), F.regexp_extract(x, usd, 1))
    n = raw.try_cast("double")
    amount = F.when(F.contains(x, F.lit("亿")), n * 10000).when(F.contains(x, F.lit("万")), n).when(F.upper(F.regexp_extract(x, usd, 2)) == "B", n * 10000).otherwise(n * 100)
    by = r"由(.{2,30}?)(?:领投|参投|投资|注资)"
    investors = F.slice(F.filter(F.transform(F.split(F.regexp_extract(x, by, 1), "、|,|，|和|及"), strip), lambda s: s != ""), 1, 5)
    star = r"(?i)(\d+(?:\.\d+)?)\s*[k万]?\s*star"
    stars = F.regexp_extract(x, star, 1).try_cast("double")
    stars = stars * F.when(F.contains(F.lower(x), F.lit("k star")), 1000).otherwise(1) * F.when(x.rlike("万 ?star"), 10000).otherwise(1)
    tags = F.filter(F.array(*[F.lit(t) for t in TECH_TAGS]), lambda t: F.contains(x, t))
    return F.struct(
        amount.alias("amount"),
        F.nullif(F.regexp_extract(x, _ROUNDS, 1), F.lit("")).alias("round"),
        F.when(F.size(investors) > 0, investors).alias("investors"),
        F.when(x.rlike(star), stars).alias("star_count"),
        F.when(F.size(tags) > 0, tags).alias("tech_tags"),
    )


def scored_sources(sources: Column) -> Column:
    """Evidence with a credibility for every entry."""
    return F.transform(
        F.coalesce(sources, F.array().cast("array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>")),
        lambda s: F.struct(
            s["url"].alias("url"), s["source_type"].alias("source_type"), s["name"].alias("name"),
            F.coalesce(s["credibility_score"], credibility(s["url"], s["source_type"])).alias("credibility_score"), s["published_at"].alias("published_at"),
        ),
    )


def accuracy(sources: Column) -> Column:
    """Score from 1 to 5: the best evidence sets it, more evidence adds up to a half, none dated takes 1.5; 1 without evidence."""
    scored = scored_sources(sources)
    best, n = F.array_max(F.transform(scored, lambda s: s["credibility_score"])), F.size(scored)
    base = F.when(best >= 4.5, 5.0).when(best >= 4, 4.0).when(best >= 3, 3.0).otherwise(1.0)
    more = F.when(n >= 2, F.least(F.lit(0.5), (n - 1) * 0.25)).otherwise(0.0)
    undated = F.when(F.exists(scored, source_has_date), 0.0).otherwise(1.5)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), half_up(base + more - undated))))


def importance(accuracy_score: Column, sources: Column, tags: Column, category: Column, dated: Column, insight: Column | None = None) -> Column:
    """Score up to 5 from accuracy, number of sources, topical tags, tags of the category, a given insight, and dating."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    count = lambda pattern: F.size(F.filter(tags, lambda t: t.rlike(pattern)))
    own = F.when(category == "opensource", count("(?i)star|fork|contributor|community")).when(category == "paper", count("(?i)顶会|sota|热议|机构|影响力")).when(category == "enterprise", count("(?i)投融资|战略|头部")).otherwise(0)
    hot = F.size(F.filter(tags, lambda t: t.isin(*HOT_TAGS)))
    n = F.greatest(F.lit(0), F.coalesce(F.size(sources), F.lit(0)))
    told = F.lit(0.0) if insight is None else F.when(F.coalesce(insight, F.lit(False)), 0.3).otherwise(0.0)
    total = accuracy_score * 0.6 + F.least(F.lit(1.0), n * 0.3) + hot * 0.2 + own * 0.3 + told - F.when(dated, 0.0).otherwise(1.5)
    return F.least(F.lit(5.0), half_up(total))


def passes_rules(title: Column, description: Column, sources: Column) -> Column:
    """Neither an advertisement nor without evidence."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    return ~text.rlike("|".join(AD_WORDS)) & (F.coalesce(F.size(sources), F.lit(0)) > 0)


def facts(pairs: list[tuple[str, Column]]) -> Column:
    """``k=v`` pairs joined by semicolons, numbers with thousands separators; pairs without value are left out."""
    return F.concat_ws("; ", *[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs])


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def title_from_description(name: Column, description: Column, limit: int = 60) -> Column:
    """``name：first clause`` of a description, cut at a word's end if it is longer than ``limit``; without clause ``name 开源项目``."""
    first = F.trim(F.split(clean_text(description), r"[。.;；!！?\n]")[0])
    short = F.when(F.length(first) > limit, F.regexp_replace(F.substring(first, 1, limit), r"\s+\S*$", "")).otherwise(first)
    return F.when(short != "", F.concat(name, F.lit("："), short)).otherwise(F.concat(name, F.lit(" 开源项目")))


def repair_json(x: Column | str) -> Column:
    """A JSON text freed of fences and what surrounds it, with a cut-off string, array or object closed."""
    y = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    y = F.regexp_extract(y, r"(?s)(\{.*)", 1)
    y = F.when(F.length(F.regexp_replace(F.regexp_replace(y, r"\\.", ""), r'[^"]', "")) % 2 == 1, F.concat(y, F.lit('"'))).otherwise(y)
    bare = F.regexp_replace(F.regexp_replace(y, r"\\.", ""), r'"[^"]*"', "")
    y = F.regexp_replace(y, r"[,:\s]+$", "")
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    opened = F.aggregate(
        marks, F.array().cast("array<string>"),
        lambda acc, c: F.when(c == "{", F.array_append(acc, F.lit("}"))).when(c == "[", F.array_append(acc, F.lit("]"))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
    )
    return F.concat(y, F.array_join(F.reverse(opened), ""))


def parse_json(x: Column | str, schema: str) -> Column:
    """A JSON text parsed as it is, or else repaired; null if neither holds."""
    whole = F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(whole).isNotNull(), F.from_json(whole, schema)), F.from_json(repair_json(x), schema))
