"""Expressions over URLs, markup and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import col

# Domains by the credibility of what they publish.
TOP_DOMAINS = ["openai.com", "anthropic.com", "github.com", "arxiv.org", "deepseek.com", "qwen", "modelscope.cn", "huggingface.co", "seed.bytedance.com", "hunyuan.tencent.com", "kimi.com"]
HIGH_DOMAINS = ["crunchbase.com", "itjuzi.com", "openreview.net", "semanticscholar.org", "api.openalex.org", "openalex.org", "modelscope.cn", "huggingface.co"]
MEDIA_DOMAINS = ["36kr.com", "techcrunch.com", "jiqizhixin.com", "infoq.cn", "theverge.com", "sspai.com", "geekpark.net", "ifanr.com", "woshipm.com", "qq.com"]
FORUM_DOMAINS = ["news.ycombinator.com", "reddit.com", "medium.com", "zhihu.com", "juejin.cn", "csdn.net"]


def url_key(x: Column | str) -> Column:
    """A URL in lower case without closing slashes; '' for null."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), r"/+$", "")


def url_host(x: Column | str) -> Column:
    """Host of a URL with its port, in lower case; null for what is no URL."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(col(x), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1), F.lit("")))


def credibility(url: Column | str, source_type: Column | str) -> Column:
    """Credibility of a piece of evidence, by its type, then by the first tier with a domain that the URL contains."""
    low = F.lower(F.coalesce(col(url), F.lit("")))
    any_of = lambda domains: low.rlike("|".join(d.replace(".", r"\.") for d in domains))
    return (
        F.when(col(source_type).isin("github_repo", "arxiv", "official_rss", "official"), F.lit(5.0))
        .when(any_of(TOP_DOMAINS), F.lit(5.0))
        .when(any_of(HIGH_DOMAINS), F.lit(4.5))
        .when(any_of(MEDIA_DOMAINS), F.lit(4.0))
        .when(any_of(FORUM_DOMAINS), F.lit(3.0))
        .when(low == "", F.lit(1.0))
        .otherwise(F.lit(2.0))
    )


def credibility_level(score: Column) -> Column:
    return F.when(score >= 5, "S").when(score >= 4.5, "A").when(score >= 4, "B").when(score >= 3, "C").otherwise("D")


def clean_xml(x: Column | str) -> Column:
    """Text of an XML element: CDATA unwrapped, tags dropped, blanks collapsed."""
    y = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(y, r"<[^>]+>", ""), r"\s+", " "))


def strip_html(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"<[^>]+>", ""), r"\s+", " "))


# Entities in the order in which they are resolved.
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#x27;", "'"), ("&quot;", '"'), ("&nbsp;", " "))


def _numeric_entities(x: Column) -> Column:
    """A text with its decimal character references resolved; those that name no character vanish."""
    code = lambda c: F.when(F.length(c) <= 7, c.cast("int"))
    char = lambda c: F.when((code(c) > 0) & (code(c) <= 0x10FFFF) & ~code(c).between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code(c)), 8, "0")), "UTF-32"))
    chars = F.transform(F.regexp_extract_all(x, F.lit(r"&#(\d+);"), 1), lambda c: F.coalesce(char(c), F.lit("")))
    pieces = F.split(x, r"&#\d+;")
    return F.concat(pieces[0], F.array_join(F.zip_with(chars, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), lambda c, t: F.concat(c, F.coalesce(t, F.lit("")))), ""))


def _strip_once(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]+>", " ")
    for name, char in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.when(F.contains(x, F.lit("&#")), _numeric_entities(x)).otherwise(x), r"\s+", " ")


def strip_tags(x: Column | str) -> Column:
    """Markup taken off and entities resolved again and again until nothing changes, since entities may hide tags and entities.

    A round that leaves an entity behind takes one of its wrappings off, so there are as many rounds as the longest chain
    of wrappings in the text, and three more. Text without markup passes at once.
    """
    y = F.coalesce(col(x), F.lit(""))
    chains = F.transform(F.regexp_extract_all(y, F.lit(r"((?:amp;|#0*38;|#x26;)+)"), 1), lambda c: F.length(c))
    rounds = F.lit(3) + F.coalesce(F.array_max(chains), F.lit(0)).cast("int") / 4
    whole = F.aggregate(F.sequence(F.lit(1), rounds.cast("int")), y, lambda t, _: _strip_once(t))
    return F.trim(F.when(y.rlike(r"[<&]|\]\]>"), whole).otherwise(F.regexp_replace(y, r"\s+", " ")))


def article_body(page: Column | str, paragraphs: int = 6, limit: int = 500) -> Column:
    """Heading (150 characters at most) and the first paragraphs longer than 40 characters of a page, cut to ``limit``."""
    page = F.coalesce(col(page), F.lit(""))
    head = F.substring(strip_tags(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), 1, 150)
    parts = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), lambda p: strip_tags(p))
    kept = F.slice(F.filter(parts, lambda p: (F.length(p) > 40) & ~F.lower(p).rlike(r"cookie|subscribe|sign in|privacy policy|all rights reserved")), 1, paragraphs)
    return F.trim(F.substring(F.concat_ws(" ", F.when(head != "", head), F.array_join(kept, " ")), 1, limit))


def page_title(page: Column | str) -> Column:
    page = F.coalesce(col(page), F.lit(""))
    return strip_tags(F.coalesce(F.nullif(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


def strip_head_words(x: Column | str, words: list[str], most: int = 6) -> Column:
    """A card's text without up to ``most`` category words at its head and its tail."""
    of = "|".join(words)
    y = F.regexp_replace(F.trim(col(x)), rf"^(?:(?:{of})\s+){{1,{most}}}", "")
    return F.trim(F.regexp_replace(y, rf"(?:\s+(?:{of})){{1,{most}}}$", ""))


def strip_publisher(x: Column | str) -> Column:
    """A headline without the `` - Publisher`` that aggregators append."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+-\s+[^-]+$", "")
