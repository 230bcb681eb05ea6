"""Expressions for what a report says about a record: insights, reasons, hints, facts, which text to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.records import classify, half_up
from eventloom.functions.text import HAN, clean_text, col, has_han, strip

# The five sentences of an insight by rule, and the words for categories in them.
FIELD = {"opensource": "开源项目", "paper": "学术研究", "other": "企业动态"}
TREND = {"opensource": "开源生态", "paper": "学术研究", "other": "产业竞争"}
IMPACT = "影响范围：细分赛道。具体影响需结合后续数据验证。"
ACTION = "建议关注该主体的后续动态，并评估其与自身业务的关联度。"
# Words that a search query leaves out.
QUERY_STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "new", "how", "why", "what", "are", "was", "were", "has", "had", "its", "into", "you", "your", "can", "not", "will", "announces", "introduces", "launching", "releases",
]
# Venues whose name in a comment says where a paper was accepted.
VENUES = ["ACL", "EMNLP", "NAACL", "ICML", "ICLR", "NeurIPS", "CVPR", "ICCV", "ECCV", "AAAI", "IJCAI", "KDD", "SIGIR", "ACMMM", "COLING", "CoRL", "RSS", "WWW", "CIKM", "WSDM"]
# The patterns of product names and of financing rounds.
_PRODUCT = r"(?i)(?:发布|推出|上线|开源)\s*[「『【]?([A-Za-z0-9\-.]*(?:模型|大模型|版|框架|平台|套件|工具|API|Kit|Studio)[A-Za-z0-9\-.]*)[」』】]?"
_ROUND = r"(天使轮|种子轮|A\s*\+?\s*轮|B\s*\+?\s*轮|C\s*\+?\s*轮|D\s*\+?\s*轮|E\s*\+?\s*轮|Pre-?A\s*轮|Pre-?B\s*轮|Pre-?IPO\s*轮|战略融资|IPO|并购)"


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def number_text(x: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def insight(title: Column, description: Column, category: Column, company: Column, product: Column) -> Column:
    """struct(what, why, trend, impact, action) by rule."""
    of = lambda words: F.when(category == "opensource", words["opensource"]).when(category == "paper", words["paper"]).otherwise(words["other"])
    what = F.substring(F.concat(F.lit("事件为「"), _or_empty(title), F.lit("」。"), F.substring(clean_text(description), 1, 80)), 1, 120)
    who = F.when(_or_empty(company) != "", company).otherwise(F.lit("相关企业"))
    which = F.when(_or_empty(product) != "", F.concat(F.lit("（"), product, F.lit("）"))).otherwise(F.lit(""))
    why = F.concat(F.lit("该事件属于"), of(FIELD), F.lit("领域的重要进展，主体为"), who, which, F.lit("，对关注 AI 行业动态的受众具有参考价值。"))
    trend = F.concat(F.lit("事件反映出 AI "), of(TREND), F.lit("仍在快速演进。"))
    return F.struct(what.alias("what"), why.alias("why"), trend.alias("trend"), F.lit(IMPACT).alias("impact"), F.lit(ACTION).alias("action"))


def insight_summary(why: Column, trend: Column, impact: Column) -> Column:
    """Those of three sentences that have Han characters, in one line of 300 characters at most; null if none has."""
    parts = F.filter(F.transform(F.array(why, trend, impact), lambda s: F.trim(F.coalesce(s, F.lit("")))), lambda s: s.rlike(rf"[{HAN}]"))
    return F.when(F.size(parts) > 0, F.substring(F.array_join(parts, "；"), 1, 300))


def rank_reason(importance: Column, accuracy: Column, facts: Column) -> Column:
    """struct(zh, en): why a record is ranked, with its measured facts."""
    bare = F.regexp_replace(_or_empty(facts), "[（）]", "")
    tail = F.when(bare != "", F.concat(F.lit("；"), bare)).otherwise(F.lit(""))
    zh = F.concat(F.lit("综合评分 "), number_text(importance), F.lit("（真实性 "), number_text(accuracy), F.lit("）"), tail)
    en = F.concat(F.lit("Composite score "), number_text(importance), F.lit(" (authenticity "), number_text(accuracy), F.lit(")"), F.when(bare != "", F.concat(F.lit("; "), bare)).otherwise(F.lit("")))
    return F.struct(zh.alias("zh"), en.alias("en"))


def _listed(label: str, parts: list[Column]) -> Column:
    joined = F.concat_ws("，", *parts)
    return F.when(joined != "", F.concat(F.lit(f"（{label}："), joined, F.lit("）"))).otherwise(F.lit(""))


def repository_facts(stars: Column, growth: Column, forks: Column, issues: Column, contributors: Column, language: Column) -> Column:
    """Counts of a repository as text; zero and missing ones are left out."""
    some = lambda name, x: F.when(F.coalesce(x, F.lit(0)) != 0, F.concat(F.lit(f"{name}="), x.cast("string")))
    parts = [F.when(stars > 0, F.concat(F.lit("stars="), F.format_number(stars, 0))), F.when(growth.isNotNull(), F.concat(F.lit("周增长=+"), growth.cast("string")))]
    parts += [some("forks", forks), some("open_issues", issues), some("contributors", contributors), F.when(_or_empty(language) != "", F.concat(F.lit("语言="), language))]
    return _listed("社区数据", parts)


def paper_facts(institution: Column, hint: Column, authors: Column) -> Column:
    """Institution, citations, hints and number of authors of a paper as text."""
    cited = F.regexp_extract(_or_empty(hint), r"高引用\((\d+)\)", 1)
    parts = [F.when(_or_empty(institution) != "", F.concat(F.lit("机构="), institution)), F.when(cited != "", F.concat(F.lit("被引="), cited))]
    parts += [F.when((_or_empty(hint) != "") & ~F.contains(_or_empty(hint), F.lit("low_influence")), F.concat(F.lit("影响力信号="), hint)), F.when(F.size(authors) > 0, F.concat(F.lit("作者数="), F.size(authors).cast("string")))]
    return _listed("论文数据", parts)


def field_facts(fields: Column) -> Column:
    """The given entries of a map of fields as text, in the map's order."""
    given = F.filter(F.map_entries(fields), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    joined = F.array_join(F.transform(given, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "，")
    return F.when(F.coalesce(joined, F.lit("")) != "", F.concat(F.lit("（事件数据："), joined, F.lit("）"))).otherwise(F.lit(""))


def search_query(title: Column, company: Column) -> Column:
    """What to search for to corroborate a record: its company and the first three words of its title that count; else the title."""
    words = F.regexp_extract_all(_or_empty(title), F.lit(r"(?i)([a-z0-9][a-z0-9-]*)"), 1)
    first = F.slice(F.filter(words, lambda w: ~F.lower(w).isin(*QUERY_STOP_WORDS)), 1, 3)
    parts = F.concat_ws(" ", F.when(_or_empty(company).rlike(rf"[{HAN}A-Za-z]"), company), F.when(F.size(first) > 0, F.array_join(first, " ")))
    return F.when(parts != "", parts).otherwise(F.substring(_or_empty(title), 1, 40))


def institution_of(comment: Column) -> Column:
    """The affiliation that a comment states; null if it states none."""
    return F.nullif(F.trim(F.regexp_extract(_or_empty(comment), r"(?i)affiliation[^:：]*[:：]\s*([^;，。]{2,40})", 1)), F.lit(""))


def influence_hint(comment: Column) -> Column:
    """Where a paper was accepted, by a known venue or the name after "accepted by"; or that it claims the state of the art."""
    x = _or_empty(comment)
    known = F.regexp_extract(x, rf"(?i)((?:{'|'.join(VENUES)})\s*(?:20\d{{2}}|'\d{{2}})?)", 1)
    named = F.regexp_extract(x, r"accepted\s+(?:by|to|at|for|in)\s+(?:(?:the|a)\s+)?([A-Z][A-Za-z0-9+\-.]{2,})", 1)
    named = F.when(~F.lower(named).isin("appear", "publication", "proceedings", "conference", "journal", "workshop", ""), named)
    place = F.coalesce(F.nullif(F.trim(known), F.lit("")), named)
    return F.when(x.rlike("(?i)accept"), F.coalesce(F.concat(place, F.lit(" 录用")), F.lit("顶会录用"))).when(x.rlike("(?i)sota|state-of-the-art|state of the art"), F.lit("疑似 SOTA"))


def paper_key(paper_id: Column) -> Column:
    """A paper's id in lower case without its registry's prefix."""
    return F.regexp_replace(F.lower(_or_empty(paper_id)), "^arxiv:", "")


def paper_title_key(title: Column) -> Column:
    """A title's letters, digits and Han characters in lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(_or_empty(title)), rf"[^a-z0-9{HAN}]+", " "))


def financing_or_product(title: Column, content: Column) -> Column:
    """struct(sub_type, amount_wan, round, investors, product): the class by words, and for a financing its amount, round and
    investors, for a product its name. What is not found, or belongs to the other class, is null."""
    text = F.concat_ws(" ", _or_empty(title), _or_empty(content))
    kind = classify(title, content)
    yi, wan, usd = r"(\d+(?:\.\d+)?)\s*亿\s*(?:元)?(?:人民币)?", r"(\d+(?:\.\d+)?)\s*万\s*(?:元)?(?:人民币)?", r"(?i)\$\s*(\d+(?:\.\d+)?)\s*(M|B)"
    number = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1).try_cast("double")) for p in (yi, wan, usd)])
    factor = F.when(F.contains(text, F.lit("亿")), 10000.0).when(F.contains(text, F.lit("万")), 1.0).when(F.upper(F.regexp_extract(text, usd, 2)) == "B", 10000.0).otherwise(100.0)
    backers = F.slice(F.filter(F.transform(F.split(F.regexp_extract(text, r"由(.{2,30}?)(?:领投|参投|投资|注资)", 1), "、|,|，|和|及"), strip), lambda s: s != ""), 1, 5)
    financing, made = kind == "investment", F.regexp_extract(text, _PRODUCT, 1)
    return F.struct(
        kind.alias("sub_type"),
        F.when(financing, half_up(number * factor, 0)).alias("amount_wan"),
        F.when(financing, F.nullif(F.regexp_extract(text, _ROUND, 1), F.lit(""))).alias("round"),
        F.when(financing & (F.size(backers) > 0), backers).alias("investors"),
        F.when(~financing, F.nullif(made, F.lit(""))).alias("product"),
    )


def restated_body_ok(body: Column, subject: Column, related_: Column) -> Column:
    """Whether a restated text may stand for its subject: 40 characters that are no blanks, and about it."""
    return (F.length(F.regexp_replace(_or_empty(body), r"\s", "")) >= 40) & related_ & (_or_empty(subject) != "")


def restated_comment_ok(comment: Column, related_: Column) -> Column:
    return (F.length(F.regexp_replace(_or_empty(comment), r"\s", "")) >= 15) & related_


def comment_shown(comment: Column, body: Column) -> Column:
    """A comment, or '' where it is a template or repeats how the text begins."""
    c, b = F.trim(_or_empty(comment)), F.trim(_or_empty(body))
    head = F.substring(c, 1, 50)
    return F.when((c == "") | c.startswith("事件为「") | ((b != "") & b.startswith(head)), F.lit("")).otherwise(_or_empty(comment))


def in_language(original: Column, translated: Column, chinese: bool) -> Column:
    """The translated text where Chinese is asked for and there is one, else the original."""
    return F.coalesce(F.nullif(translated, F.lit("")), original) if chinese else original


def needs_restating(title: Column, description: Column) -> Column:
    """Whether a title or a description has no Han character."""
    return ~has_han(title) | ~has_han(description)
