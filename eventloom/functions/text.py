"""Text expressions: cleaning, keys, similarity, numbers. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fa5}"

# Words that a title key leaves out.
DEDUP_STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "for", "with", "from", "to", "in", "on", "at", "by", "as", "its", "into", "launches", "launch", "launched",
    "launching", "introduces", "introduce", "introduced", "introducing", "announces", "announce", "announced", "announcing", "unveils", "unveil",
    "unveiled", "unveiling", "releases", "release", "released", "releasing", "debuted", "debuts", "debut", "rolling", "rolls", "outs", "opens",
    "open", "opening", "raises", "raise", "raised", "raising", "secures", "secure", "secured", "sets", "set", "reaches", "reach", "valued", "files",
    "file", "backs", "back", "backed", "acquires", "acquire", "acquired", "new", "first", "latest", "today",
]
# Words that a core noun does not begin with.
NOUN_STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "new", "how", "why", "what", "are", "was", "were", "has", "had", "its", "into", "you",
    "your", "can", "not", "will", "introducing", "introduces", "announcing", "announces", "launching", "launches", "launched", "releasing",
    "releases", "released", "updating", "updates", "updated", "unveils", "unveiling", "debuted", "debuts", "opens", "opensourcing",
]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often it occurs there, also within other lambdas."""
    return F.transform(F.array(value), body)[0]


def clean_text(x: Column | str) -> Column:
    """Line breaks and runs of blanks to one space; none before a CJK closing or after an opening mark; trimmed. Null to ''."""
    y = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\s\x{00A0}\x{3000}\x{FEFF}]+", " ")
    y = F.regexp_replace(y, r" +([，。；：、！？）】」』])", "$1")
    return F.trim(F.regexp_replace(y, r"([（【「『]) +", "$1"))


def strip(x: Column | str) -> Column:
    """A text without blanks at its ends, those of Unicode included; '' for null."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^[\s\x{00A0}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{3000}\x{FEFF}]+$", "")


def truncate(x: Column | str, limit: int) -> Column:
    """The text, cut to ``limit`` characters with an ellipsis if it is longer."""
    x = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)


def title_tokens(x: Column | str) -> Column:
    """Distinct lower-case tokens; a run of Han characters is one token."""
    y = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), rf"[^{HAN}a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(y), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 for titles equal but for case, else the Jaccard similarity of their tokens; 0 if either is empty."""
    x, y = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(F.lower(x) == F.lower(y), F.lit(1.0)).otherwise(jaccard(title_tokens(x), title_tokens(y)))


def dedup_key(title: Column | str) -> Column:
    """Key of a title: its first four runs of Han characters, then its words without stop words, cut to 80 characters."""
    low = F.lower(F.coalesce(col(title), F.lit("")))
    han = F.array_join(F.slice(F.regexp_extract_all(low, F.lit(rf"([{HAN}]{{2,}})"), 1), 1, 4), " ")
    words = F.split(F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " ")), " ")
    latin = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*DEDUP_STOP_WORDS)), " ")
    return F.substring(F.array_join(F.filter(F.array(han, latin), lambda p: p != ""), " "), 1, 80)


def core_noun(title: Column | str) -> Column:
    """The longest window of 2 to 5 tokens that does not begin with a stop word (of equals the first), if it has 6
    characters; else the longest run of Han characters; else that window, however short."""
    title = F.coalesce(col(title), F.lit(""))
    longest = lambda xs: F.aggregate(xs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))

    def windows(words: Column) -> Column:
        n = F.size(words)
        at = lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(5), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " "))
        starts = F.filter(F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.element_at(words, i).isin(*NOUN_STOP_WORDS))
        return F.flatten(F.transform(starts, at))

    latin = let(F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9][a-z0-9-]*)"), 1), lambda words: longest(windows(words)))
    han = longest(F.regexp_extract_all(title, F.lit(rf"([{HAN}]{{2,}})"), 1))
    return let(F.struct(latin.alias("latin"), han.alias("han")), lambda x: F.when(F.length(x["latin"]) >= 6, x["latin"]).when(F.length(x["han"]) >= 2, x["han"]).otherwise(x["latin"]))


def stable_id(module: Column | str, primary_key: Column | str, title: Column | str) -> Column:
    """Identifier that a rerun reproduces; null where neither key nor title is given (the caller then makes one up)."""
    module, key = col(module), F.coalesce(col(primary_key), F.lit(""))
    plain = F.lower(F.trim(F.coalesce(col(title), F.lit(""))))
    made = F.concat(F.lit("evt_"), F.substring(module, 1, 2), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", module, key, plain), 256), 1, 12))
    return F.when((key != "") | (plain != ""), made)


def report_id(date: Column | str) -> Column:
    return F.concat(F.lit("report_"), F.replace(col(date).cast("string"), F.lit("-"), F.lit("")))


def task_id(date: Column | str) -> Column:
    """An identifier of a run, different every time."""
    return F.concat(F.lit("task_"), F.replace(col(date).cast("string"), F.lit("-"), F.lit("")), F.lit("_"), F.substring(F.uuid(), 1, 8))


def han_ratio(x: Column | str) -> Column:
    """Share of Han characters among all; 0 for an empty text."""
    x = F.coalesce(col(x), F.lit(""))
    return F.when(F.length(x) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(x, rf"[^{HAN}]", "")) / F.length(x))


def has_han(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit("")).rlike(rf"[{HAN}]")


def first_number(x: Column | str) -> Column:
    """The first number of a text, thousands commas aside; null if there is none."""
    y = F.regexp_extract(F.replace(F.coalesce(col(x), F.lit("")), F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return F.when(y != "", y.cast("double"))


_NUMBER = r"(\d+(?:[.,]\d+)?(?:万|亿|%|％|k|m|K|M)?)"


def number_tokens(x: Column | str) -> Column:
    """Number tokens of a text as written, with their unit."""
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(_NUMBER), 1)


def _number_forms(token: Column) -> Column:
    digits = F.regexp_replace(token, r"[^0-9]", "")
    unit = F.lower(F.regexp_extract(token, r"(万|亿|%|％|k|m|K|M)$", 1))
    return F.array(token, digits, F.concat(digits, unit), F.replace(token, F.lit(","), F.lit(".")))


def allowed_numbers(x: Column | str) -> Column:
    """All forms under which the numbers of a text may be quoted."""
    text = F.coalesce(col(x), F.lit(""))
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[.,]\d+)"), 1), lambda t: F.replace(t, F.lit(","), F.lit(".")))
    tokens = number_tokens(text)
    forms = F.flatten(F.transform(tokens, lambda t: F.slice(_number_forms(t), 1, 3)))
    return F.array_distinct(F.concat(forms, plain))


def untraceable_numbers(text: Column | str, allowed: Column) -> Column:
    """Number tokens of a text of which no form is among the allowed ones."""
    return let(allowed, lambda known: F.filter(number_tokens(text), lambda t: ~F.exists(_number_forms(t), lambda f: F.array_contains(known, f))))


def escape_html(x: Column | str) -> Column:
    y = F.coalesce(col(x), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        y = F.replace(y, F.lit(raw), F.lit(safe))
    return y


def safe_key(x: Column | str) -> Column:
    """A text as a file name: everything but letters, digits, dot, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^A-Za-z0-9._-]", "_")


# Short Han tokens that any two texts of the domain share.
COMMON_TOKENS = [
    "今日", "最新", "发布", "更新", "推出", "上线", "领域", "行业", "公司", "企业", "产品", "模型", "平台", "服务", "宣布", "公布", "成为", "正式", "相关", "以及", "研究", "论文", "方法", "系统", "技术", "数据",
    "结果", "实验", "提出", "使用", "通过", "进行", "可以", "一个", "这个", "问题", "任务", "能力", "效果", "性能", "目前", "已经", "其中", "同时", "此外", "这些", "针对", "基于", "用于", "需要",
]
# Words of four letters or more that name no subject.
SUBJECT_STOP_WORDS = [
    "with", "from", "what", "your", "were", "will", "that", "this", "into", "than", "then", "when", "which", "their", "there", "these", "those", "been", "also", "more", "most", "such", "only", "over", "under",
    "between", "through", "during", "before", "after", "above", "below", "both", "each", "other", "some", "same", "very", "just", "three", "first", "second", "third",
]


def related(subject: Column, text: Column, company: Column) -> Column:
    """Whether a text speaks of a subject: it names the company (or the two share a Han name, one within the other), or a
    word of the subject of four letters or more that is no stop word, or has a token of two to four Han characters in common
    with it that is not common to all. Han runs are cut into tokens of four from the left, as they stand."""
    subject, text, company = (F.coalesce(x, F.lit("")) for x in (subject, text, company))
    low = F.lower(text)
    runs = lambda x, most: F.regexp_extract_all(x, F.lit(rf"([{HAN}]{{2,{most}}})"), 1)
    named = company.rlike("[A-Za-z]") & F.contains(low, F.lower(company))
    parts = runs(company, "")
    alias = F.exists(parts, lambda c: F.contains(text, c)) | let(parts, lambda ps: F.exists(runs(text, ""), lambda r: F.exists(ps, lambda c: F.contains(r, c) | F.contains(c, r))))
    terms = F.filter(F.regexp_extract_all(subject, F.lit(r"\b([A-Za-z][A-Za-z0-9]*[-_.]?[A-Za-z0-9]*)\b"), 1), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*SUBJECT_STOP_WORDS))
    shared = F.arrays_overlap(F.filter(runs(subject, 4), lambda t: ~t.isin(*COMMON_TOKENS)), runs(text, 4))
    termed = let(low, lambda x: F.exists(terms, lambda w: F.contains(x, F.lower(w))))
    return (text != "") & (named | alias | termed | shared)
