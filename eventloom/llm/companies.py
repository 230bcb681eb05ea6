"""Typed company names mapped to the entries of a reference list, by a partition-based pigeonhole join.

A typed value is cleaned with built-in functions only (widths, accents, look-alike letters, quotes, legal forms, asides).
Reference strings are the names and aliases, the leading word of a name where no other entry shares it, and names with
an abbreviated second word. A reference string within k edits of a typed one shares at least one of its k+1 segments
unchanged, at a position that the edits can shift by only so much; hence an equality join on (length, segment number,
segment text) finds every candidate. k is at least what the verification accepts; an abbreviation counts as it is, its one
segment being the whole. Candidates are verified with ``levenshtein``: each word may differ by one edit or one swap of
neighbours. Values without a verified candidate come out through an anti-join as -1. Everything is a join of distinct
values on equal columns; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, cut_lineage

#: Edits that the join tolerates in a reference string of at least so many characters, of one word and of two: the swap that
#: the verification accepts in a word counts as two.
EDITS = ((12, 4), (5, 2))
EDITS_TWO_WORDS = ((7, 4), (5, 2))
MOST_EDITS = 4
#: Parts into which the records of one value are spread where the mapping is too large to broadcast.
SALTS = 16
#: Shortest leading word or abbreviation that counts.
HEAD_MIN, ABBREVIATION_MIN = 5, 3

# Letters that look like a Latin one, and Latin letters with marks.
_LOOKALIKE = ("аеорсухкмнтвіјѕԁ", "aeopcyxkmhtbijsd")
_MARKED = ("áàâäãåāăąçćčďđéèêëēėęěğíìîïīįıłńñňóòôöõøōőřśšşťúùûüūůűýÿźžż", "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorssstuuuuuuuyyzzz")
# Words that surround a name without belonging to it.
_LEGAL = (
    "inc|incorporated|ltd|limited|llc|llp|gmbh|ag|corp|corporation|co|company|group|holdings?|plc|pvt|pte|sa|s\\.a|sas|sarl|"
    "bv|b\\.v|nv|n\\.v|oy|ab|kg|se|spa|s\\.p\\.a|srl|kk|k\\.k|ai|official|hq"
)
_HAN_TAIL = "股份有限公司|有限责任公司|有限公司|公司|集团|官方|团队|研究院|控股"
_HAN_TRADE = "科技|数据|智能|算力|云图|机器人|网络|系统|实验室|动力|分析|半导体|认知|计算"


def _wide(x: Column) -> Column:
    wide = "".join(chr(0xFF01 + k) for k in range(94)) + "　   \t\n\r"
    return F.translate(x, wide, "".join(chr(0x21 + k) for k in range(94)) + " " * 7)


def with_clean_name(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` with a typed name in lower case: words joined by single spaces, or its Han characters alone if it has any.

    Done in steps, so that no step's expression is evaluated twice.
    """
    x = F.regexp_replace(_wide(F.col(raw)), r"([\p{Ll}])([\p{Lu}][\p{Ll}]{2})", "$1 $2")
    x = F.lower(x)
    x = F.translate(F.translate(x, *_LOOKALIKE), *_MARKED)
    x = F.regexp_replace(x, r"[\x{200B}-\x{200F}\x{FEFF}\x{00AD}]", "")
    x = F.regexp_replace(x, r"\([^()]*\)?|\[[^\]]*\]?|<[^>]*>?", " ")
    x = F.regexp_replace(x, r"[\s.,;:!?。，]+$", "")
    df = df.withColumn("_x", F.regexp_replace(x, rf"[\s,]*(?:{_HAN_TAIL})+$", ""))
    x = F.regexp_replace("_x", r"^\W*(?:.* )?by +(?=\S)", "")
    x = F.regexp_replace(x, r" +[–—/|].*$| +- .*$|, *[\p{L} ]+ office *$", "")
    x = F.regexp_replace(x, r"\.(?:example|test|invalid|com|cn|io|org|net|co)\W*$", "")
    x = F.regexp_replace(x, r"^[^\p{L}\p{N}]*(?:(?:the|by|team|the team at|from) +)*", "")
    x = F.regexp_replace(x, rf"(?:[\s,._-]+(?:{_LEGAL})\b)+[^\p{{L}}\p{{N}}]*$", "")
    df = df.withColumn("_x", F.regexp_replace(x, r"^([\p{L}]+), +([\p{L}]+)\W*$", "$2 $1"))
    df = df.withColumn("_han", F.regexp_replace(F.regexp_replace("_x", r"[^\p{IsHan}]", ""), rf"(?:{_HAN_TAIL})+$", ""))
    latin = F.trim(F.regexp_replace(F.regexp_replace("_x", r"['’`]", ""), r"[^\p{L}\p{N}]+", " "))
    return df.withColumn(out, F.when(F.length("_han") >= 2, F.col("_han")).otherwise(latin)).drop("_x", "_han")


def reference_strings(pool: DataFrame) -> DataFrame:
    """(company_id, ref, w1, rest): the cleaned names and aliases, and leading words that only one entry has."""
    names = pool.select("company_id", F.explode(F.concat(F.array("company"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    # cut here, or the optimiser would copy the whole cleaning into every later use of it
    full = cut_lineage(with_clean_name(names, "name", "name").select("company_id", "name")).where(F.length("name") >= 2).distinct()
    full = full.withColumn("w1", F.split("name", " ")[0]).withColumn("rest", F.expr("replace(substring(name, length(w1) + 2), ' ', '')"))
    trade = F.regexp_extract("name", rf"^(\p{{IsHan}}{{2,}}?)(?:{_HAN_TRADE})$", 1)
    heads = full.select("company_id", F.when(F.length(trade) > 0, trade).otherwise(F.col("w1")).alias("name"))
    one = heads.groupBy("name").agg(F.min("company_id").alias("company_id"), F.countDistinct("company_id").alias("n")).where("n = 1")
    one = one.where((F.length("name") >= HEAD_MIN) | F.col("name").rlike(r"^\p{IsHan}{2,}$"))
    heads = one.select("company_id", "name", F.col("name").alias("w1"), F.lit("").alias("rest"))
    ref = full.select("company_id", "name", "w1", "rest").unionByName(heads)
    ref = ref.select("company_id", F.regexp_replace("name", " ", "").alias("ref"), "w1", "rest", F.lit(False).alias("short"))
    # an abbreviated second word: what it begins with
    lengths = F.when(F.length("rest") > ABBREVIATION_MIN, F.sequence(F.lit(ABBREVIATION_MIN), F.length("rest") - 1)).otherwise(F.array().cast("array<int>"))
    short = full.where("rest <> ''").select("company_id", "w1", "rest", F.explode(lengths).alias("n")).select("company_id", "w1", F.expr("substring(rest, 1, n)").alias("rest"))
    return ref.unionByName(short.select("company_id", F.concat("w1", "rest").alias("ref"), "w1", "rest", F.lit(True).alias("short"))).distinct()


def _edits(length: Column, two: Column) -> Column:
    k, l = F.lit(0), F.lit(0)
    for least, edits in reversed(EDITS):
        k = F.when(length >= least, F.lit(edits)).otherwise(k)
    for least, edits in reversed(EDITS_TWO_WORDS):
        l = F.when(length >= least, F.lit(edits)).otherwise(l)
    return F.when(two, F.greatest(k, l)).otherwise(k)


def _segments(refs: DataFrame) -> DataFrame:
    """Each reference string cut into k+1 segments: (len, k, i, seg_pos, seg, seg_len) besides the columns of ``refs``."""
    whole = F.col("short") if "short" in refs.columns else F.lit(False)
    cut = refs.withColumn("len", F.length("ref")).withColumn("k", F.when(whole, F.lit(0)).otherwise(_edits(F.col("len"), F.col("rest") != "")))
    cut = cut.withColumn("i", F.explode(F.expr("sequence(0, k)")))
    start = F.floor(F.col("len") * F.col("i") / (F.col("k") + 1)).cast("int")
    stop = F.floor(F.col("len") * (F.col("i") + 1) / (F.col("k") + 1)).cast("int")
    return cut.withColumn("seg_pos", start).withColumn("seg", F.expr("substring(ref, {0} + 1, {1} - {0})".format("floor(len * i / (k + 1))", "floor(len * (i + 1) / (k + 1))"))).withColumn("seg_len", stop - start)


def _probes(typed: DataFrame, shapes: DataFrame) -> DataFrame:
    """Substrings of typed strings at the places where a segment of a reference string of near length can lie."""
    x = typed.withColumn("tlen", F.length("squashed"))
    x = x.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("tlen") - MOST_EDITS), F.col("tlen") + MOST_EDITS)))
    x = x.join(shapes, "len").where(F.abs(F.col("tlen") - F.col("len")) <= F.col("k"))
    at = F.expr(
        "transform(sequence(seg_pos - (k - (tlen - len)) div 2, seg_pos + (k + (tlen - len)) div 2),"
        " p -> if(p >= 0 and p + seg_len <= tlen, substring(squashed, p + 1, seg_len), null))"
    )
    return x.withColumn("seg", F.explode(F.array_distinct(at))).where("seg is not null").select("clean", "squashed", "tw1", "trest", "len", "k", "i", "seg")


def _near(a: Column, b: Column) -> Column:
    """Equal, one edit apart, or two neighbouring characters swapped."""
    d = F.levenshtein(a, b, 2)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d.between(0, 1)) | swapped


def match_names(typed: DataFrame, pool: DataFrame) -> DataFrame:
    """(company, company_id) for each distinct non-blank ``company`` of ``typed``; -1 where the pool has no such entry.

    Null and blank values give no row. Of several entries the one with the fewest edits holds, then the smaller id;
    a leading word that several entries share names none of them. Empty tables give an empty result, an empty pool
    -1 for every value. Very long texts are cleaned as a whole and match nothing.
    """
    blank = F.length(F.trim(_wide(F.col("company")))) > 0
    values = typed.select("company").where(blank).distinct()
    values = cut_lineage(with_clean_name(values, "company", "clean"))
    cleaned = values.select("clean").where(F.length("clean") >= 2).distinct()
    cleaned = cleaned.withColumn("tw1", F.split("clean", " ")[0]).withColumn("trest", F.expr("replace(substring(clean, length(tw1) + 2), ' ', '')"))
    cleaned = cleaned.withColumn("squashed", F.regexp_replace("clean", " ", ""))
    refs = cut_lineage(reference_strings(pool))
    segments = _segments(refs)
    shapes = broadcast_if_small(segments.select("len", "k", "i", "seg_pos", "seg_len").distinct())
    cand = _probes(cleaned, shapes).join(broadcast_if_small(segments), ["len", "k", "i", "seg"])
    whole = F.levenshtein("squashed", "ref", 4)
    two = (F.col("trest") != "") & (F.col("rest") != "")
    same = F.when(two, _near(F.col("tw1"), F.col("w1")) & _near(F.col("trest"), F.col("rest"))).otherwise(
        F.when((F.col("trest") == "") & (F.col("rest") == ""), _near(F.col("squashed"), F.col("ref"))).otherwise(F.col("squashed") == F.col("ref"))
    )
    abbreviated = (F.col("tw1") == F.col("w1")) & (F.col("trest") == F.col("rest"))
    found = cand.where(F.when(F.col("short"), abbreviated).otherwise(same)).select("clean", "company_id", F.when(F.col("short"), F.lit(5)).otherwise(whole).alias("edits"))
    best = Window.partitionBy("clean").orderBy("edits", "company_id")
    matched = found.groupBy("clean", "company_id").agg(F.min("edits").alias("edits")).withColumn("r", F.row_number().over(best)).where("r = 1").select("clean", "company_id")
    hits = values.join(matched, "clean").select("company", "company_id")
    missing = values.join(matched, "clean", "left_anti").select("company", F.lit(-1).cast("bigint").alias("company_id"))
    return hits.select("company", F.col("company_id").cast("bigint").alias("company_id")).unionByName(missing)


def map_records(records: DataFrame, pool: DataFrame) -> DataFrame:
    """(tab, rec_id, company_id) of every record (tab, rec_id, company) whose company is neither null nor blank."""
    rows, mapping = records.select("tab", "rec_id", "company"), cut_lineage(match_names(records, pool))
    small = broadcast_if_small(mapping)
    if small is not mapping:
        return rows.join(small, "company").select("tab", "rec_id", "company_id")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("tab", "rec_id"), F.lit(SALTS)).cast("int"))
    return salted.join(mapping.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["company", "_salt"]).select("tab", "rec_id", "company_id")
