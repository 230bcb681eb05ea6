"""Queries of the general data-preparation operators: timestamps and histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import history, timestamps
from eventloom.session import table


def timestamp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, feed_id, raw, fetched_at) of both event tables."""
    events = table(spark, sf_dir, "standard_events").select(
        F.lit("standard_events").alias("tab"), F.col("row_id").alias("rec_id"), "feed_id", F.col("time").alias("raw"), F.lit(None).cast("timestamp").alias("fetched_at")
    )
    raw = table(spark, sf_dir, "enterprise_raw_events").select(
        F.lit("enterprise_raw_events").alias("tab"), F.col("raw_id").alias("rec_id"), "feed_id", F.col("published_at").alias("raw"), F.col("fetched_at").cast("timestamp").alias("fetched_at")
    )
    return events.unionByName(raw)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise_timestamps(timestamp_values(spark, sf_dir), table(spark, sf_dir, "source_feeds"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.star_history(table(spark, sf_dir, "star_snapshots"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p3_found": p3_found}


# What zone abbreviations mean in the feeds' zones, in minutes east.
_ABBREVIATIONS = {
    "America/Chicago": {"cst": -360, "cdt": -300}, "America/Los_Angeles": {"pst": -480, "pdt": -420}, "America/New_York": {"est": -300, "edt": -240},
    "Asia/Kolkata": {"ist": 330}, "Asia/Shanghai": {"cst": 480}, "Asia/Tokyo": {"jst": 540}, "Australia/Sydney": {"aest": 600, "aedt": 660},
    "Europe/Berlin": {"cet": 60, "cest": 120}, "Europe/Paris": {"cet": 60, "cest": 120}, "Europe/London": {"bst": 60},
}


def _timestamp_sql() -> str:
    """The rules of problem 2 as calendar arithmetic: notations by pattern, the feed's order and zone as stated."""
    zone = r"(?: ?(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}))?"
    time = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    tail = rf"(?:(?: ?,? ?(?:t|at|à|às|um|a las)? ?){time}(?: ?([ap]\.?m\.?))?(?: ?uhr)?{zone})?"
    weekday = r"(?:\pL{2,9}\.?, ?)?"
    clock = ["h", "mi", "s", "f", "half", "zone"]
    kinds = {
        "basic": (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{zone})?", ["y", "m", "d", "h", "mi", "s", "f", "zone"]),
        "ymd": (rf"(\d{{4}})([-/.])(\d{{1,2}})([-/.])(\d{{1,2}}){tail}", ["y", "s1", "m", "s2", "d", *clock]),
        "han": (rf"(\d{{4}}) ?年 ?(\d{{1,2}}) ?月 ?(\d{{1,2}}) ?日?(?: ?(上午|下午|凌晨|晚上|午前|午後)? ?{time})?{zone}", ["y", "m", "d", "han", "h", "mi", "s", "f", "zone"]),
        "dmony": (rf"{weekday}(\d{{1,2}})(?:\.|er|st|nd|rd|th)? +(?:de +)?(\pL{{3,10}})\.?,? +(?:de +)?(\d{{4}}){tail}", ["d", "mon", "y", *clock]),
        "mondy": (rf"{weekday}(\pL{{3,10}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){tail}", ["mon", "d", "y", *clock]),
        "trail": (rf"(\d{{1,2}})([-/.])(\d{{1,2}})([-/.])(\d{{4}}){tail}", ["a", "s1", "b", "s2", "y", *clock]),
    }
    fields = ["y", "m", "d", "a", "b", "mon", "h", "mi", "s", "f", "half", "han", "zone", "s1", "s2"]
    parts = []
    for kind, (pattern, names) in kinds.items():
        listed = "[" + ",".join(f"'{n}'" for n in names) + "]"
        cells = ", ".join(f"x.{n} AS {n}" if n in names else f"'' AS {n}" for n in fields)
        parts.append(f"SELECT tab, rec_id, tz, ord, '{kind}' AS kind, {cells} FROM (SELECT *, regexp_extract(t, '^{pattern}$', {listed}) AS x FROM n WHERE regexp_full_match(t, '{pattern}'))")
    months = "MAP {" + ", ".join(f"'{name}': {number}" for number, names in timestamps.MONTHS.items() for name in names.split()) + "}"
    units = "MAP {" + ", ".join(f"'{name}': {seconds}" for name, seconds in timestamps.UNITS.items()) + "}"
    zones = ", ".join(f"('{tz}','{name}',{minutes})" for tz, of in _ABBREVIATIONS.items() for name, minutes in of.items())
    wide = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
    plain = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''") + " "
    return rf"""
        WITH v AS (
          SELECT 'standard_events' AS tab, row_id AS rec_id, feed_id, time AS raw, CAST(NULL AS BIGINT) AS fetched FROM standard_events
          UNION ALL SELECT 'enterprise_raw_events', raw_id, feed_id, published_at, epoch_us(fetched_at) FROM enterprise_raw_events),
        n AS (
          SELECT tab, rec_id, fetched, coalesce(trim(feed_tz), 'UTC') AS tz, lower(trim(date_order)) AS ord,
                 trim(regexp_replace(lower(translate(raw, '{wide}', '{plain}')), '[\s\x{{00A0}}]+', ' ', 'g')) AS t
          FROM v LEFT JOIN source_feeds USING (feed_id) WHERE raw IS NOT NULL),
        epoch AS (
          SELECT tab, rec_id, regexp_extract(t, '^(\d+)', 1) AS digits, regexp_extract(t, '\.(\d+)$', 1) AS rest FROM n WHERE regexp_full_match(t, '(\d{{10}}|\d{{13}}|\d{{16}})(\.\d+)?')),
        ago AS (
          SELECT tab, rec_id, fetched, regexp_extract(t, '^(\d+) ?([a-z]+|秒钟?|分钟|小时|天|周|星期|个月) ?(?:ago|前)$', ['k','u']) AS x FROM n
          WHERE fetched IS NOT NULL AND regexp_full_match(t, '\d+ ?(seconds?|secs?|minutes?|mins?|hours?|days?|weeks?|months?) ago|\d+ ?(秒钟?|分钟|小时|天|周|星期|个月)前')),
        parts AS ({" UNION ALL ".join(parts)}),
        days AS (
          SELECT tab, rec_id, tz, zone, CAST(y AS INT) AS y,
                 CASE WHEN kind = 'trail' THEN CAST(CASE WHEN ord = 'mdy' THEN a ELSE b END AS INT) WHEN mon <> '' THEN ({months})[mon] ELSE CAST(m AS INT) END AS m,
                 CAST(CASE WHEN kind = 'trail' THEN CASE WHEN ord = 'mdy' THEN b ELSE a END ELSE d END AS INT) AS d,
                 coalesce(TRY_CAST(h AS INT), 0) AS h0, coalesce(TRY_CAST(mi AS INT), 0) AS mi, coalesce(TRY_CAST(s AS INT), 0) AS s,
                 CAST(substr(f || '000000', 1, 6) AS INT) AS us, replace(half, '.', '') AS half, han
          FROM parts WHERE s1 = s2),
        clocked AS (
          SELECT *, CASE WHEN half = 'am' THEN h0 % 12 WHEN half = 'pm' THEN h0 % 12 + 12 WHEN han IN ('下午','晚上','午後') AND h0 < 12 THEN h0 + 12
                         WHEN han IN ('上午','凌晨','午前') AND h0 = 12 THEN 0 ELSE h0 END AS h
          FROM days WHERE (half = '' OR h0 BETWEEN 1 AND 12) AND TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL),
        timed AS (
          SELECT *, make_timestamp(y, m, d, h, mi, CAST(s AS DOUBLE)) + to_microseconds(us) AS loc,
                 regexp_extract(zone, '^(?:utc|gmt)?([+-])(\d{{1,2}}):?(\d{{2}})?$', ['sign','zh','zm']) AS o
          FROM clocked WHERE h <= 23 AND mi <= 59 AND s <= 59),
        placed AS (
          SELECT tab, rec_id, timed.tz, loc,
                 CASE WHEN zone IN ('z','utc','gmt') THEN 0
                      WHEN o.sign <> '' THEN CASE WHEN CAST(o.zh AS INT) <= 18 AND coalesce(TRY_CAST(o.zm AS INT),0) <= 59 THEN (CAST(o.zh AS INT)*60 + coalesce(TRY_CAST(o.zm AS INT),0)) * CASE o.sign WHEN '-' THEN -1 ELSE 1 END END
                      WHEN zone <> '' THEN a.minutes END AS east, zone = '' AS floating
          FROM timed LEFT JOIN (VALUES {zones}) AS a(tz, name, minutes) ON a.tz = timed.tz AND a.name = zone),
        local_ AS (SELECT *, timezone(tz, loc) AS moment FROM placed WHERE floating),
        settled AS (
          SELECT tab, rec_id, CASE WHEN timezone(tz, moment - INTERVAL 1 HOUR) = loc THEN moment - INTERVAL 1 HOUR ELSE moment END AS moment FROM local_)
        SELECT tab, rec_id, CAST(digits AS BIGINT) * CASE length(digits) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END
               + CASE length(digits) WHEN 10 THEN CAST(substr(rest || '000000', 1, 6) AS BIGINT) WHEN 13 THEN CAST(substr(rest || '000', 1, 3) AS BIGINT) ELSE 0 END AS instant_us FROM epoch
        UNION ALL SELECT tab, rec_id, fetched - CAST(x.k AS BIGINT) * ({units})[rtrim(x.u, 's')] * 1000000 FROM ago
        UNION ALL SELECT tab, rec_id, epoch_us(loc) - CAST(east AS BIGINT) * 60000000 FROM placed WHERE NOT floating AND east IS NOT NULL
        UNION ALL SELECT tab, rec_id, epoch_us(moment) FROM settled"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _timestamp_sql(),
        "p3_found": r"""
            WITH clean AS (
              SELECT snap_id, stars,
                     epoch_ms(CAST(trim(replace(fetched_at, 'T', ' ')) AS TIMESTAMPTZ)) AS ms,
                     regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                       lower(trim(repo_url)), '[?#].*$', ''), '^[a-z+]+://', ''), '^[^/@]*@', ''), '^www\.', ''),
                       '^([^/:]+):', '\1/'), '(\.git)?/*$', '') AS k
              FROM star_snapshots WHERE stars >= 0),
            keyed AS (SELECT regexp_replace(k, '\.git$', '') AS repo_key, ms, stars, snap_id FROM clean),
            one AS (
              SELECT repo_key, ms, stars FROM (
                SELECT *, row_number() OVER (PARTITION BY repo_key, ms ORDER BY snap_id DESC) AS r FROM keyed) WHERE r = 1),
            changed AS (
              SELECT * FROM (
                SELECT *, lag(stars) OVER (PARTITION BY repo_key ORDER BY ms) AS before FROM one)
              WHERE before IS NULL OR before <> stars)
            SELECT repo_key,
                   strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS valid_from,
                   coalesce(strftime(make_timestamp(lead(ms) OVER (PARTITION BY repo_key ORDER BY ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS valid_to,
                   stars
            FROM changed""",
    }
