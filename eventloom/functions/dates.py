"""Date expressions. An unknown date is null; nothing is ever taken for today."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import col

# Source types whose records are dated by nature.
FIRST_PARTY_TYPES = ("official", "official_rss", "github_repo", "arxiv", "openalex", "modelscope", "huggingface", "domestic_official")
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def flexible_date(x: Column | str, as_of: Column | None = None) -> Column:
    """``YYYY-MM-DD`` from the first notation found, in fixed order, without a check of ranges; null if there is none.

    Relative Chinese times count back from the timestamp ``as_of`` and are null without it.
    """
    x = F.coalesce(col(x), F.lit(""))
    get = lambda pattern, k: F.regexp_extract(x, pattern, k)
    dash = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    other = r"(\d{4})[年./](\d{1,2})[月./](\d{1,2})日?"
    rfc = rf"^\s*(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s*)?(\d{{1,2}})\s+({'|'.join(_MONTHS)})\s+(\d{{4}})\b"
    month = F.element_at(F.create_map(*[F.lit(v) for k, m in enumerate(_MONTHS, 1) for v in (m, str(k))]), F.when(x.rlike(rfc), get(rfc, 2)))
    ago = r"(\d+)\s*(小时|天|周|个月)前"
    out = F.when(x.rlike(dash), _ymd(get(dash, 1), get(dash, 2), get(dash, 3)))
    out = out.when(x.rlike(other), _ymd(get(other, 1), get(other, 2), get(other, 3)))
    out = out.when(x.rlike(rfc), _ymd(get(rfc, 3), month, get(rfc, 1)))
    if as_of is not None:
        unit = get(ago, 2)
        hours = F.when(unit == "小时", 1).when(unit == "天", 24).when(unit == "周", 168).otherwise(720)
        back = F.timestamp_seconds(F.unix_seconds(as_of) - F.try_to_number(get(ago, 1), F.lit("9999999999")).cast("long") * hours * 3600)
        out = out.when(x.rlike(ago), F.date_format(back, "yyyy-MM-dd"))
    return out


def day_diff(later: Column, earlier: Column) -> Column:
    """Whole days between two dates given as text or date; null if either is none."""
    return F.datediff(later.try_cast("date"), earlier.try_cast("date"))


def url_date(x: Column | str) -> Column:
    """The valid date in a URL path ``/20yy/m/d/``, else null."""
    p = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
    x = F.coalesce(col(x), F.lit(""))
    return F.when(x.rlike(p), _ymd(F.regexp_extract(x, p, 1), F.regexp_extract(x, p, 2), F.regexp_extract(x, p, 3)).try_cast("date"))


def source_has_date(source: Column) -> Column:
    """Whether a piece of evidence is dated: by its own date, by its type, or by the path of its URL."""
    return (
        (F.coalesce(source["published_at"], F.lit("")) != "")
        | F.coalesce(source["source_type"].isin(*FIRST_PARTY_TYPES), F.lit(False))
        | F.coalesce(source["url"], F.lit("")).rlike(r"/(20\d{2})/(\d{1,2})/(\d{1,2})/")
    )


def within_days(report_date: Column, time: Column, days: int) -> Column:
    """Whether a date lies in the window of ``days`` calendar days that ends with the report date; missing is out."""
    return F.coalesce(day_diff(report_date, time).between(0, days - 1), F.lit(False))


def time_bucket(report_date: Column, time: Column) -> Column:
    """Bucket of a date for merging: days before the report, at most 7; 0 for future ones, 'no-date' without date."""
    return F.coalesce(F.least(F.lit(7), F.greatest(F.lit(0), day_diff(report_date, time))).cast("string"), F.lit("no-date"))


def iso_date(x: Column) -> Column:
    """A timestamp's day in UTC as text; '' for none."""
    return F.coalesce(F.date_format(x.try_cast("timestamp"), "yyyy-MM-dd"), F.lit(""))


def iso_datetime(x: Column) -> Column:
    """A timestamp in UTC as text with milliseconds; '' for none."""
    return F.coalesce(F.date_format(x.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def hours_ago(as_of: Column, hours: int) -> Column:
    return iso_datetime(F.timestamp_micros(F.unix_micros(as_of.cast("timestamp")) - hours * 3_600_000_000))


def days_ago(as_of: Column, days: int) -> Column:
    return hours_ago(as_of, 24 * days)
