"""Timestamps in mixed formats, precisions and zones, brought to microseconds of the UTC epoch.

Each value yields an array of all its valid interpretations (instant, order family, prior cost). A source's values are
then read in record order and the cheapest path through the interpretations is taken (Viterbi): a change of order family
and a backward jump in time cost extra. What the feed states about itself (zone, order of all-numeric dates) enters as
cost of the readings that it speaks against. That cost is decisive: to turn a run of k values against the feed costs
5k, and the k + 1 transitions around and inside it save at most 2(k + 1) <= 4k. Where a feed states nothing, all readings
start equal and the neighbours decide.

The search is exact and distributed. Records are cut into blocks by record id. A value with one reading is an anchor;
of a run of anchors only the first and the last touch the search, so the others are left out before it (their cost is
the same on every path). Per block a matrix of cheapest costs from each first to each last interpretation is built, the
matrices of one source are combined in (min, +), and each block is decoded between its now fixed ends. No task ever
holds more than one block or one source's matrices.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import broadcast_if_small, cut_lineage

#: Cost of changing the order family between neighbouring records, and of going back in time.
SWITCH, BACKWARD = 1.0, 1.0
#: A later reading of the same source may lie this far back before it counts as a backward jump.
BACK_SLACK_US = 36 * 3600 * 1_000_000
#: Prior cost of a reading that the feed's own settings speak against; for any run of values above all that transitions can save.
AGAINST_FEED = 2 * (SWITCH + BACKWARD) + 1.0
#: Records in one block of the search.
BLOCK = 100_000

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_US = timedelta(microseconds=1)
#: The beginning of the year 1, before which nothing is a moment here.
_FIRST_US = (datetime(1, 1, 1, tzinfo=timezone.utc) - _EPOCH) // _US

# Month names of the languages that the feeds use.
MONTHS = {
    1: "jan january januar jänner janvier enero janeiro gennaio",
    2: "feb february februar février fevrier febrero fevereiro",
    3: "mar march märz maerz mars marzo março marco",
    4: "apr april avril abril",
    5: "may mai mayo maio",
    6: "jun june juni juin junio junho",
    7: "jul july juli juillet julio julho",
    8: "aug august août aout agosto",
    9: "sep sept september septembre septiembre setembro",
    10: "oct october oktober okt octobre octubre outubro",
    11: "nov november novembre noviembre novembro",
    12: "dec december dezember dez décembre decembre diciembre dezembro",
}
_MONTH = {name: number for number, names in MONTHS.items() for name in names.split()}

# Units of relative times in seconds (a month counts 30 days).
UNITS = {
    "second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000,
    "秒": 1, "秒钟": 1, "分钟": 60, "小时": 3600, "天": 86400, "周": 604800, "星期": 604800, "个月": 2592000,
}

_TIME = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_HALF = r"(?:\s*(?P<half>[ap]\.?m\.?))?"
_ZONE = r"(?:\s*(?P<zone>z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}))?"
_TAIL = rf"(?:(?:\s*,?\s*(?:t|at|à|às|um|a las)?\s*){_TIME}{_HALF}(?:\s*uhr)?{_ZONE})?"
_WEEKDAY = r"(?:[^\W\d]{2,9}\.?,\s*)?"
_RE_EPOCH = re.compile(r"(\d{16}|\d{13}|\d{10})(?:\.(\d+))?")
_RE_BASIC = re.compile(
    rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:t(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d+))?{_ZONE})?"
)
_RE_YMD = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TAIL}")
_RE_HAN = re.compile(
    rf"(?P<y>\d{{4}})\s*年\s*(?P<m>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*日?(?:\s*(?P<han>上午|下午|凌晨|晚上|午前|午後)?\s*{_TIME})?{_ZONE}"
)
_RE_DMONY = re.compile(
    rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?\s+(?:de\s+)?(?P<mon>[^\W\d]{{3,10}})\.?,?\s+(?:de\s+)?(?P<y>\d{{4}}){_TAIL}"
)
_RE_MONDY = re.compile(rf"{_WEEKDAY}(?P<mon>[^\W\d]{{3,10}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}")
_RE_TRAIL = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}){_TAIL}")
_RE_AGO = re.compile(r"(\d+)\s*(seconds?|secs?|minutes?|mins?|hours?|days?|weeks?|months?)\s+ago|(\d+)\s*(秒钟?|分钟|小时|天|周|星期|个月)前")


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


@lru_cache(maxsize=4096)
def _abbreviations(name: str, year: int) -> dict[str, int]:
    """Abbreviations in use in a zone around one year, with their offsets in seconds."""
    zone, found = _zone(name), {}
    for month in range(1, 13):
        for day in (1, 15):
            at = datetime(year, month, day, 12, tzinfo=zone)
            found[at.tzname().lower()] = int(at.utcoffset().total_seconds())
    return found


def _micros(local: datetime, seconds_east: int) -> int:
    return (local.replace(tzinfo=timezone.utc) - _EPOCH) // _US - seconds_east * 1_000_000


def _instants(local: datetime, zone: str | None, feed_tz: str) -> list[int]:
    """Instants that a local time can mean: one for a stated zone; for local time of the feed the earlier one first."""
    if zone:
        zone = zone.lower()
        if zone in ("z", "utc", "gmt"):
            return [_micros(local, 0)]
        if zone[:3] in ("utc", "gmt"):
            zone = zone[3:]
        if zone[0] in "+-":
            digits = zone[1:].replace(":", "")
            hours, minutes = int(digits[:2]), int(digits[2:] or 0)
            if hours > 18 or minutes > 59:
                return []
            return [_micros(local, (hours * 3600 + minutes * 60) * (-1 if zone[0] == "-" else 1))]
        offset = _abbreviations(feed_tz, local.year).get(zone)
        return [] if offset is None else [_micros(local, offset)]
    at = local.replace(tzinfo=_zone(feed_tz))
    first = _micros(local, int(at.utcoffset().total_seconds()))
    later = _micros(local, int(at.replace(fold=1).utcoffset().total_seconds()))
    return [first, later] if later > first else [first]


def _clock(part: dict) -> tuple[int, int, int, int] | None:
    """Hour, minute, second and microsecond of a match; None where they name no time of day."""
    if part.get("h") is None:
        return 0, 0, 0, 0
    hour, minute, second = int(part["h"]), int(part["mi"] or 0), int(part.get("s") or 0)
    half = (part.get("half") or "").replace(".", "")
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "pm" else 0)
    han = part.get("han")
    if han in ("下午", "晚上", "午後") and hour < 12:
        hour += 12
    elif han in ("上午", "凌晨", "午前") and hour == 12:
        hour = 0
    if hour > 23 or minute > 59 or second > 59:
        return None
    return hour, minute, second, int(((part.get("f") or "") + "000000")[:6])


def interpretations(raw: str | None, feed_tz: str | None, date_order: str | None, fetched_us: int | None) -> list[tuple[str, int, float]]:
    """All valid readings of one value as (order family, microseconds, prior cost), the feed's own reading first.

    Blanks, words, impossible dates and hours, and bare months, weeks, quarters or seasons give an empty list.
    """
    if raw is None:
        return []
    text = " ".join(unicodedata.normalize("NFKC", raw).lower().split())
    if not text:
        return []
    feed_tz = feed_tz or "UTC"
    if m := _RE_EPOCH.fullmatch(text):
        digits, rest = m.group(1), m.group(2) or ""
        scale = {10: 6, 13: 3, 16: 0}[len(digits)]
        return [("epoch", int(digits) * 10**scale + (int((rest + "0" * 6)[:scale]) if scale else 0), 0.0)]
    if m := _RE_AGO.fullmatch(text):
        if fetched_us is None:
            return []
        unit, count = (m.group(2) or m.group(4)).removesuffix("s"), (m.group(1) or m.group(3)).lstrip("0") or "0"
        if len(count) > 12:
            return []  # before all calendars
        back = fetched_us - int(count) * UNITS[unit] * 1_000_000
        return [("ago", back, 0.0)] if back >= _FIRST_US else []
    days: list[tuple[str, int, int, int, float]] = []
    if m := _RE_BASIC.fullmatch(text) or _RE_YMD.fullmatch(text) or _RE_HAN.fullmatch(text):
        days.append(("ymd", int(m["y"]), int(m["m"]), int(m["d"]), 0.0))
    elif m := _RE_DMONY.fullmatch(text) or _RE_MONDY.fullmatch(text):
        if m["mon"] not in _MONTH:
            return []
        days.append(("named", int(m["y"]), _MONTH[m["mon"]], int(m["d"]), 0.0))
    elif m := _RE_TRAIL.fullmatch(text):
        a, b, y = int(m["a"]), int(m["b"]), int(m["y"])
        readings = {"dmy": (b, a), "mdy": (a, b)}
        if date_order in readings:
            month, day = readings.pop(date_order)
            days.append((date_order, y, month, day, 0.0))
        days += [(k, y, month, day, AGAINST_FEED * bool(days)) for k, (month, day) in readings.items()]
    else:
        return []
    part = m.groupdict()
    clock = _clock(part)
    if clock is None:
        return []
    out: list[tuple[str, int, float]] = []
    for family, y, month, day, cost in days:
        try:
            local = datetime(y, month, day, *clock)
        except ValueError:
            if cost == 0.0 and date_order in ("dmy", "mdy"):
                return []  # the feed's own order names no day: the value is not a date of this feed
            continue
        try:
            for k, us in enumerate(_instants(local, part.get("zone"), feed_tz)):
                out.append((family, us, cost + AGAINST_FEED * k))
        except (OverflowError, ValueError):
            continue
    return out


def distinct_readings(found: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """One reading for each instant, the cheapest (of equals the first)."""
    best: dict[int, tuple[str, int, float]] = {}
    for x in found:
        if x[1] not in best or x[2] < best[x[1]][2]:
            best[x[1]] = x
    return list(best.values())


FAMILIES = ("epoch", "ago", "ymd", "named", "dmy", "mdy")
_CODE = {name: k for k, name in enumerate(FAMILIES)}
_CAND = "array<struct<family:int,us:bigint,cost:double>>"
_CAND_ARROW = pa.list_(pa.struct([("family", pa.int32()), ("us", pa.int64()), ("cost", pa.float64())]))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tab, rec, source, tz, order, raw = (batch.column(k) for k in range(6))
        fetched = batch.column(6).cast(pa.int64()).to_pylist()
        memo: dict[tuple, list] = {}
        cands = []
        for value, zone, date_order, at in zip(raw.to_pylist(), tz.to_pylist(), order.to_pylist(), fetched):
            key = (value, zone, date_order)
            found = memo.get(key)
            if found is None:
                found = distinct_readings(interpretations(value, zone, date_order, at))
                if not found or found[0][0] != "ago":
                    memo[key] = found
                found = [{"family": _CODE[f], "us": us, "cost": c} for f, us, c in found]
                if key in memo:
                    memo[key] = found
            cands.append(found)
        yield pa.RecordBatch.from_arrays([tab, rec, source, pa.array(cands, _CAND_ARROW)], names=["tab", "rec_id", "source", "cands"])


def candidates(values: DataFrame, feeds: DataFrame) -> DataFrame:
    """(tab, rec_id, source, cands) from values (tab, rec_id, feed_id, raw, fetched_at) and the feeds' settings."""
    known = broadcast_if_small(feeds.select("feed_id", "feed_tz", "date_order").dropDuplicates(["feed_id"]))
    rows = values.select("tab", "rec_id", "feed_id", "raw", "fetched_at").join(known, "feed_id", "left").select(
        "tab",
        "rec_id",
        F.concat_ws("|", "tab", F.col("feed_id").cast("string")).alias("source"),
        F.trim("feed_tz").alias("feed_tz"),
        F.lower(F.trim("date_order")).alias("date_order"),
        F.col("raw").cast("string").alias("raw"),
        F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"),
    )
    return rows.mapInArrow(_parse_batches, f"tab string, rec_id bigint, source string, cands {_CAND}")


def _step(prev: list, cur: list) -> np.ndarray:
    """Costs from each reading of one record to each of the next."""
    pf, pu = np.array([c["family"] for c in prev]), np.array([c["us"] for c in prev], dtype=np.int64)
    cf, cu = np.array([c["family"] for c in cur]), np.array([c["us"] for c in cur], dtype=np.int64)
    cost = np.array([c["cost"] for c in cur], dtype=float)
    return SWITCH * (pf[:, None] != cf[None, :]) + BACKWARD * (cu[None, :] < pu[:, None] - BACK_SLACK_US) + cost[None, :]


def _block_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    seqs = [list(c) for c in pdf["cands"]]
    n = len(seqs[0])
    total = np.full((n, n), np.inf)
    np.fill_diagonal(total, [c["cost"] for c in seqs[0]])
    for prev, cur in zip(seqs, seqs[1:]):
        total = (total[:, :, None] + _step(prev, cur)[None, :, :]).min(axis=1)
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "blk": [int(pdf["blk"].iloc[0])], "first": [seqs[0]], "last": [seqs[-1]], "costs": [total.ravel().tolist()]})


def _fix_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first and last reading of each block on the cheapest path of one source."""
    pdf = pdf.sort_values("blk")
    firsts, lasts = [list(x) for x in pdf["first"]], [list(x) for x in pdf["last"]]
    mats = [np.array(list(c)).reshape(len(f), len(t)) for c, f, t in zip(pdf["costs"], firsts, lasts)]
    best = np.zeros(len(firsts[0]))
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for k, mat in enumerate(mats):
        if k:
            # the matrix counts the prior of its first record already
            link = _step(lasts[k - 1], firsts[k]) - np.array([c["cost"] for c in firsts[k]])[None, :]
            enter = best[:, None] + link
            came, best = enter.argmin(axis=0), enter.min(axis=0)
        else:
            came = np.zeros(len(firsts[0]), dtype=int)
        through = best[:, None] + mat
        back.append((came, through.argmin(axis=0)))
        best = through.min(axis=0)
    ends = []
    last = int(best.argmin())
    for came, via in reversed(back):
        first = int(via[last])
        ends.append((first, last))
        last = int(came[first])
    ends.reverse()
    return pd.DataFrame({"source": pdf["source"], "blk": pdf["blk"], "a": [x for x, _ in ends], "b": [x for _, x in ends]})


def _decode(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chosen instant of every record of a block that has several readings."""
    pdf = pdf.sort_values("seq")
    seqs, first, last = [list(c) for c in pdf["cands"]], int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
    best = np.full(len(seqs[0]), np.inf)
    best[first] = 0.0
    back = []
    for prev, cur in zip(seqs, seqs[1:]):
        through = best[:, None] + _step(prev, cur)
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
    path = [last]
    for via in reversed(back):
        path.append(int(via[path[-1]]))
    path.reverse()
    out = pd.DataFrame({"tab": pdf["tab"], "rec_id": pdf["rec_id"], "instant_us": [s[k]["us"] for s, k in zip(seqs, path)]})
    return out[[len(s) > 1 for s in seqs]]


def search_extent(cands: DataFrame) -> DataFrame:
    """(source, dated, searched): the values of each source that name a moment, and those of several readings that the search decides."""
    return cands.where(F.size("cands") > 0).groupBy("source").agg(F.count("*").alias("dated"), F.count_if(F.size("cands") > 1).alias("searched"))


def choose(cands: DataFrame, block: int = BLOCK) -> DataFrame:
    """One instant for each record that has readings: (tab, rec_id, instant_us), by the cheapest path of its source.

    All records with several readings are searched, with the anchors next to them and the ends of their block; sources
    without such a record have nothing to search. Ties go to the reading that comes first.
    """
    dated = cut_lineage(cands.where(F.size("cands") > 0).withColumn("blk", F.floor(F.col("rec_id") / block).cast("bigint")))
    sure = dated.where(F.size("cands") == 1).select("tab", "rec_id", F.col("cands")[0]["us"].alias("instant_us"))
    open_ = dated.where(F.size("cands") > 1)
    order = Window.partitionBy("source", "blk").orderBy("rec_id", "cands")
    near = dated.join(open_.select("source").distinct(), "source", "left_semi").withColumns(
        {"seq": F.row_number().over(order), "before": F.lag(F.size("cands")).over(order), "after": F.lead(F.size("cands")).over(order)}
    )
    near = near.where((F.size("cands") > 1) | F.coalesce(F.col("before") != 1, F.lit(True)) | F.coalesce(F.col("after") != 1, F.lit(True)))
    near = cut_lineage(near.select("tab", "rec_id", "source", "blk", "seq", "cands"))
    one = "source string, blk bigint, first {0}, last {0}, costs array<double>".format(_CAND)
    matrices = near.groupBy("source", "blk").applyInPandas(_block_matrix, one)
    ends = matrices.groupBy("source").applyInPandas(_fix_ends, "source string, blk bigint, a int, b int")
    some = near.where(F.size("cands") > 1).select("source", "blk").distinct()
    solved = near.join(ends.join(some, ["source", "blk"]), ["source", "blk"]).groupBy("source", "blk").applyInPandas(_decode, "tab string, rec_id bigint, instant_us bigint")
    return sure.unionByName(solved)


def normalise_timestamps(values: DataFrame, feeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tab, rec_id, instant_us) of every value that names a moment or a full day.

    ``values`` has tab, rec_id, feed_id, raw and fetched_at; other columns are ignored. A null raw value, an empty
    text and a relative value without fetched_at give no row; texts are read whole, however long; a feed that is unknown or has no zone counts as
    UTC; repeated rows are each answered; an empty input gives an empty result.
    """
    return choose(candidates(values, feeds), block)
