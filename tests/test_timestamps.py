import itertools
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventloom.operators import timestamps as T


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2026-03-08", "America/New_York", "mdy", us(2026, 3, 8, 5)),
    ("20260308", "UTC", "ymd", us(2026, 3, 8)),
    ("2026年3月29日 下午1:37", "Asia/Shanghai", "ymd", us(2026, 3, 29, 5, 37)),
    ("２０２６－０７－２７ ００：０５", "UTC", "ymd", us(2026, 7, 27, 0, 5)),
    ("24/01/2026 22:36", "Europe/London", "dmy", us(2026, 1, 24, 22, 36)),
    ("6/19/2026 3:51 AM", "America/Chicago", "mdy", us(2026, 6, 19, 8, 51)),
    ("25.10.2026", "Europe/Berlin", "dmy", us(2026, 10, 24, 22)),
    ("Sat, 29 Nov 2025 14:52:29 GMT", "Asia/Tokyo", "ymd", us(2025, 11, 29, 14, 52, 29)),
    ("21 Jul 2026 03:50:19 CDT", "America/Chicago", "mdy", us(2026, 7, 21, 8, 50, 19)),
    ("31 Oct 2025 21:18:44 IST", "Asia/Kolkata", "dmy", us(2025, 10, 31, 15, 48, 44)),
    ("29. März 2026, 01:25 Uhr", "Europe/Berlin", "dmy", us(2026, 3, 29, 0, 25)),
    ("13 de outubro de 2026 às 20:16", "America/Sao_Paulo", "dmy", us(2026, 10, 13, 23, 16)),
    ("20 septembre 2026 à 8h22", "Europe/Paris", "dmy", us(2026, 9, 20, 6, 22)),
    ("Dec 12, 2025 at 12:22am", "UTC", "ymd", us(2025, 12, 12, 0, 22)),
    ("2026-11-01 01:30", "America/New_York", "mdy", us(2026, 11, 1, 5, 30)),  # occurs twice: the earlier
    ("2026-03-08 02:30", "America/New_York", "mdy", us(2026, 3, 8, 7, 30)),  # does not occur: moved on
    ("2026-02-06T13:08:18.029065607Z", "UTC", "ymd", us(2026, 2, 6, 13, 8, 18) + 29065),
    ("2026-10-10T01:00:00,493+05:45", "UTC", "ymd", us(2026, 10, 9, 19, 15) + 493000),
    ("1759492158", "UTC", "ymd", 1759492158 * 10**6),
    ("1767963335.4669", "UTC", "ymd", 1767963335466900),
    ("1766800733464", "UTC", "ymd", 1766800733464000),
    ("1789372635612330", "UTC", "ymd", 1789372635612330),
]
NONE = [None, "", " ", "日期不详", "n.d.", "Q3 2026", "Spring 2026", "week 3 of 2026", "Mar 2026", "v2025.2", "25:61", "2026-02-30", "2026-13-01", "2025-04-22T31:00:00Z", "6 moons ago", "2026年16月7日", "x" * 100_000]


@pytest.mark.parametrize("raw,tz,order,want", CASES)
def test_value(raw, tz, order, want):
    assert T.interpretations(raw, tz, order, None)[0][1] == want


@pytest.mark.parametrize("raw", NONE)
def test_no_moment(raw):
    assert T.interpretations(raw, "Europe/Berlin", "dmy", us(2026, 1, 1)) == []


def test_order_of_the_feed_decides():
    assert T.interpretations("13/02/2026", "UTC", "mdy", None) == []
    costs = lambda order: [c for _, _, c in T.distinct_readings(T.interpretations("05/02/2026", "UTC", order, None))]
    assert costs("dmy") == [0.0, T.AGAINST_FEED] and costs(None) == [0.0, 0.0]
    assert len(T.distinct_readings(T.interpretations("05/05/2026", "UTC", None, None))) == 1


def test_long_values_are_read_whole():
    assert T.interpretations("2026-02-06T13:08:18." + "1" * 50 + "Z", "UTC", "ymd", None)[0][1] == us(2026, 2, 6, 13, 8, 18) + 111111
    assert T.interpretations("2026-02-06T13:08:18." + "1" * 50_000 + "Z", "UTC", "ymd", None)[0][1] == us(2026, 2, 6, 13, 8, 18) + 111111
    assert T.interpretations("9" * 5000 + " days ago", "UTC", "ymd", us(2026, 1, 1)) == []
    assert T.interpretations("0" * 80 + "3 days ago", "UTC", "ymd", us(2026, 1, 4))[0][1] == us(2026, 1, 1)


def test_feeds_that_state_nothing_are_read_by_their_neighbours(spark):
    """The order is that of the unambiguous neighbours; where the feed states one, no neighbour outweighs it."""
    days = ["13/01/2026", "05/02/2026", "06/03/2026", "25/03/2026"]
    rows = [("t", 10 * feed + k, feed, day) for feed in (1, 2, 3) for k, day in enumerate(days)]
    rows += [("t", 40 + k, 4, d) for k, d in enumerate(["2026-02-01", "03/02/2026", "2026-02-05"])]
    df = spark.createDataFrame(rows, "tab string, rec_id long, feed_id int, raw string").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    feeds = spark.createDataFrame([(1, "UTC", None), (2, None, "dmy"), (3, "UTC", "mdy"), (4, "UTC", None)], "feed_id int, feed_tz string, date_order string")
    for block in (2, 1000):
        got = {r.rec_id: r.instant_us for r in T.normalise_timestamps(df, feeds, block).collect()}
        for feed in (1, 2):
            assert [got[10 * feed + k] for k in range(4)] == [us(2026, 1, 13), us(2026, 2, 5), us(2026, 3, 6), us(2026, 3, 25)]
        assert [got.get(30 + k) for k in range(4)] == [None, us(2026, 5, 2), us(2026, 6, 3), None]
        assert got[41] == us(2026, 2, 3)  # between its neighbours in time; the other reading is a backward jump
    extent = {r.source: (r.dated, r.searched) for r in T.search_extent(T.candidates(df, feeds)).collect()}
    assert extent == {"t|1": (4, 2), "t|2": (4, 2), "t|3": (2, 2), "t|4": (3, 1)}


def test_the_feed_is_decisive_for_any_run(spark):
    """Runs of values whose neighbours all speak for the other order keep the feed's."""
    rows = [("t", 0, 1, "2026-01-01")] + [("t", k, 1, f"0{k % 9 + 1}/01/2026") for k in range(1, 30)] + [("t", 30, 1, "2026-01-02")]
    df = spark.createDataFrame(rows, "tab string, rec_id long, feed_id int, raw string").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    feeds = spark.createDataFrame([(1, "UTC", "mdy")], "feed_id int, feed_tz string, date_order string")
    got = {r.rec_id: r.instant_us for r in T.normalise_timestamps(df, feeds, 7).collect()}
    assert all(got[k] == us(2026, k % 9 + 1, 1) for k in range(1, 30))


def test_relative():
    at = us(2026, 5, 10, 12)
    assert T.interpretations("2 months ago", "UTC", "ymd", at)[0][1] == at - 60 * 86400 * 10**6
    assert T.interpretations("3 周前", "UTC", "ymd", at)[0][1] == at - 21 * 86400 * 10**6
    assert T.interpretations("3 days ago", "UTC", "ymd", None) == []


def _cost(seqs, path):
    total = seqs[0][path[0]]["cost"]
    for (a, b), (x, y) in zip(zip(seqs, seqs[1:]), zip(path, path[1:])):
        total += T._step(a, b)[x, y]
    return total


def test_search_matches_brute_force_at_every_block_size(spark):
    rng = random.Random(3)
    rows = []
    for source in range(4):
        for rec in range(9):
            day, month = rng.randint(1, 12), rng.randint(1, 12)
            rows.append(("t", source * 100 + rec, source, f"{day}/{month}/2026" if rng.random() < 0.7 else f"2026-{month:02d}-{day:02d}"))
    df = spark.createDataFrame(rows, "tab string, rec_id long, feed_id int, raw string").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    feeds = spark.createDataFrame([(k, "UTC", None) for k in range(4)], "feed_id int, feed_tz string, date_order string")
    found = {}
    cands = T.candidates(df, feeds)
    for r in cands.collect():
        found.setdefault(r.source, []).append((r.rec_id, [c.asDict() for c in r.cands]))
    for block in (2, 3, 1000):
        got = {r.rec_id: r.instant_us for r in T.choose(cands, block).collect()}
        for seq in found.values():
            seq.sort()
            seqs = [c for _, c in seq]
            best = min(_cost(seqs, p) for p in itertools.product(*[range(len(c)) for c in seqs]))
            path = [next(k for k, c in enumerate(cs) if c["us"] == got[rec]) for rec, cs in seq]
            assert _cost(seqs, path) == pytest.approx(best)
        assert len(got) == len(rows)


def test_edges(spark):
    feeds = spark.createDataFrame([(1, "UTC", "ymd")], "feed_id int, feed_tz string, date_order string")
    schema = "tab string, rec_id long, feed_id int, raw string, fetched_at timestamp, feed_tz string"
    empty = spark.createDataFrame([], schema)
    assert T.normalise_timestamps(empty, feeds).count() == 0
    rows = spark.createDataFrame([("a", 1, None, "2026-01-01", None, "clash"), ("a", 2, 9, None, None, None), ("a", 3, 1, "2026-01-01", None, None), ("a", 3, 1, "2026-01-01", None, None)], schema)
    got = sorted((r.rec_id, r.instant_us) for r in T.normalise_timestamps(rows, feeds).collect())
    assert got == [(1, us(2026, 1, 1)), (3, us(2026, 1, 1)), (3, us(2026, 1, 1))]
