import random

from eventloom.operators import history as H


def brute(rows):
    by = {}
    for key, at, stars, snap in rows:
        if stars is not None and stars >= 0:
            best = by.setdefault(key, {})
            if at not in best or best[at][0] < snap:
                best[at] = (snap, stars)
    out = set()
    for key, seen in by.items():
        changes = []
        for at in sorted(seen):
            if not changes or changes[-1][1] != seen[at][1]:
                changes.append((at, seen[at][1]))
        for k, (at, stars) in enumerate(changes):
            out.add((key, at, changes[k + 1][0] if k + 1 < len(changes) else "", stars))
    return out


def test_matches_brute_force_with_small_buckets(spark):
    rng = random.Random(1)
    rows = []
    for snap in range(600):
        key = "host/o/hot" if rng.random() < 0.5 else f"host/o/r{rng.randint(0, 9)}"
        day = rng.randint(1, 28)
        rows.append((key, f"2026-01-{day:02d}T0{rng.randint(0, 9)}:00:00.000Z", rng.choice([None, -1, 1, 2, 3]), snap))
    df = spark.createDataFrame([(s, "https://" + k, v, t) for k, t, v, s in rows], "snap_id long, repo_url string, stars long, fetched_at string")
    for bucket in (3600 * 10**6, 5 * 86400 * 10**6, H.BUCKET_US):
        got = [tuple(r) for r in H.star_history(df, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_repo_key(spark):
    urls = ["HTTPS://WWW.Host.example/Own/Name.git/", "git@host.example:Own/Name.git", "http://user@host.example/own/name?tab=x#y", " https://host.example/own/name "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0] for r in df.select(H.repo_key(df["u"])).collect()} == {"host.example/own/name"}


def test_events_are_classified(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, None)], "k string, t long, v long")
    got = sorted((r.k, r.t, r.v, r.kind) for r in H.change_events(df, "k", "t", "v").collect() if r.v is not None)
    assert got == [("a", 1, 5, "inserted"), ("a", 3, 6, "changed"), ("a", 3, 6, "ended")]


def test_edges(spark):
    schema = "snap_id long, repo_url string, stars long, fetched_at string, at string"
    assert H.star_history(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, None, 1, "2026-01-01T00:00:00Z", "x"), (2, "https://h/o/n", 1, "nonsense", None), (3, "", 2, "2026-01-01T00:00:00Z", None), (4, "https://h/o/" + "n" * 50_000, 2, None, None)], schema)
    assert H.star_history(odd).count() == 0


def test_ended_keys_can_close_their_last_version(spark):
    from eventloom.operators import history as H

    rows = spark.createDataFrame([("a", 1, 5), ("a", 4, 5), ("a", 6, 7), ("b", 2, 1)], "k string, at long, v long")
    events = H.change_events(rows, "k", "at", "v", bucket_us=3)
    assert sorted((r.k, r["at"], r.kind) for r in events.collect()) == [("a", 1, "inserted"), ("a", 6, "changed"), ("a", 6, "ended"), ("b", 2, "ended"), ("b", 2, "inserted")]
    open_ = sorted(tuple(r) for r in H.versions(events, "k", "at", "v", bucket_us=3).collect())
    closed = sorted(tuple(r) for r in H.versions(events, "k", "at", "v", bucket_us=3, close_ended=True).collect())
    assert open_ == [("a", 1, 6, 5), ("a", 6, None, 7), ("b", 2, None, 1)] and closed == [("a", 1, 6, 5), ("a", 6, 6, 7), ("b", 2, 2, 1)]
