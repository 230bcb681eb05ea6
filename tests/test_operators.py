import random

from pyspark.sql import functions as F

from eventloom.operators import clusters, joins, lookups, memory, merge, metrics, ranking
from eventloom.plans import reference_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_evidence_merge(spark):
    kind = "s array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>"
    df = spark.createDataFrame([([("a", "t", "1", 1.0, None), ("b", "t", "2", 1.0, None), ("a", "t", "3", 2.0, None), ("", "t", "4", 1.0, None)],), (None,)], kind)
    got = [r.m for r in df.select(merge.merge_evidence(F.col("s")).alias("m")).collect()]
    assert [(x.url, x["name"]) for x in got[0]] == [("a", "3"), ("b", "2")] and got[1] == []


def test_merge_by_url_prefix_max(spark):
    df = spark.createDataFrame(
        [(1, "http://X/a/", 5, "first", ["p"]), (2, "http://x/a", 3, "lower", ["q"]), (3, "http://x/a", 7, "", ["r"]), (4, "http://x/a", 9, "best", ["p", "s"]), (5, None, 9, "gone", [])], "seq long, url string, stars long, d string, tags array<string>"
    )
    assert rows(merge.merge_by_url(df, "url", "stars", "seq", "d", "tags")) == [("http://X/a/", 1, 9, "best", ["p", "r", "s"])]


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2), ("c", 2)], "id string, v int")
    assert sorted(((r.id or ""), r.v) for r in merge.upsert(old, new, ["id"]).collect()) == [("", 1), ("a", 2), ("b", 1), ("c", 2)]


def test_memory(spark):
    cand = spark.createDataFrame([("paper", "k1", 1.0), ("paper", "k2", 2.0), ("opensource", "r", 1.0), ("opensource", "r2", 3.0), ("other", "", 1.0)], "category string, key string, score double")
    mem = spark.createDataFrame([("2026-01-02", "paper", "k1"), ("2026-01-09", "opensource", "r"), ("2026-01-10", "opensource", "r2"), ("2026-01-09", "other", "")], "report_date string, category string, key string")
    day = F.lit("2026-01-10")
    assert rows(memory.unreported(cand, mem, day).select("key")) == [("",), ("k1",), ("k2",)]  # k1 was 8 days ago
    kept = memory.unreported_or_best(cand, mem, day, [F.col("score").desc()])
    assert rows(kept.select("key")) == [("",), ("k1",), ("k2",), ("r2",)]  # the emptied category keeps its best
    after = memory.remember(mem, "2026-01-17", spark.createDataFrame([("paper", "new")], "category string, key string"))
    assert rows(after)[-1] == ("2026-01-17", "paper", "new") and all(r[0] >= "2026-01-03" for r in rows(after))


def test_quota(spark):
    df = spark.createDataFrame([(k, "e", float(k), k in (3, 4)) for k in range(1, 9)], "id long, c string, score double, inv boolean")
    got = ranking.top_n_with_quota(df, ["c"], [F.col("score").desc()], 4, F.col("inv")).orderBy("rank_no")
    assert [r.id for r in got.collect()] == [4, 8, 7, 6]


def test_cap_and_pages(spark):
    df = spark.createDataFrame([(k, "x" if k % 2 else " ") for k in range(10)], "id long, c string")
    assert [r.id for r in ranking.cap_per_key(df, "c", [F.col("id")], 2).orderBy("id").collect()] == [0, 1, 2, 3, 4, 6, 8]
    assert [r.id for r in ranking.page(df, [F.col("id")], 2, 4).collect()] == [4, 5, 6, 7]
    assert [r.id for r in ranking.page(df, [F.col("id")], -3, 4).collect()] == [0, 1, 2, 3]


def plain_leaders(titles, keys, threshold):
    leaders, out = [], []
    for k, (t, key) in enumerate(zip(titles, keys)):
        lead = next((j for j in leaders if key and keys[j] == key), None)
        if lead is None:
            lead = next((j for j in leaders if clusters.alike(t, titles[j]) >= threshold), None)
        if lead is None:
            lead = k
            leaders.append(k)
        out.append(lead)
    return out


def test_leaders_match_a_plain_scan():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(14)]
    for _ in range(30):
        titles = [" ".join(rng.sample(vocab, rng.randint(1, 5))) if rng.random() > 0.1 else rng.choice([None, ""]) for _ in range(60)]
        keys = [rng.choice([None, "", "k1", "k2"]) if rng.random() < 0.2 else None for _ in titles]
        for threshold in (0.55, 0.72, 0.85):
            assert clusters.assign_leaders(titles, keys, threshold) == plain_leaders(titles, keys, threshold)


def test_title_links_match_all_pairs(spark):
    rng = random.Random(9)
    titles = [" ".join(rng.sample([f"w{k}" for k in range(12)], rng.randint(1, 6))) for _ in range(80)] + ["", None, "w1 w2", "W1 W2"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    distinct = sorted({t.lower() for t in titles if t})
    want = {(a, b) for a in distinct for b in distinct if a < b and clusters.alike(a, b) >= 0.6 - 1e-12}
    assert {(r.title_a, r.title_b) for r in joins.title_links(df, "title", 0.6).collect()} == want
    assert joins.title_links(df.limit(0), "title", 0.6).count() == 0


def test_health(spark):
    df = spark.createDataFrame([("a", 1, True, None), ("a", 2, False, "e" * 400), ("a", 3, False, "f"), ("b", 1, False, "x"), ("b", 2, True, None)], "k string, t long, ok boolean, err string")
    assert rows(metrics.health(df, "k", "t", F.col("ok"), "err")) == [("a", 2, "f", False), ("b", 0, "x", True)]


def test_inverted_index(spark):
    df = spark.createDataFrame([("to be or not to be",)], "t string")
    assert df.select(metrics.inverted_to_text(metrics.text_to_inverted(F.col("t"))).alias("x")).first().x == "to be or not to be"


def test_fallbacks(spark):
    none, some = spark.range(0), spark.range(3)
    assert lookups.first_non_empty([lambda: none, lambda: some, lambda: spark.range(9)]).count() == 3
    assert lookups.union_with_fallback(spark.range(2), some, 3).count() == 5
    assert lookups.union_with_fallback(spark.range(5), some, 3).count() == 5


def test_alias_first_match(spark):
    pool = spark.createDataFrame([(1, "Alpha", ["alph", "al"]), (2, "Beta", ["beta inc", "al"]), (3, "Gamma", None)], "company_id long, company string, aliases array<string>")
    names = spark.createDataFrame([("The Alphabet",), ("BETA INC.",), ("Gamma",), (" other ",), (None,)], "company string")
    got = {r.company: r.company_norm for r in lookups.first_alias_match(names, "company", pool).collect()}
    assert got == {"The Alphabet": "Alpha", "BETA INC.": "Beta", "Gamma": "Gamma", " other ": "other", None: ""}


def test_quality_metrics_empty_and_filled(spark):
    kind = "agent_score double, human_score double, created_at timestamp"
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    assert tuple(metrics.quality_metrics(spark.createDataFrame([], kind), now, 30).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    import datetime as dt

    day = dt.datetime(2026, 1, 20)
    got = metrics.quality_metrics(spark.createDataFrame([(4.0, 4.2, day), (2.0, 4.0, day), (3.0, 2.0, day), (None, None, day)], kind), now, 30).first()
    assert (got.total, got.consistency, got.satisfaction) == (4, 33.3, 66.7)


def plain_first_by_either_key(pairs):
    by_id, by_title, out = {}, {}, []
    for k, (i, t) in enumerate(pairs):
        lead = (by_id.get(i) if i else None) if (by_id.get(i) if i else None) is not None else (by_title.get(t) if t else None)
        if lead is None:
            lead = k
            by_id |= {i: k} if i else {}
            by_title |= {t: k} if t else {}
        out.append((k, lead))
    return out


def test_first_by_either_key_is_a_plain_scan_of_all_rows(spark):
    rng = random.Random(3)
    pairs = [(rng.choice([None, "", *(f"i{k}" for k in range(60))]), rng.choice([None, "", *(f"t{k}" for k in range(80))])) for _ in range(200)]
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(pairs)], "row long, i string, t string")
    for alone in (0, 30, 1000):
        assert rows(clusters.first_by_either_key(df, "row", "i", "t", "row", alone)) == plain_first_by_either_key(pairs)


def test_papers_saved_on_different_days_are_compared(spark, tmp_path):
    data = [(1, "paper", "PX-1", "A b", "2026-01-01"), (2, "paper", "arxiv:px-1", "other", "2026-01-02"), (3, "paper", None, "a  B!", "2026-01-03"), (4, "paper", "px-2", "other", "2026-01-04"), (5, "policy", "px-1", "a b", "2026-01-05")]
    spark.createDataFrame(data, "row_id long, module string, product string, title string, added_at string").write.parquet(f"{tmp_path}/standard_events.parquet")
    assert rows(reference_queries.paper_dedup(spark, str(tmp_path))) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_run_leaders_follow_the_rule_of_the_reference(spark, tmp_path):
    data = [
        (1, "enterprise", "Acme raises money for robots", "Acme", None, "d1"),
        (2, "enterprise", "Acme raises money for robots", "ACME Inc", None, "d1"),  # equal title, company typed differently
        (3, "enterprise", "Acme raises money for robots", None, None, "d2"),  # another run
        (4, "enterprise", "One two three four five six unified agent kernel", "the acme group", None, "d1"),
        (5, "enterprise", "Zebra unified agent kernel", "Acme", "x", "d1"),
        (6, "paper", "a b c d e f g", None, "p1", "d1"),
        (7, "paper", "a b c d e f h", None, "p2", "d1"),  # 6 of 8 tokens: 0.75
        (8, "paper", "a b c d e x y", None, "p3", "d1"),  # 5 of 9: below both
        (9, "paper", "a b c d e f z w", None, "p4", "d1"),  # 6 of 9: 0.67, enough elsewhere but not for papers
        (10, "paper", "quite another", None, "p1", "d1"),  # the id of 6
        (11, "opensource", "Repository r/a updated", None, "r/a", "d1"),
        (12, "opensource", "Repository r/a updated", None, "r/b", "d1"),
        (13, "opensource", "other words", None, "r/a", "d1"),
        (14, "enterprise", "智能体平台", "Acme", None, "d1"),
        (15, "enterprise", "智能体平台！new", "acme", None, "d1"),  # the strong key of 14
    ]
    std = "row_id long, module string, title string, company string, product string, added_at string, time string, source array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>"
    spark.createDataFrame([(*r, None, None) for r in data], std).write.parquet(f"{tmp_path}/standard_events.parquet")
    spark.createDataFrame([(1, "Acme", ["acme"])], "company_id long, company string, aliases array<string>").write.parquet(f"{tmp_path}/enterprise_pool.parquet")
    got = dict(rows(reference_queries.leader_cluster_dedup(spark, str(tmp_path))))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 6, 11: 11, 12: 12, 13: 11, 14: 14, 15: 14}


def test_report_picks_merge_stories_alike_and_leave_out_reported_ones(spark, tmp_path):
    source = lambda u: [(f"https://{u}.com/2026/08/31/a", "official", u, 5.0, "2026-08-31")]
    data = [
        (1, "e1", "Acme opens a new robot factory", "Acme", "2026-08-31", "processed", source("a")),
        (2, "e2", "Acme opens a new robot plant", None, "2026-08-30", "processed", source("b")),  # like 1
        (3, "e3", "Zeta buys the museum archive", "Zeta", "2026-08-31", "processed", source("c")),
        (4, "e4", "Zeta buys the museum archive!", "Zeta", "2026-08-29", "reported", source("d")),  # so 3 was reported
    ]
    std = "row_id long, event_id string, title string, company string, added_at string, status string, source array<struct<url:string,source_type:string,name:string,credibility_score:double,published_at:string>>"
    df = spark.createDataFrame(data, std).withColumns({"module": F.lit("enterprise"), "time": F.lit("2026-08-31"), "product": F.lit(None).cast("string"), "sub_type": F.lit(None).cast("string"), "description": F.lit("words"), "sub_tags": F.array().cast("array<string>"), "entities": F.create_map().cast("map<string,string>")})
    df.write.parquet(f"{tmp_path}/standard_events.parquet")
    spark.createDataFrame([(1, "Acme", ["acme"])], "company_id long, company string, aliases array<string>").write.parquet(f"{tmp_path}/enterprise_pool.parquet")
    assert [(r.rank_no, r.row_id) for r in reference_queries.report_picks(spark, str(tmp_path)).collect()] == [(1, 1)]


def test_copies_join_like_rows_of_their_own(spark):
    """Many copies, keys that lead between them, and blanks, against the plain scan of all rows."""
    import random

    from eventloom.operators import clusters

    rng = random.Random(8)
    words = "tool kit agent model data flow".split()
    rows = []
    for k in range(400):
        title = rng.choice([None, "", *[" ".join(rng.sample(words, 4)) for _ in range(3)]])
        rows.append((k, rng.choice("xy"), title, rng.choice([None, "", "k1", "k2", "k3", "k4"])))
    df = spark.createDataFrame(rows, "uid long, b string, t string, k string")
    got = {r.uid: r.leader for r in clusters.leader_clusters(df, "b", "uid", "t", "uid", 0.6, "k").collect()}
    want = {}
    for b in "xy":
        mine = [r for r in rows if r[1] == b]
        leaders = []
        for uid, _, title, key in mine:
            hit = next((u for u, t, k in leaders if key and k == key), None)
            if hit is None:
                hit = next((u for u, t, k in leaders if title and t and clusters.alike(t, title) >= 0.6), None)
            if hit is None:
                leaders.append((uid, title, key))
                hit = uid
            want[uid] = hit
    assert got == want and len(set(want.values())) > 10
