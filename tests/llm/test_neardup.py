import random

from pyspark.sql import functions as F

from eventloom.llm import neardup


def test_plan_reaches_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = neardup.band_plan(threshold, 0.95)
        assert bands * rows <= neardup.HASHES and 1 - (1 - threshold**rows) ** bands >= 0.95


def make_records():
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(400)]
    rows, uid = [], 0
    for _ in range(120):
        base = rng.sample(vocab, 40)
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rng.shuffle(words)
            rows.append((uid, rng.choice([1, 1, 2]), " ".join(words)))
            uid += 1
    rows += [(uid + k, 9, "one hot copy of some words") for k in range(50)]
    return rows


def linked(spark, rows):
    df = spark.createDataFrame([(u, str(k), t) for u, k, t in rows], "uid long, label string, text string")
    keys = df.select("label", F.col("label").cast("long").alias("key")).distinct()
    links, members = neardup.near_duplicates(df, keys)
    return {(r.a, r.b) for r in links.collect()}, {r.uid: r.cls for r in members.collect()}


def wanted_links(rows, cls):
    sets = {cls[u]: (k, frozenset(t.split())) for u, k, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.7}


def test_links_match_all_pairs(spark):
    rows = make_records()
    got, cls = linked(spark, rows)
    want = wanted_links(rows, cls)
    assert len(cls) == len(rows) and len({cls[u] for u, k, _ in rows if k == 9}) == 1
    assert got <= want and len(got) >= 0.97 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs that share hardly more than the threshold, sketch included: 28 of 40 words."""
    rng = random.Random(12)
    rows = []
    for k in range(600):
        base = [f"w{k}x{i}" for i in range(34)]
        rows += [(2 * k, 1, " ".join(base)), (2 * k + 1, 1, " ".join(rng.sample(base[:28], 28) + [f"z{k}x{i}" for i in range(6)]))]
    got, cls = linked(spark, rows)
    want = wanted_links(rows[:400], cls)
    assert len(want) == 200  # 28 of 40 in every pair
    assert len(got) >= 0.96 * 600


def test_hot_bands_are_split_and_lose_nothing(spark, monkeypatch):
    rows = make_records()
    plain, cls = linked(spark, rows)
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "HOT", 2)
    split, _ = linked(spark, rows)
    assert split == plain and len(plain) > 50


def test_events(spark):
    body = "The new model of the firm reads long texts and answers questions about them without any manual tuning today"
    events = [
        (1, "e1", "Title", body, "Firm"), (2, "e2", "<b>TITLE</b>", body.upper() + "!", "Firm Inc"), (3, "e3", "Title", body, None), (4, "e4", "Title", body, " "), (5, "e5", "Title", "", "Firm"), (6, "e6", "Title", None, "Firm"),
        (7, "e1", "Title", body, "Firm"), (8, None, "Title", body, "Firm"), (9, "e7", None, body, "Elsewhere"), (10, "e8", "Title", body, "ELSEWHERE "),
        (11, "e9", "标题", "与上季度相比延迟下降了百分之三十九采用宽松许可协议预计年底前完成", "Firm"), (12, "e10", "标题", "与上季度相比，延迟下降了百分之三十九；采用宽松许可协议，预计年底前完成。", "Firm"),
    ]
    df = spark.createDataFrame([(*e, "x") for e in events], "row_id long, event_id string, title string, description string, company string, cls string")
    names = spark.createDataFrame([("Firm", 1), ("Firm Inc", 1), ("Elsewhere", -1), ("ELSEWHERE ", -1)], "company string, company_id long")
    got = sorted(tuple(r) for r in neardup.event_pairs(df, names).collect())
    assert got == [("e1", "e2"), ("e10", "e9"), ("e3", "e4"), ("e7", "e8")]
    assert neardup.event_pairs(df.limit(0), names).count() == 0


def test_sieve_only_thins(spark, monkeypatch):
    rows = spark.range(5000).withColumn("uid", F.col("id")).withColumn("text", F.lit("t")).select("uid", "text")
    wanted = spark.range(0, 5000, 7).select(F.col("id").alias("uid"))
    assert neardup.only_wanted(rows, wanted).count() == wanted.count()
    monkeypatch.setattr(neardup, "SIEVE_BITS", 64)  # too full to help
    assert neardup.only_wanted(rows, wanted).count() == wanted.count()
    assert neardup.only_wanted(rows, wanted.limit(0)).count() == 0
