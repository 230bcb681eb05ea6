import random

import pytest

from eventloom.llm import topn

SCHEMA = "row_id long, event_id string, module string, product string, importance_score double, rank_no int, title string"


def brute(rows, n):
    last = {}
    for r in rows:
        key = r[1] if r[1] is not None else ("none", r[0])
        if key not in last or last[key][0] < r[0]:
            last[key] = r
    groups = {}
    for r in last.values():
        if r[3] and r[3].strip() and r[4] is not None and r[4] == r[4]:
            groups.setdefault((r[2].strip().lower(), r[3]), []).append((-r[4], r[0]))
    return {(m, p, k, uid) for (m, p), xs in groups.items() for k, (_, uid) in enumerate(sorted(xs)[:n], 1)}


@pytest.mark.parametrize("held", [7, 500_000])
def test_matches_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(topn, "MAX_HELD", held)
    rng = random.Random(2)
    rows = []
    for uid in range(3000):
        hot = rng.random() < 0.4
        score = rng.choice([None, float("nan"), -1.0, 0.5, 0.5, 1.0, rng.random()])
        rows.append((uid, rng.choice([None, f"e{rng.randint(0, 1500)}"]), rng.choice(["Paper", " paper ", "enterprise"]), "hot" if hot else rng.choice([None, "", " ", f"p{rng.randint(0, 40)}"]), score, 7, "clash"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [tuple(r) for r in topn.best_of_products(df, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("g", 1.0, 5), ("g", 1.0, 5), ("g", 2.0, 9), (None, 1.0, 4)], "k string, s double, u long")
    got = sorted([tuple(r) for r in topn.top_n_per_group(df, ["k"], "s", "u", 2).collect()], key=repr)
    assert got == [("g", 1, 9, 2.0), ("g", 2, 5, 1.0), (None, 1, 4, 1.0)]
    assert topn.best_of_products(spark.createDataFrame([], SCHEMA)).count() == 0
