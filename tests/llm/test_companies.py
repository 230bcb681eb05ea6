import pytest

from eventloom.llm import companies

POOL = [
    (1, "Thenpuhur Robotics", []), (2, "Jeaceacios Networks", []), (3, "Jeaceacios Dynamics", None), (4, "Zusaslound Semiconductors", ["Pleajupu"]),
    (5, "翊陌潼算力", ["Yimotong Compute", "Vunabro"]), (6, "沅昱屿机器人", ["Yuanyuyu Robotics"]),
]
SAME = {
    1: ["Thenpuhur Robotics", "thenpuhur_robotics", "THENPUHUR", "Thenpuhur Inc.", "Thenpuhur AI", "Thenpuhur Robo.", "Robotics, Thenpuhur", "@thenpuhurrobotics", "“Thenpuhur Robotics", "Thenpühur Robotics", "Thепpuhur Robotics".replace("п", "n"),
        "Ｔｈｅｎｐｕｈｕｒ　Ｒｏｂｏｔｉｃｓ", "Thenpuhur Robotics (Series B)", "Thenpuhur Robotics – press office", "Thenpuhur Robotics, Berlin office", "Thenpuhur Robotics Co., Ltd.", "ThenpuhurRobotics", "Tehnpuhur Rbootics", "Thenpuhur Robotics公司",
        "thenpuhur-robotics.example", "Thnpuhur Robotcs", "by Thenpuhur Robotics", "Thenpuhur Robotics / research team", "Thenpuhur\xa0Robotics　"],
    2: ["Jeaceacios Netw.", "jEACEACIOS nETWORKS"], 3: ["Jeaceacios Dyamics"], 4: ["Pleajupu", "pleajupu", "Pleajupu by Zusaslound Semiconductors", "Zusaslound Semiconductors (Pleajupu)"],
    5: ["翊陌潼", "「翊陌潼算力」", "翊陌潼算力（北京）有限公司", "Yimotong-Compute Co., Ltd.", "翊陌潼算力 Yimotong Compute", "Yimotnog Compute"], 6: ["沅昱屿 机器人", "沅昱屿机器人研究院", "YuanyuyuRobotics"],
}
OTHER = ["Thenpuhur Bakery", "Thenpuhur Ferry Lines", "Jeaceacios", "Jeaceacios Ceramics", "Kerkwubrus Robotics", "various", "n/a", "-", "未披露", "dev-x12", "x" * 30_000]


def test_names(spark):
    pool = spark.createDataFrame(POOL, "company_id long, company string, aliases array<string>")
    want = {name: cid for cid, names in SAME.items() for name in names} | {name: -1 for name in OTHER}
    typed = spark.createDataFrame([(n,) for n in [*want, None, "", " 　", "Thenpuhur Robotics"]], "company string")
    got = {r.company: r.company_id for r in companies.match_names(typed, pool).collect()}
    assert {k: v for k, v in got.items() if want[k] != v} == {} and set(got) == set(want)


def test_records_and_edges(spark):
    pool = spark.createDataFrame(POOL, "company_id long, company string, aliases array<string>")
    rows = spark.createDataFrame([("a", 1, "Pleajupu", 5), ("a", 1, "Pleajupu", 5), ("b", 2, None, 5), ("b", 3, "nobody", 5)], "tab string, rec_id long, company string, company_id long")
    assert sorted(tuple(r) for r in companies.map_records(rows, pool).collect()) == [("a", 1, 4), ("a", 1, 4), ("b", 3, -1)]
    assert companies.map_records(rows.limit(0), pool).count() == 0
    assert {r.company_id for r in companies.match_names(rows, pool.limit(0)).collect()} == {-1}


def test_what_the_verification_accepts_is_a_candidate(spark):
    """One edit or one swap in each word, at every place, in names of all lengths from five characters on."""
    names = ["mimizi", "quark", "abcdefg", "norvelo systems", "abc defgh", "kestrel labs", "longername industries"]
    pool = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "company_id long, company string, aliases array<string>")
    swap = lambda w, k: w[:k] + w[k + 1] + w[k] + w[k + 2 :]
    want = {}
    for k, name in enumerate(names):
        words = name.split()
        for at in range(max(map(len, words)) - 1):
            want[" ".join(swap(w, at) if at + 1 < len(w) else w for w in words)] = k
            want[" ".join(w[:at] + "z" + w[at + 1 :] if at < len(w) else w for w in words)] = k
    got = {r.company: r.company_id for r in companies.match_names(spark.createDataFrame([(w,) for w in want], "company string"), pool).collect()}
    assert {t: (got[t], k) for t, k in want.items() if got[t] != k} == {}


def test_a_large_mapping_is_salted(spark, monkeypatch):
    pool = spark.createDataFrame(POOL, "company_id long, company string, aliases array<string>")
    rows = spark.createDataFrame([("a", k, "Pleajupu" if k % 3 else "nobody") for k in range(60)], "tab string, rec_id long, company string")
    want = sorted(tuple(r) for r in companies.map_records(rows, pool).collect())
    monkeypatch.setattr(companies, "broadcast_if_small", lambda df: df)
    assert sorted(tuple(r) for r in companies.map_records(rows, pool).collect()) == want and len(want) == 60


@pytest.mark.parametrize("typed,ref", [("abcdefghijklmn", "abcdefghijklmn")])
def test_every_near_string_is_a_candidate(spark, typed, ref):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    variants = set()
    for _ in range(150):
        s = list(ref)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s))
            rng.choice([lambda: s.pop(k), lambda: s.insert(k, "z"), lambda: s.__setitem__(k, "y")])()
        variants.add("".join(s))
    refs = spark.createDataFrame([(1, ref, ref, "")], "company_id long, ref string, w1 string, rest string")
    segments = companies._segments(refs)
    shapes = segments.select("len", "k", "i", "seg_pos", "seg_len").distinct()
    df = spark.createDataFrame([(v, v, v, "") for v in variants], "clean string, squashed string, tw1 string, trest string")
    hit = companies._probes(df, shapes).join(segments, ["len", "i", "seg"]).where(F.levenshtein("squashed", "ref") <= 4).select("clean").distinct()
    assert {r.clean for r in hit.collect()} == variants
