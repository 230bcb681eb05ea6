import random

from eventloom.llm import leaks


def brute(item, doc, least):
    """Whether some run of item words is within a tenth of edits of some run of document words."""
    n, m = len(item), len(doc)
    for i in range(n):
        prev = {j: 0 for j in range(m + 1)}  # edits from item[i:i+k] to a document run that ends at j
        for k in range(1, n - i + 1):
            cur = {}
            for j in range(m + 1):
                best = prev[j] + 1
                if j:
                    best = min(best, prev[j - 1] + (item[i + k - 1] != doc[j - 1]), cur[j - 1] + 1)
                cur[j] = best
            prev = cur
            if k >= least and min(cur.values()) * leaks.PER_EDIT <= k:
                return True
    return False


def test_matches_brute_force():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, rng.sample(vocab, 40)) for k in range(6)]
    docs = []
    for _ in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 15))]
        _, item = rng.choice(items)
        start, length = rng.randint(0, 20), rng.randint(12, 24)
        part = list(item[start : start + length])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(part))
            rng.choice([lambda: part.pop(at), lambda: part.insert(at, "odd"), lambda: part.__setitem__(at, "odd")])()
        docs.append(words + part + [rng.choice(vocab) for _ in range(rng.randint(0, 10))])
    index = leaks.Index(items, leaks.SEED_WORDS, leaks.MIN_WORDS)
    got = {(d, i) for d, i, *_ in index.search([" ".join(x) for x in docs])}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in items if brute(item, doc, leaks.MIN_WORDS)}
    assert got == want and want


def test_marks_case_and_spacing_do_not_count(spark):
    text = "Given a ledger with 4204 rows and 47 corrupted checksums explain why Ceathjilioth rejects Mundkiboun before reading Gagaiquaim twice"
    han = "已知考官向甲乙丙出示一千四百道密封试题其中一百五十道含有矛盾请判断结论是否成立并说明理由"
    items = spark.createDataFrame([(1, "en", text), (2, "zh", han), (3, "en", "too short"), (4, None, None)], "item_id long, lang string, text string")
    noisy = "“" + text.upper().replace(" ", "  \n> **") + "”"
    docs = [(1, "before " + noisy + " after"), (2, han[:30].replace("出", "出 ，"), ), (3, " ".join(text.split()[:14])), (4, None), (5, ""), (6, "x" * 200_000), (7, "<p>" + text.replace("rows", "<b>rows</b>") + "</p>"), (1, "again " + text)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    found = leaks.find_leaks(df.select("doc_id", "text", "item_id"), items, block_items=1)
    assert sorted({(r.doc_id, r.item_id) for r in found.collect()}) == [(1, 1), (2, 2), (7, 1)]
    assert sorted(r.doc_id for r in leaks.remove_leaked(df, leaks.leaked_pairs(df, items)).collect()) == [3, 4, 5, 6]
    assert leaks.leaked_pairs(df.limit(0), items).count() == 0
    assert leaks.leaked_pairs(df, items.limit(0)).count() == 0


def test_places_of_matches(spark):
    """Where the longest verbatim match begins, in item and document; a tag of any length within it does not count."""
    words = [f"word{k}" for k in range(40)]
    items = spark.createDataFrame([(1, "en", " ".join(words)), (2, "en", " ".join(f"other{k}" for k in range(20)))], "item_id long, lang string, text string")
    link = "<a class='x' href=\"https://host.example/" + "p" * 400 + "\">"
    docs = spark.createDataFrame([(1, "one two three " + " ".join(words[5:15]) + " " + link + " ".join(words[15:30]) + "</a> end"), (2, " ".join(words[:8]))], "doc_id long, text string")
    for block in (1, 5000):
        (r,) = leaks.find_leaks(docs, items, block_items=block).collect()
        assert (r.doc_id, r.item_id, r.verbatim, r.passage, r.item_at, r.doc_at) == (1, 1, 25, 25, 5, 3)
