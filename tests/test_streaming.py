import datetime as dt

from eventloom.streaming import incremental as S


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_unseen_across_runs(spark, tmp_path):
    src, out, ck, schema = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "key string, at timestamp"
    day = lambda d: dt.datetime(2026, 1, d)
    feed(spark, src, [("a", day(1)), ("a", day(1)), ("b", day(2))], schema)
    stream = lambda: S.unseen(spark.readStream.schema(schema).parquet(src), "key", "at")
    run(S.write_available(stream(), out, ck))
    feed(spark, src, [("a", day(3)), ("c", day(3))], schema)
    run(S.write_available(stream(), out, ck))
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_health_state_continues(spark, tmp_path):
    src, ck, schema = str(tmp_path / "in"), str(tmp_path / "ck"), "source_key string, at timestamp, ok boolean, error string"
    at = lambda k: dt.datetime(2026, 1, 1, 0, k)
    seen = []
    keep = lambda batch, number: seen.extend(tuple(r) for r in batch.collect())
    stream = lambda: S.source_health(spark.readStream.schema(schema).parquet(src))
    feed(spark, src, [("s", at(1), False, "e1"), ("s", at(2), False, "e2")], schema)
    run(S.upsert_available(stream(), keep, ck))
    feed(spark, src, [("s", at(3), False, "e3")], schema)
    run(S.upsert_available(stream(), keep, ck))
    feed(spark, src, [("s", at(4), True, None)], schema)
    run(S.upsert_available(stream(), keep, ck))
    assert seen == [("s", 2, "e2"), ("s", 3, "e3"), ("s", 0, "e3")]


def test_counts_by_day(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "key string, at timestamp"
    feed(spark, src, [("a", dt.datetime(2026, 1, 1, h)) for h in (1, 2)] + [("a", dt.datetime(2026, 1, 20))], schema)
    rows = []
    query = S.counts_by_window(spark.readStream.schema(schema).parquet(src), "at", "key").writeStream.outputMode("update").foreachBatch(lambda b, n: rows.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run(query)
    assert sorted(rows) == [(dt.datetime(2026, 1, 1), "a", 2), (dt.datetime(2026, 1, 20), "a", 1)]
