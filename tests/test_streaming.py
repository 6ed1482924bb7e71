import datetime as dt

from mundspark.streaming import sessions as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, user string, ts timestamp, value double"


def feed(spark, tmp_path, batches, build, mode):
    """Rows that a query sends, batch after batch."""
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame([(n, u, T0 + dt.timedelta(seconds=s), v) for n, u, s, v in b], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
            part.rename(src / f"{i:03}.parquet")
            q.processAllAvailable()
        return [r.asDict() for r in spark.table("out").collect()]
    finally:
        q.stop()
        spark.catalog.dropTempView("out")


def test_sessions_close_with_the_watermark_and_drop_late_rows(spark, tmp_path):
    batches = [[(1, "a", 0, 1.0), (2, "a", 5, 2.0)], [(3, "a", 100, 4.0)], [(4, "a", 1, 50.0), (5, "b", 300, 1.0)], [(6, "b", 900, 1.0)]]
    got = feed(spark, tmp_path, batches, lambda s: S.sessions(s, "user", "ts", "10 seconds", "20 seconds", "value"), "append")
    a = sorted((r["total"], r["events"]) for r in got if r["user"] == "a")
    assert a == [(3.0, 2), (4.0, 1)]  # the row at second 1 came after the watermark had passed


def test_summaries_update(spark, tmp_path):
    got = feed(spark, tmp_path, [[(1, "a", 0, 1.0)], [(2, "a", 1, 3.0)]], lambda s: S.summaries(s, "user", "value"), "complete")
    assert [(r["n"], r["mean"], r["std"], r["most"]) for r in got] == [(2, 2.0, 1.0, 3.0)]


def test_windowed(spark, tmp_path):
    got = feed(spark, tmp_path, [[(1, "a", 0, 1.0), (2, "a", 9, 2.0)], [(3, "a", 100, 1.0)], [(4, "a", 200, 1.0)]], lambda s: S.windowed(s, "ts", "10 seconds", "5 seconds", "user", "value"), "append")
    assert (2, 3.0) in [(r["n"], r["total"]) for r in got]


def test_rolling_chunks(spark, tmp_path):
    batches = [[(1, "a", 0, 3.0), (2, "a", 1, 4.0)], [(3, "a", 2, 4.0), (4, "a", 3, 1.0)], [(5, "b", 600, 1.0)], [(6, "b", 1200, 1.0)]]
    got = feed(spark, tmp_path, batches, lambda s: S.rolling_chunks(s, "user", "id", "value", 10.0, "ts", "10 seconds"), "append")
    assert sorted((r["chunk"], r["items"], r["total"]) for r in got if r["user"] == "a") == [(0, 3, 11.0), (1, 1, 1.0)]
