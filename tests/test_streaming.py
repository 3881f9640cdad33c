from slovomer.operators.stats import basic_stats
from slovomer.streaming import live


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Дом стоит. Лес шумит.", "2021-01-01 10:00:00"), (2, None, "2021-01-02 10:00:00"), (3, "Река.", "2021-01-20 10:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").selectExpr("doc_id", "text", "cast(t as timestamp) as added_at")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.read_stream(spark, str(tmp_path / "in"), df.schema)
    q = live.live_stats(stream).writeStream.format("memory").queryName("live_test").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(repr, spark.table("live_test").collect())) == sorted(map(repr, basic_stats(df).collect()))
    q = live.words_by_window(stream, late="1 day").writeStream.outputMode("append").format("memory").queryName("live_windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r.window_start.date()), r.texts, r.words) for r in spark.table("live_windows").collect()} >= {("2021-01-01", 1, 4), ("2021-01-02", 1, 0)}


def test_landed(spark, tmp_path):
    for k, (day, text) in enumerate([("2021-01-01", "Дом стоит"), ("2021-01-01", "Лес"), ("2021-01-02", None)]):
        spark.createDataFrame([(k, text, day)], "doc_id long, text string, t string").selectExpr("doc_id", "text", "cast(t as timestamp) as added_at").write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    got = live.landed(live.words_by_window(stream), ("window_start", "window_end")).collect()
    assert sorted((str(r.window_start.date()), r.texts, r.words) for r in got) == [("2021-01-01", 2, 3), ("2021-01-02", 1, 0)]
    assert live.landed(live.live_stats(stream)).count() == 3
