from dealforge.streaming import jobs


def source(spark, folder):
    return spark.readStream.schema("item_id int, store_id int, day string, seq int").option("maxFilesPerTrigger", 1).parquet(folder)


def test_daily_upsert_survives_replay(spark, tmp_path):
    rows = [(1, 1, "d1", 1), (1, 1, "d1", 3), (1, 2, "d1", 2)]
    spark.createDataFrame(rows, "item_id int, store_id int, day string, seq int").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, 1, "d1", 7)], "item_id int, store_id int, day string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for turn in ("a", "b"):  # a second run from the start writes the same
        jobs.daily_upsert(source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / turn)).awaitTermination()
        got = {(r.item_id, r.store_id): r.seq for r in jobs.latest(spark, str(tmp_path / "out")).collect()}
        assert got[(1, 2)] == 2 and got[(1, 1)] in (3, 7) and len(got) == 2


def test_new_listings_once(spark, tmp_path):
    df = spark.sql("select * from values (1, timestamp'2024-01-01'), (1, timestamp'2024-01-01 01:00:00'), (2, timestamp'2024-01-01') as t(listing_id, ts)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.new_listings(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.listing_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_deal_states_over_batches(spark, tmp_path):
    runs = [(1, 10.0), (2, 9.99), (3, 9.0), (4, None), (5, None), (6, 9.5), (6, 1.0)]
    kind = "item_id int, store_id int, run int, price double"
    for n, price in runs:
        spark.createDataFrame([(1, 1, n, price), (2, 1, n, 5.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/run={n}"))
    stream = spark.readStream.schema("item_id int, store_id int, run int, price double").option("basePath", str(tmp_path / "in")).parquet(str(tmp_path / "in/*"))
    q = jobs.deal_states(stream).writeStream.format("memory").queryName("deal_states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.item_id, r.action, r.price) for r in spark.table("deal_states").collect()]
    assert [g for g in got if g[0] == 2] == [(2, "insert", 5.0)]
    assert [g[1:] for g in got if g[0] == 1][:4] == [("insert", 10.0), ("cheaper", 9.0), ("expire", 9.0), ("reactivate", 1.0)]


def test_one_query_of_a_name_at_a_time(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    first = jobs.every(stream, "periodic", lambda batch, n: None, str(tmp_path / "c"), 2)
    try:
        assert first is not None and jobs.every(stream, "periodic", lambda batch, n: None, str(tmp_path / "d"), 2) is None
    finally:
        first.stop()
