from pyspark.sql import functions as F

from barloom.streaming import bars as stream


def test_insert_only_sink_and_late_rows(spark, tmp_path):
    """Confirmed rows stay as first written, over restarts of the stream."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "k long, v string"
    for rows in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")], [(1, "c"), (4, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(stream.insert_only(out, ["k"])).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "c")]


def test_closed_bars_hold_back_the_forming_one(spark, tmp_path):
    ticks = [("A", f"2024-01-01 0{h}:{m:02d}:00", h * 100 + m, float(h * 60 + m), 1) for h in range(3) for m in (0, 30, 59)]
    df = spark.createDataFrame(ticks, "symbol string, at string, seq long, price double, size int").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.closed_bars(live, "h1").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.t % 86400, r.o, r.h, r.l, r.c, r.v) for r in spark.table("closed").collect())
    assert got == [(0, 0.0, 59.0, 0.0, 59.0, 3.0), (3600, 60.0, 119.0, 60.0, 119.0, 3.0)]


def test_first_confirmed(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.first_confirmed(live, ["k"]).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_frozen_tail_replaces_the_forming_bar_only(spark, tmp_path):
    """Tails are replaced, frozen bars stay, bars before a tail are ignored, a batch may be tried again."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "symbol string, tf string, t long, c double, version long"
    sent = [
        [("A", "h1", 0, 1.0, 1), ("A", "h1", 3600, 2.0, 2), ("A", "h1", 3600, 2.5, 3), ("B", "h1", 0, 9.0, 1)],
        [("A", "h1", 3600, 3.0, 4), ("A", "h1", 0, 7.0, 5)],
        [("A", "h1", 7200, 4.0, 6), ("A", "h1", 1800, 8.0, 7), ("B", "h1", 3600, 9.5, 2)],
        [("A", "h1", 3600, 5.0, 8), ("A", "h1", 7200, 4.5, 9)],
    ]
    for rows in sent:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(stream.frozen_tail(out, "version")).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    want = [("A", 0, 1.0), ("A", 3600, 3.0), ("A", 7200, 4.5), ("B", 0, 9.0), ("B", 3600, 9.5)]
    shown = lambda: sorted((r.symbol, r.t, r.c) for r in stream.read_frozen(spark, out).collect())
    assert shown() == want
    stream.frozen_tail(out, "version")(spark.createDataFrame(sent[-1], schema), 3)
    assert shown() == want


def test_outcomes_are_settled_by_later_batches(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    schema = "symbol string, tf string, t long, c double, id long, horizon long"
    bars = [("A", "h1", k * 3600, float(k * k), None, None) for k in range(6)]
    sent = [[*bars[:2], ("A", "h1", 3600, 1.0, 1, 1), ("A", "h1", 3600, 1.0, 2, 3), ("B", "h1", 0, 5.0, 3, 1)], [bars[2], ("A", "h1", 7200, 4.0, 4, 9)], bars[3:], [("B", "h1", 60, 4.0, None, None)]]
    got = []
    for rows in sent:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        live = stream.outcomes(spark.readStream.schema(schema).parquet(str(source)))
        live.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("A", "h1", 1, 3600, 1, 7200, 3.0), ("A", "h1", 2, 3600, 3, 14400, 15.0), ("B", "h1", 3, 0, 1, 60, -1.0)]
