from lexigraph.streaming import events


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", k, float(m)) for h in range(3) for m in (1, 30) for k in "ab"], "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    live = events.windowed(events.stream(spark, str(tmp_path / "in"), rows.schema))
    run = live.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, events.windowed(rows).collect()))
