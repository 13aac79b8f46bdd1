from pyspark.sql import functions as F

from fieldloom.streaming import traffic

SCHEMA = "ts timestamp, pixel long, colour int"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    pixels = events.select(F.col("ts").cast("timestamp"), F.col("user_id").alias("pixel"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).alias("colour"))
    pixels.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    edges = pixels.select("pixel").distinct().select("pixel", (F.col("pixel") % 7).alias("u"), (F.col("pixel") % 3).alias("v"))
    stream = traffic.windowed_colour_counts(traffic.pixel_stream(spark, str(tmp_path / "in"), SCHEMA, 1), edges, late="100000 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = traffic.windowed_colour_counts(pixels, edges)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect())) != []


def test_latest_and_each_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 1L pixel, 2 colour union all select timestamp'2024-01-01 00:09:00', 1L, 3 union all select timestamp'2024-01-01 00:20:00', 1L, 1")
    assert [r.colour for r in traffic.latest_colours(rows).orderBy("t").collect()] == [3, 1]
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = traffic.pixel_stream(spark, str(tmp_path / "in"), SCHEMA)
    traffic.estimate_each_batch(stream, lambda b: b.groupBy("pixel").agg(F.avg("colour").alias("estimate")), str(tmp_path / "out"), str(tmp_path / "c"))
    assert [r.estimate for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2.0]


def test_latest_colours_by_state_equal_the_batch_however_rows_arrive(spark, tmp_path):
    """Files in a shuffled order with late rows and repeats, stopped after each file and started again from the checkpoint."""
    import random

    from fieldloom.streaming.latest import latest_colour_stream

    rng = random.Random(3)
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:{rng.randint(0, 59):02d}", rng.randint(1, 6), rng.randint(0, 4)) for h in range(3) for m in range(60) for _ in range(2)]
    rows += rng.sample(rows, 40) + [(rows[5][0], rows[5][1], 4), (rows[5][0], rows[5][1], 1)]
    rng.shuffle(rows)
    last = [("2024-01-02 12:00:00", 99, 1), ("2024-01-02 12:00:01", 99, 1)]  # moves the watermark past all windows
    late = [("2024-01-01 00:03:00", 1, 4)]  # too late: its window is over
    parts = [rows[k::4] for k in range(4)] + [last, late + [("2024-01-02 12:00:02", 99, 2)]]
    frame = lambda own: spark.createDataFrame(own, "ts string, pixel long, colour int").selectExpr("cast(ts as timestamp) ts", "pixel", "colour")
    folder, out, kept = (str(tmp_path / x) for x in ("in", "out", "kept"))
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(folder)
        traffic.run_to_table(latest_colour_stream(traffic.pixel_stream(spark, folder, SCHEMA, 1), "6 hours"), out, kept)
    want = traffic.latest_colours(frame(rows)).collect()
    got = spark.read.parquet(out).where("pixel <> 99").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 40
