import datetime as dt

from lodestat.streaming import monitor


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(t + dt.timedelta(minutes=7 * i), "a" if i % 3 else "b", None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    batch = {(r["window_start"], r["kind"]): tuple(r[2:]) for r in monitor.windowed_quality(df, "ts", "value", (3.0, 50.0), "kind").collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    q = monitor.windowed_quality(stream, "ts", "value", (3.0, 50.0), "kind").writeStream.outputMode("complete").format("memory").queryName("quality_counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["kind"]): tuple(r[2:]) for r in spark.table("quality_counts").collect()}
    assert got == batch and sum(v[0] for v in got.values()) == 60
