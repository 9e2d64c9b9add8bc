from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marlstone.streaming.watch import debounced, new_files

T0 = dt.datetime(2024, 1, 1)


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(milliseconds=ms), p) for ms, p in ((0, "a"), (100, "a"), (499, "b"), (500, "a"), (20_000, "z"))]
    spark.createDataFrame(rows, "ts timestamp, path string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = debounced(stream, "ts", "path").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"], r["key"], r["n"]) for r in spark.table("windows").collect()}
    half = T0 + dt.timedelta(milliseconds=500)
    assert got == {(T0, "a", 2), (T0, "b", 1), (half, "a", 1)}


def test_new_files_appear(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x")
    q = new_files(spark, str(tmp_path / "d")).select(F.col("length")).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r[0] for r in spark.table("files").collect()] == [1]
