"""Streaming operators and written reports."""

import datetime

from vellum.sources import sinks
from vellum.streaming import progress


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_monotone_stream(spark, tmp_path):
    rows = [(j, i, f) for j in (1, 2) for i, f in enumerate((0.1, 0.5, 0.3, 0.9, 0.2))]
    for k, part in enumerate((rows[:3] + rows[5:7], rows[3:5] + rows[7:])):
        spark.createDataFrame(part, "job_id long, seq long, fraction double").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("job_id long, seq long, fraction double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = run(spark, progress.monotone_stream(stream), "bars")
    assert sorted((r.job_id, r.seq, r.shown) for r in got) == [(j, i, f) for j in (1, 2) for i, f in enumerate((0.1, 0.5, 0.5, 0.9, 0.9))]


def test_windows_and_sessions(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(t0 + datetime.timedelta(minutes=m), u, "view") for m, u in ((0, 1), (10, 1), (90, 1), (95, 2), (400, 3))]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "e"))
    assert sorted(r.n for r in run(spark, progress.activity_windows(read()), "wins")) == [2, 2]
    assert sorted((r.user_id, r.n) for r in run(spark, progress.activity_sessions(read()), "sess")) == [(1, 1), (1, 2), (2, 1)]


def test_written_reports_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("j1", 1, "WARN", datetime.datetime(2024, 1, 1)), ("j2", 2, "INFO", datetime.datetime(2024, 1, 2))], "job string, n int, level string, ts timestamp")
    sinks.write_reports(df, str(tmp_path / "r"), "job")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sinks.write_logs(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l/all")).count() == 2 and spark.read.parquet(str(tmp_path / "l/alerts")).count() == 1
