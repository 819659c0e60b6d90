"""Streaming forms on available data, in two runs over one checkpoint."""

from pyspark.sql import functions as F

from tidemark.streaming import jobs


def test_closed_sessions(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "session_id long, commit_time long, battle_score long, victories boolean"
    h = 3_600_000
    spark.createDataFrame([(1, 10 * h, 5, True), (1, 10 * h + 60_000, 7, None), (2, 10 * h, 1, False)], schema).write.mode("append").parquet(src)
    run = lambda: jobs.run_once(jobs.closed_sessions(jobs.stream_table(spark, src, schema)), out, ck)
    run()
    spark.createDataFrame([(3, 15 * h, 9, True)], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(4, 20 * h, 9, True)], schema).write.mode("append").parquet(src)
    run()
    got = {r.session_id: (r.seats, r.score, r.won) for r in spark.read.parquet(out).collect()}
    assert got[1] == (2, 12, True) and got[2] == (1, 1, False) and 4 not in got


def test_last_known(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "pid long, tick long, memory long, cpu_time long"
    spark.createDataFrame([(1, 1, 5, 5), (1, 2, 6, 6)], schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.run_once(jobs.last_known(jobs.stream_table(spark, src, schema)), out, ck)
    run()
    spark.createDataFrame([(1, 2, 6, 6), (1, 3, 7, 7), (2, 1, 1, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.pid, r.tick) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_hourly_catches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df = spark.createDataFrame([("A ", 5), ("a", 6)], "name string, mass long").withColumn("ts", F.lit("2013-01-01 05:10:00").cast("timestamp_ntz"))
    df.write.parquet(src)
    run = lambda: jobs.run_once(jobs.hourly_catches(jobs.stream_table(spark, src, df.schema)), out, ck)
    run()
    df.withColumn("ts", F.lit("2013-01-02 05:10:00").cast("timestamp_ntz")).write.mode("append").parquet(src)
    run()
    assert [(r.name, r.catches, r.mass) for r in spark.read.parquet(out).collect()] == [("a", 2, 11)]
