import datetime as dt

from pyspark.sql import functions as F

from veristrata.operators import ranking as R
from veristrata.streaming import events as S


def run(spark, tmp_path, name, fn, rows, mode="append"):
    d = tmp_path / name
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.parquet(str(d / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double").parquet(str(d / "in"))
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(d / "cp")).trigger(availableNow=True).start()
    if not q.awaitTermination(60):
        q.stop()
        raise TimeoutError(name)
    return spark.table(name)


ROWS = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", 1.5) for i in range(60)]


def test_metered(spark, tmp_path):
    got = run(spark, tmp_path, "metered", lambda s: S.metered(s, "1 minute", "1 hour"), ROWS, "update").groupBy().agg(F.sum("runs"), F.sum("cents")).first()
    assert tuple(got) == (60, 60 * 150)


def test_duplicates(spark, tmp_path):
    assert run(spark, tmp_path, "once", lambda s: S.once(s), ROWS + ROWS[:10]).count() == 60


def test_limited_as_batch(spark, tmp_path):
    got = {r["event_id"]: r["admitted"] for r in run(spark, tmp_path, "limited", lambda s: S.limited(s, 2, 3600), ROWS).collect()}
    batch = R.admit(spark.createDataFrame([(r[2], r[0], r[1]) for r in ROWS], "user_id bigint, event_id bigint, ts timestamp"), "user_id", "ts", "event_id", 2, 3600)
    assert got == {r["event_id"]: r["admitted"] for r in batch.collect()}


def test_quota(spark, tmp_path):
    got = sorted(r["event_id"] for r in run(spark, tmp_path, "quota", lambda s: S.within_quota(s, 2), ROWS).collect())
    assert got == [0, 1, 2, 3, 4, 5]
