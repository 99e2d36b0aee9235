"""Streams with state against batches, after every micro-batch."""

from pyspark.sql import functions as F

from strataspark.operators import accounts, learning
from strataspark.plans.standins import AS_OF, adjustments
from strataspark.streaming import feeds

EVENT = "user_id long, created timestamp, seq long, event_type string, status string, plan string, trial_end long"


def events(spark, n, users):
    rows = [(u if u else None, f"2024-01-{1 + (u * s) % 27:02d} 00:00:00", s, "deleted" if (u + s) % 5 == 0 else "updated", "Trialing" if s % 4 == 2 else "active", f"p{s}", s if s % 2 else None) for s in range(n) for u in users]
    return spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("created", F.to_timestamp("created"))


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_subscriptions_after_every_batch(spark, tmp_path):
    table, cp, done = str(tmp_path / "state"), str(tmp_path / "cp"), None
    for i, users in enumerate((range(6), [1], [2, 3], [1], [0])):
        new = events(spark, 3, users).withColumn("seq", F.col("seq") + 10 * i).withColumn("created", F.col("created") + F.expr(f"interval {i % 3} days"))
        new.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = new if done is None else done.union(new)
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        feeds.subscription_stream(stream, table, cp, buckets=4).awaitTermination()
        assert rows(feeds.subscription_state(spark, table)) == rows(accounts.subscription_fold(done))
    written = {v.name: sorted(b.name for b in v.iterdir() if b.is_dir()) for v in (tmp_path / "state").iterdir()}
    assert len(written["v=1"]) <= 1 and len(written.get("v=3", [])) == 1  # a batch of one user writes one bucket
    bucket = written["v=3"][0]
    assert sum(bucket in held for held in written.values()) == 2  # the last version and the one before


def test_learning_after_every_batch(spark, sf, tmp_path):
    a = adjustments(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    odd = spark.createDataFrame([(-1, "GR", None, {"max_step": 1.0}, {"max_step": 4.0}, 0.5), (-2, "NEW", None, {"max_step": 1.0}, {"max_step": 4.0}, None)], "id long, curve_type string, timestamp timestamp, original_params map<string,double>, user_params map<string,double>, quality_score double")
    parts = [a.where("id % 3 = 0"), a.where("id % 3 = 1").unionByName(odd), a.where("id % 3 = 2")]
    now, done = F.to_timestamp(F.lit(AS_OF)), None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = part if done is None else done.unionByName(part)
        stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
        feeds.learning_stream(stream, str(tmp_path / "sums"), str(tmp_path / "cp"), compact=2).awaitTermination()
        for as_of in (now, F.to_timestamp(F.lit("2024-01-10 00:00:00"))):
            assert rows(learning.learned_of(feeds.learning_state(spark, str(tmp_path / "sums")), as_of)) == rows(learning.learned(done, as_of))
    assert not (tmp_path / "sums/v=0").exists() and (tmp_path / "sums/v=2").exists()


def test_sums_of_another_time_of_day(spark, sf):
    a = adjustments(spark, sf)
    noon = 12 * 3600 * 1_000_000
    as_of = F.to_timestamp(F.lit("2024-01-20 12:00:00"))
    assert rows(learning.learned_of(learning.daily_sums(a, noon), as_of, noon)) == rows(learning.learned(a, as_of))


def test_stats_stream_equals_batch(spark, sf, tmp_path):
    a = adjustments(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.stats_stream(stream).writeStream.format("memory").outputMode("complete").queryName("stats_now").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("stats_now")) == rows(learning.stats(a))
