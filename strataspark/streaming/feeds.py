"""Append-only feeds as Structured Streaming jobs; each gives what its batch twin gives."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.accounts import subscription_fold
from ..operators.learning import SUMS, daily_sums
from ..operators.training import corrections as selected
from ..sources.records import CORRECTION


def correction_stream(spark: SparkSession, root: str, late: str = "1 hour") -> DataFrame:
    """Corrections as they land, each event id once within the watermark, selected as in batch."""
    r = spark.readStream.schema(CORRECTION).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root)
    return selected(r.withWatermark("ts_utc", late).dropDuplicatesWithinWatermark(["event_id"]))


def stats_stream(adjustments: DataFrame) -> DataFrame:
    """Running count, mean quality and last time by curve type (update or complete mode)."""
    return adjustments.groupBy("curve_type").agg(F.count(F.lit(1)).alias("count"), F.avg("quality_score").alias("mean_quality"), F.max("timestamp").alias("last_timestamp"))


def learning_stream(adjustments: DataFrame, table: str, checkpoint: str, time_of_day: int = 0, compact: int = 50) -> StreamingQuery:
    """Keeps the sums from which learning is read current: a stateful aggregation by type, parameter and day, whose changed rows each batch writes.

    A batch costs the keys it touches: their sums stand in the query's state store, and v=<batch> holds their new values.
    Every `compact` batches the latest values of all keys are written as one version, and older versions go. A batch that
    runs again writes its version again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and number % compact == 0:
            old = _versions(table)
            if old:
                fresh = batch.select("curve_type", "param", "day", *SUMS).withColumn("v", F.lit(number))
                held = spark.read.parquet(*(f"{table}/v={v}" for v in old if v < number)).withColumn("v", F.regexp_extract("_metadata.file_path", r"/v=(\d+)/", 1).cast("int"))
                batch = _latest(held.unionByName(fresh))
            batch.write.mode("overwrite").parquet(f"{table}/v={number}")
            _expire(*(f"{table}/v={v}" for v in old if v < number))
        else:
            batch.write.mode("overwrite").parquet(f"{table}/v={number}")

    sums = daily_sums(adjustments, time_of_day)
    return sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(versions: DataFrame) -> DataFrame:
    """The latest version (v) of each key's sums."""
    return versions.groupBy("curve_type", "param", "day").agg(F.max_by(F.struct(*SUMS), "v").alias("s")).select("curve_type", "param", "day", "s.*")


def learning_state(spark: SparkSession, table: str) -> DataFrame:
    """The sums as they stand; learning.learned_of() reads what they teach."""
    return _latest(spark.read.parquet(table))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or ":/" in path else f"file://{path}")


def _versions(table: str) -> list[int]:
    """The numbers of the versions in a folder, in order."""
    store, top = _store(table)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted(int(f.base_name[2:]) for f in found if f.base_name.startswith("v="))


def _expire(*paths: str) -> None:
    for path in paths:
        store, top = _store(path)
        store.delete_dir(top)


#: Buckets that users are dealt to by a hash of their id.
BUCKETS = 64
_EVENT = ["user_id", "created", "seq", "event_type", "status", "plan", "trial_end"]


def subscription_stream(events: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps what decides each user's subscription: events are folded into the buckets of the users that a batch names, and only those buckets are written anew.

    The table has folders v=<batch>/bucket=<b>; a bucket's latest version counts. A batch that runs again reads the
    versions before it and writes its own again, so the version before the last is kept and older ones of the written
    buckets go. The latest event by time wins.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*_EVENT).where("user_id is not null").withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
            if not touched:
                return
            store, top = _store(table)
            has = lambda v, b: store.get_file_info(f"{top}/v={v}/bucket={b}").type != fs.FileType.NotFound
            before = {b: [v for v in _versions(table) if v < number and has(v, b)] for b in touched}
            paths = [f"{table}/v={vs[-1]}/bucket={b}" for b, vs in before.items() if vs]
            held = new
            if paths:
                old = spark.read.schema(new.drop("bucket").schema).parquet(*paths).withColumn("bucket", F.regexp_extract("_metadata.file_path", r"/bucket=(\d+)/", 1).cast("int"))
                held = new.unionByName(old)
            # The trial flag and the trial's end need more than the latest event: the latest that trials, and the latest that doesn't end.
            e = held.withColumn("s", F.struct(*_EVENT[1:]))
            when, open_ = F.struct("created", "seq"), F.col("event_type") != "deleted"
            trial = open_ & (F.lower("status") == "trialing")
            g = e.groupBy("bucket", "user_id").agg(F.max_by("s", when).alias("a"), F.max_by("s", F.when(trial, when)).alias("b"), F.max_by("s", F.when(open_, when)).alias("c"))
            state = g.select("bucket", "user_id", F.explode(F.array_distinct(F.array_compact(F.array("a", "b", "c")))).alias("s")).select("bucket", "user_id", "s.*")
            state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")
            _expire(*(f"{table}/v={v}/bucket={b}" for b, vs in before.items() for v in vs[:-1]))
        finally:
            new.unpersist()

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscription_state(spark: SparkSession, table: str) -> DataFrame:
    """Each user's subscription, from the latest version of every bucket."""
    held = spark.read.parquet(table)
    last = held.groupBy("bucket").agg(F.max("v").alias("v"))
    return subscription_fold(held.join(F.broadcast(last), ["bucket", "v"], "left_semi"))
