"""Correction learning over adjustments: id, curve_type, timestamp, original_params, user_params (maps of doubles), quality_score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tracer parameters that are learned, with the weights of their corrections, and their defaults, which are those of every curve type.
WEIGHTS = {
    "left_px": 1.0,
    "right_px": 1.0,
    "rail_threshold": 2.0,
    "rail_penalty": 1.5,
    "smooth_lambda": 1.5,
    "max_step": 1.0,
    "search_window": 1.0,
    "jump_gate": 2.0,
}
DEFAULTS = {
    "left_px": 0.0,
    "right_px": 100.0,
    "rail_threshold": 0.02,
    "rail_penalty": 10000.0,
    "smooth_lambda": 0.00001,
    "max_step": 100.0,
    "search_window": 100.0,
    "jump_gate": 0.06,
}
#: Curve types whose proposals are enriched.
ENRICHED = ("GR", "RHOB", "NPHI", "DT", "CALI", "SP")
LEAST, RECENT_DAYS, HALF = 3, 30, 0.3


def _parameters(df: DataFrame) -> DataFrame:
    rows = [(p, w, DEFAULTS[p]) for p, w in WEIGHTS.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "param string, weight double, default double"))


def defaults(types: DataFrame) -> DataFrame:
    """curve_type, param, default of each type of types(curve_type): eight rows a type."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, DEFAULTS)), F.array(*map(F.lit, DEFAULTS.values())))
    return types.select("curve_type", F.explode(pairs).alias("param", "default"))


def latest(adjustments: DataFrame, n: int) -> DataFrame:
    """Each type's latest n, with place (1 = oldest of them)."""
    new = Window.partitionBy("curve_type").orderBy(F.desc("timestamp"), F.desc("id"))
    kept = adjustments.withColumn("_n", F.row_number().over(new)).where(F.col("_n") <= n)
    old = Window.partitionBy("curve_type").orderBy("timestamp", "id")
    return kept.withColumn("place", F.row_number().over(old)).drop("_n")


def by_type(adjustments: DataFrame, n: int) -> DataFrame:
    """curve_type, adjustments: each type's latest n in order of time, as one value."""
    cols = [c for c in adjustments.columns if c != "curve_type"]
    held = latest(adjustments, n).groupBy("curve_type").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*cols).alias("a")))).alias("r"))
    return held.select("curve_type", F.transform("r", lambda x: x["a"]).alias("adjustments"))


def stats(adjustments: DataFrame) -> DataFrame:
    return adjustments.groupBy("curve_type").agg(F.count(F.lit(1)).alias("count"), F.avg("quality_score").alias("mean_quality"), F.max("timestamp").alias("last_timestamp"))


def used(adjustments: DataFrame, as_of: Column) -> DataFrame:
    """Adjustments of types that have three, with days and sample_size: those under 30 days old where a type has three of them, else all of it.

    Types are few, so their counts are one row each, which goes to the rows; no type is gathered.
    """
    age = F.unix_micros(as_of) - F.unix_micros(F.col("timestamp").cast("timestamp"))
    a = adjustments.withColumn("fresh", age < RECENT_DAYS * 86_400_000_000).withColumn("days", F.floor(age / 86_400_000_000))
    n = a.groupBy("curve_type").agg(F.count(F.lit(1)).alias("sample_size"), F.count_if("fresh").alias("_f"))
    return a.join(n, "curve_type").where((F.col("sample_size") >= LEAST) & (F.col("fresh") | (F.col("_f") < LEAST))).drop("_f", "fresh")


def deltas(adjustments: DataFrame) -> DataFrame:
    """curve_type, param, delta, quality_score, days for the learned parameters that both sides have."""
    e = adjustments.select("curve_type", "quality_score", "days", "user_params", F.explode("original_params").alias("param", "was"))
    now = F.element_at("user_params", F.col("param"))
    e = e.where(F.col("was").isNotNull() & now.isNotNull() & F.col("param").isin(*WEIGHTS))
    return e.select("curve_type", "param", (now - F.col("was")).alias("delta"), "quality_score", "days")


def learned_rows(adjustments: DataFrame, as_of: Column) -> DataFrame:
    """curve_type, param, value, default of every parameter that corrections moved: the default and the weighted mean of the moves, at least 0.1."""
    d = deltas(used(adjustments, as_of))
    moved = F.avg(F.col("delta") * F.col("quality_score") * F.greatest(F.lit(0.1), 1 - F.col("days") / float(RECENT_DAYS)) * F.col("weight"))
    per = d.join(_parameters(d), "param").groupBy("curve_type", "param", "default").agg(moved.alias("moved"))
    return per.select("curve_type", "param", F.greatest(F.lit(0.1), F.col("default") + F.col("moved")).alias("value"), "default")


def confidences(adjustments: DataFrame, as_of: Column) -> DataFrame:
    """curve_type, confidence, sample_size (all of the type's adjustments): min(1, n/10 times mean quality times mean consistency); the consistency is 0.5 where no parameter was moved; types under three have confidence 0."""
    held = used(adjustments, as_of)
    steady = deltas(held).groupBy("curve_type", "param").agg((1 / (1 + F.stddev_pop("delta"))).alias("s")).groupBy("curve_type").agg(F.avg("s").alias("steady"))
    size = held.groupBy("curve_type").agg(F.count(F.lit(1)).alias("n"), F.avg("quality_score").alias("q"))
    total = adjustments.groupBy("curve_type").agg(F.count(F.lit(1)).alias("sample_size"))
    j = total.join(size, "curve_type", "left").join(steady, "curve_type", "left")
    c = F.least(F.lit(1.0), F.col("n") / 10.0 * F.col("q") * F.coalesce("steady", F.lit(0.5)))
    return j.select("curve_type", F.when(F.col("n") > 0, c).otherwise(0.0).alias("confidence"), "sample_size")


def learned(adjustments: DataFrame, as_of: Column) -> DataFrame:
    """curve_type, param, value, default, confidence, sample_size: a row a learned parameter; a type without any has one row with null param, value and default."""
    return confidences(adjustments, as_of).join(learned_rows(adjustments, as_of), "curve_type", "left").select("curve_type", "param", "value", "default", "confidence", "sample_size")


def suggestions(learnt: DataFrame) -> DataFrame:
    far = F.abs(F.col("value") - F.col("default")) > 0.1 * F.abs("default")
    return learnt.where((F.col("confidence") >= HALF) & far).withColumn("direction", F.when(F.col("value") > F.col("default"), "increase").otherwise("decrease"))


def enriched(proposals: DataFrame, learnt: DataFrame) -> DataFrame:
    """Proposals (curve_type) with the learned parameters and confidence of a known type where that exceeds 0.3."""
    few = learnt.where((F.col("confidence") > HALF) & F.upper("curve_type").isin(*ENRICHED))
    pairs = F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "value"))))))
    m = few.groupBy(F.upper("curve_type").alias("_t")).agg(pairs.alias("learned"), F.first("confidence").alias("confidence"))
    return proposals.join(m, F.upper("curve_type") == F.col("_t"), "left").drop("_t")


def recent_quality(adjustments: DataFrame) -> DataFrame:
    """curve_type, quality, high_confidence over the last ten; three are needed."""
    g = latest(adjustments, 10).groupBy("curve_type").agg(F.avg("quality_score").alias("quality"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= LEAST).select("curve_type", "quality", (F.col("quality") > 0.8).alias("high_confidence"))


# --- sums that stay valid while their weights fade -----------------------------------------------------------------------

DAY = 86_400_000_000
#: What is kept for each type, parameter (null: the type itself) and day.
SUMS = ("n", "qualities", "quality", "weighed", "weighed_sum", "moves", "mean", "spread")


def daily_sums(adjustments: DataFrame, time_of_day: int = 0) -> DataFrame:
    """curve_type, param, day and SUMS: counts and sums of adjustments and moves, from which learned_of() reads what learned() gives for any `as_of` at this time of day (in microseconds).

    A day ends at that time, so that all its adjustments are as many days old; what fades with age is applied at reading.
    It is one aggregation by key, so it runs on a stream as well.
    """
    named = F.transform(F.map_entries("original_params"), lambda e: F.struct(e["key"].alias("param"), (F.element_at("user_params", e["key"]) - e["value"]).alias("delta")))
    moved = F.filter(named, lambda e: e["param"].isin(*WEIGHTS) & e["delta"].isNotNull())
    own = F.array(F.struct(F.lit(None).cast("string").alias("param"), F.lit(None).cast("double").alias("delta")))
    day = F.ceil((F.unix_micros(F.col("timestamp").cast("timestamp")) - time_of_day) / DAY)
    e = adjustments.select("curve_type", day.alias("day"), "quality_score", F.explode(F.concat(own, F.coalesce(moved, F.filter(own, lambda _: F.lit(False))))).alias("e"))
    q, d = F.col("quality_score"), F.col("e.delta")
    return e.groupBy("curve_type", F.col("e.param").alias("param"), "day").agg(
        F.count(F.lit(1)).alias("n"), F.count(q).alias("qualities"), F.coalesce(F.sum(q), F.lit(0.0)).alias("quality"), F.count(d * q).alias("weighed"), F.coalesce(F.sum(d * q), F.lit(0.0)).alias("weighed_sum"),
        F.count(d).alias("moves"), F.avg(d).alias("mean"), (F.var_pop(d) * F.count(d)).alias("spread"))


def learned_of(sums: DataFrame, as_of: Column, time_of_day: int = 0) -> DataFrame:
    """What learned() gives, from daily_sums(); as_of is at their time of day."""
    days = F.floor((F.unix_micros(as_of) - time_of_day) / DAY) - F.col("day")
    s = sums.withColumn("days", days).withColumn("fresh", days < RECENT_DAYS)
    whole = s.where("param is null").groupBy("curve_type").agg(F.sum("n").alias("sample_size"), F.coalesce(F.sum(F.when(F.col("fresh"), F.col("n"))), F.lit(0)).alias("recent"))
    held = s.join(whole, "curve_type").where((F.col("sample_size") >= LEAST) & (F.col("fresh") | (F.col("recent") < LEAST)))
    moves = held.where("param is not null and moves > 0")
    fade = F.greatest(F.lit(0.1), 1 - F.col("days") / float(RECENT_DAYS))
    g = moves.groupBy("curve_type", "param").agg(F.sum(F.col("weighed_sum") * fade).alias("moved"), F.sum("weighed").alias("weighed"), F.sum("moves").alias("moves"), (F.sum(F.col("mean") * F.col("moves")) / F.sum("moves")).alias("centre"))
    spread = moves.join(g.select("curve_type", "param", "centre"), ["curve_type", "param"]).groupBy("curve_type", "param").agg(F.sum(F.col("spread") + F.col("moves") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("spread"))
    g = g.join(spread, ["curve_type", "param"]).join(_parameters(sums), "param")
    rows = g.select("curve_type", "param", F.greatest(F.lit(0.1), F.col("default") + F.when(F.col("weighed") > 0, F.col("moved") * F.col("weight") / F.col("weighed"))).alias("value"), "default", (1 / (1 + F.sqrt(F.col("spread") / F.col("moves")))).alias("steady"))
    size = held.where("param is null").groupBy("curve_type").agg(F.sum("n").alias("n"), (F.sum("quality") / F.sum("qualities")).alias("q"))
    steady = rows.groupBy("curve_type").agg(F.avg("steady").alias("steady"))
    j = whole.join(size, "curve_type", "left").join(steady, "curve_type", "left")
    c = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") / 10.0 * F.col("q") * F.coalesce("steady", F.lit(0.5)))).otherwise(0.0)
    return j.select("curve_type", c.alias("confidence"), "sample_size").join(rows.drop("steady"), "curve_type", "left").select("curve_type", "param", "value", "default", "confidence", "sample_size")
