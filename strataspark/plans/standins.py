"""The given tables in the roles of wells, rasters, adjustments and users; each function has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lines import ordinals

#: Vectors that one task numbers, about.
RANGE = 1000
AS_OF = "2024-02-01 00:00:00"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = t(spark, sf, "events").withColumn("idx", F.row_number().over(w) - 1)
    return e.select(F.col("user_id").alias("well"), F.col("event_type").alias("curve"), "idx", (100 + F.col("idx") * 0.3).alias("depth"), F.when(F.col("event_id") % 11 == 0, -999.25).otherwise(F.col("value")).alias("value"))


SAMPLES = """samples AS (SELECT user_id AS well, event_type AS curve, row_number() OVER w - 1 AS idx, 100 + (row_number() OVER w - 1) * 0.3::DOUBLE AS depth,
  CASE WHEN event_id % 11 = 0 THEN -999.25::DOUBLE ELSE value END AS value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, y, x, value, b, g, r, on, p.

    A label's vectors are numbered in ranges of ids, so that its rows, and the pixels that come of them, lie with many tasks.
    """
    e = t(spark, sf, "embeddings").withColumn("bucket", F.floor(F.col("vec_id") / RANGE))
    e = ordinals(e, ("label",), ("vec_id",), "y")
    e = e.select(F.col("label").cast("string").alias("image_id"), F.col("y").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.lit(255), F.floor(F.abs(F.col("e").cast("double")) * 600)).cast("int")
    e = e.select("image_id", "y", "x", v.alias("value"))
    return e.withColumn("b", F.col("value")).withColumn("g", (F.col("value") * 7 + F.col("x") * 3) % 256).withColumn("r", (F.col("value") * 13 + F.col("y") * 5) % 256).withColumn("on", F.col("value") > 60).withColumn("p", F.col("value") / 255)


RASTER = """rows0 AS (SELECT CAST(label AS VARCHAR) AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
pix0 AS (SELECT image_id, y, i - 1 AS x, CAST(least(255, floor(abs(embedding[i]::DOUBLE) * 600)) AS INTEGER) AS value FROM rows0, range(1, 65) t(i)),
pix AS (SELECT image_id, y, x, value, value AS b, (value * 7 + x * 3) % 256 AS g, (value * 13 + y * 5) % 256 AS r, value > 60 AS "on", value / 255.0::DOUBLE AS p FROM pix0)"""


def adjustments(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    k, v = F.get_json_object("props", "$.k").cast("double"), F.col("value")
    kind = F.when(F.col("event_type") == "click", "GR").when(F.col("event_type") == "view", "RHOB").when(F.col("event_type") == "error", "DT").otherwise(F.upper("event_type"))
    # The last types have few adjustments, or none that moves a parameter.
    few = (F.col("event_type") != "signup") | (F.col("event_id") % 1000 == 0)
    was = F.create_map(F.lit("left_px"), k, F.lit("max_step"), k, F.lit("smooth_lambda"), k / 100000, F.lit("mode"), k)
    now = F.create_map(F.lit("left_px"), k + v, F.lit("max_step"), k + v * 7, F.lit("smooth_lambda"), (k + v) / 100000, F.lit("jump_gate"), v)
    other = F.create_map(F.lit("mode"), k)
    plain = F.col("event_type") == "purchase"
    return e.where(few).select(F.col("event_id").alias("id"), kind.alias("curve_type"), F.col("ts").alias("timestamp"), F.when(plain, other).otherwise(was).alias("original_params"), F.when(plain, other).otherwise(now).alias("user_params"), (v % 1.0).alias("quality_score"))


ADJUSTMENTS = """adj AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'GR' WHEN 'view' THEN 'RHOB' WHEN 'error' THEN 'DT' ELSE upper(event_type) END AS curve_type, ts AS timestamp,
  CAST(props->>'k' AS DOUBLE) AS k, value, value % 1.0 AS quality_score FROM events WHERE event_type <> 'signup' OR event_id % 1000 = 0)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.concat(F.lit(" User"), (k % 700).cast("string"), F.lit("@Firm"), (k % 97).cast("string"), F.lit(".COM ")).alias("email"), F.concat(F.col("c_mktsegment"), F.lit("  Co "), (k % 211).cast("string")).alias("company_name"),
                    F.when(k % 50 == 0, 1).otherwise(0).alias("trial_used"), F.when(k % 3 == 0, "trialing").when(k % 3 == 1, "active").otherwise("canceled").alias("status"), F.when(k % 4 == 0, F.col("c_name")).alias("customer"), F.when(k % 5 == 0, F.concat(F.lit("sub_"), k.cast("string"))).alias("subscription_id"))


USERS = """u0 AS (SELECT c_custkey AS id, lower(trim(' User' || (c_custkey % 700) || '@Firm' || (c_custkey % 97) || '.COM ')) AS email,
  regexp_replace(lower(trim(c_mktsegment || '  Co ' || (c_custkey % 211))), '\\s+', ' ', 'g') AS company_key, CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS trial_used,
  CASE c_custkey % 3 WHEN 0 THEN 'trialing' WHEN 1 THEN 'active' ELSE 'canceled' END AS status, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS customer FROM customer),
users AS (SELECT *, split_part(email, '@', 2) AS domain FROM u0 WHERE id IN (SELECT min(id) FROM u0 GROUP BY email))""".replace("\\\\", "\\")
