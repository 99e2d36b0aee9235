"""Queries of correction learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import learning
from .registry import query, r6, whole
from .standins import ADJUSTMENTS, AS_OF, adjustments, t


def _now():
    return F.to_timestamp(F.lit(AS_OF))


@query("lrn_latest", f"""WITH {ADJUSTMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY curve_type ORDER BY timestamp DESC, id DESC) AS rn FROM adj)
SELECT id, curve_type, row_number() OVER (PARTITION BY curve_type ORDER BY timestamp, id) AS place FROM n WHERE rn <= 100""")
def lrn_latest(spark, sf):
    return whole(learning.latest(adjustments(spark, sf), 100).select("id", "curve_type", "place"), "place")


@query("lrn_by_type", f"""WITH {ADJUSTMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY curve_type ORDER BY timestamp DESC, id DESC) AS rn FROM adj)
SELECT curve_type, count(*) AS n, string_agg(id, ',' ORDER BY timestamp, id) AS ids FROM n WHERE rn <= 50 GROUP BY 1""")
def lrn_by_type(spark, sf):
    a = learning.by_type(adjustments(spark, sf).select("id", "curve_type", "timestamp", "quality_score"), 50)
    return a.select("curve_type", F.size("adjustments").cast("long").alias("n"), F.array_join(F.transform("adjustments", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("lrn_stats", f"""WITH {ADJUSTMENTS} SELECT curve_type, count(*) AS count, round(avg(quality_score), 6) AS mean_quality, max(timestamp) AS last_timestamp FROM adj GROUP BY 1""")
def lrn_stats(spark, sf):
    return r6(learning.stats(adjustments(spark, sf)), "mean_quality")


@query("lrn_defaults", f"""WITH {ADJUSTMENTS} SELECT curve_type, param, round(d::DOUBLE, 6) AS "default" FROM (SELECT DISTINCT curve_type FROM adj),
  (VALUES ('left_px', 0), ('right_px', 100), ('rail_threshold', 0.02), ('rail_penalty', 10000), ('smooth_lambda', 0.00001), ('max_step', 100), ('search_window', 100), ('jump_gate', 0.06)) v(param, d)""")
def lrn_defaults(spark, sf):
    return r6(learning.defaults(adjustments(spark, sf).select("curve_type").distinct()), "default")


_LEARNED = f"""{ADJUSTMENTS}, d AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(timestamp)) AS age FROM adj), c AS (SELECT curve_type, count(*) AS total, count(*) FILTER (age < 2592000000000) AS fresh FROM d GROUP BY 1),
u AS (SELECT d.*, total, floor(age / 86400000000) AS days FROM d JOIN c USING (curve_type) WHERE total >= 3 AND (age < 2592000000000 OR fresh < 3)),
p AS (SELECT curve_type, 'left_px' AS param, (k + value) - k AS delta, quality_score, days, 1.0::DOUBLE AS w, 0.0::DOUBLE AS base FROM u WHERE curve_type <> 'PURCHASE'
  UNION ALL SELECT curve_type, 'max_step', (k + value * 7) - k, quality_score, days, 1.0, 100.0 FROM u WHERE curve_type <> 'PURCHASE'
  UNION ALL SELECT curve_type, 'smooth_lambda', (k + value) / 100000 - k / 100000, quality_score, days, 1.5, 0.00001 FROM u WHERE curve_type <> 'PURCHASE'),
a AS (SELECT curve_type, param, base, avg(delta * quality_score * greatest(0.1, 1 - days / 30) * w) AS moved, 1 / (1 + stddev_pop(delta)) AS steady FROM p GROUP BY 1, 2, 3),
q AS (SELECT curve_type, count(*) AS n, avg(quality_score) AS q FROM u GROUP BY 1), s AS (SELECT curve_type, avg(steady) AS steady FROM a GROUP BY 1),
l AS (SELECT c.curve_type, a.param, CASE WHEN base IS NOT NULL THEN greatest(0.1, base + moved) END AS value, base AS "default", coalesce(least(1, n / 10 * q.q * coalesce(s.steady, 0.5)), 0) AS confidence, c.total AS sample_size
  FROM c LEFT JOIN q USING (curve_type) LEFT JOIN s USING (curve_type) LEFT JOIN a USING (curve_type))"""


@query("lrn_learned", f"""WITH {_LEARNED} SELECT curve_type, param, round(value, 6) AS value, round("default", 6) AS "default", round(confidence::DOUBLE, 6) AS confidence, sample_size FROM l""")
def lrn_learned(spark, sf):
    return r6(learning.learned(adjustments(spark, sf), _now()), "value", "default", "confidence")


@query("lrn_learned_daily", f"""WITH {_LEARNED} SELECT curve_type, param, round(value, 6) AS value, round("default", 6) AS "default", round(confidence::DOUBLE, 6) AS confidence, sample_size FROM l""")
def lrn_learned_daily(spark, sf):
    """The same from daily sums, which the learning stream keeps: the adjustments are read once."""
    return r6(learning.learned_of(learning.daily_sums(adjustments(spark, sf)), _now()), "value", "default", "confidence")


@query("lrn_suggestions", f"""WITH {_LEARNED} SELECT curve_type, param, round(value, 6) AS value, CASE WHEN value > "default" THEN 'increase' ELSE 'decrease' END AS direction,
  CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS band FROM l WHERE confidence >= 0.3 AND abs(value - "default") > 0.1 * abs("default")""")
def lrn_suggestions(spark, sf):
    s = learning.suggestions(learning.learned(adjustments(spark, sf), _now()))
    return s.select("curve_type", "param", F.round("value", 6).alias("value"), "direction", C.confidence_band(F.col("confidence")).alias("band"))


@query("lrn_enriched", f"""WITH {_LEARNED} SELECT p.event_id AS proposal, p.curve_type, round(x.value, 6) AS left_px, round(x.confidence::DOUBLE, 6) AS confidence FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'gr' WHEN 'error' THEN 'DT' WHEN 'signup' THEN 'SIGNUP' ELSE 'CALI' END AS curve_type FROM events) p
LEFT JOIN (SELECT * FROM l WHERE confidence > 0.3 AND param = 'left_px' AND curve_type IN ('GR', 'RHOB', 'NPHI', 'DT', 'CALI', 'SP')) x ON x.curve_type = upper(p.curve_type)""")
def lrn_enriched(spark, sf):
    kind = F.when(F.col("event_type") == "click", "gr").when(F.col("event_type") == "error", "DT").when(F.col("event_type") == "signup", "SIGNUP").otherwise("CALI")
    p = t(spark, sf, "events").select(F.col("event_id").alias("proposal"), kind.alias("curve_type"))
    e = learning.enriched(p, learning.learned(adjustments(spark, sf), _now()))
    return e.select("proposal", "curve_type", F.round(F.element_at("learned", F.lit("left_px")), 6).alias("left_px"), F.round("confidence", 6).alias("confidence"))


@query("lrn_recent_quality", f"""WITH {ADJUSTMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY curve_type ORDER BY timestamp DESC, id DESC) AS rn FROM adj)
SELECT curve_type, round(avg(quality_score), 6) AS quality, avg(quality_score) > 0.8 AS high_confidence FROM n WHERE rn <= 10 GROUP BY 1 HAVING count(*) >= 3""")
def lrn_recent_quality(spark, sf):
    return r6(learning.recent_quality(adjustments(spark, sf)), "quality")


@query("lrn_edit_quality", """SELECT event_id, round(least(1.0, greatest(0.1, CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 1.0 END * CASE WHEN event_id % 3 = 0 THEN 0.9 ELSE 1.0 END * CASE WHEN event_id % 5 = 0 THEN 1.2 ELSE 1.0 END))::DOUBLE, 6) AS quality FROM events""")
def lrn_edit_quality(spark, sf):
    e = F.col("event_id")
    return t(spark, sf, "events").select("event_id", F.round(C.edit_quality(e % 2 == 0, e % 3 == 0, e % 5 == 0), 6).alias("quality"))
