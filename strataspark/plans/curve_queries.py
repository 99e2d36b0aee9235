"""Queries over curve tables and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import curves
from .registry import pick, query, r6
from .standins import SAMPLES, samples, t

_V = "CASE WHEN isnan(value) OR value IN (-999.25, -999, -9999, 999.25) THEN NULL ELSE value END"
_FEATURES = f"""v AS (SELECT *, {_V} AS v FROM samples),
ok AS (SELECT well, curve, idx, v, abs(v - lag(v) OVER (PARTITION BY well, curve ORDER BY idx)) AS step FROM v WHERE v IS NOT NULL),
sd AS (SELECT *, stddev_pop(step) OVER (PARTITION BY well, curve) AS sd FROM ok),
sp AS (SELECT well, curve, count(*) FILTER (sd > 1e-6 AND step > 5 * sd) AS k FROM sd GROUP BY 1, 2),
f AS (SELECT well, curve, count(*) AS num_samples, count(v) AS num_valid, min(v) AS "min", max(v) AS "max", avg(v) AS mean, stddev_pop(v) AS std,
  quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95 FROM v GROUP BY 1, 2),
g AS (SELECT f.*, (1 - num_valid / num_samples) * 100 AS pct_missing, CASE WHEN num_valid > 10 THEN coalesce(k, 0) / num_valid * 100 ELSE 0 END AS pct_spikes FROM f LEFT JOIN sp USING (well, curve)),
fl AS (SELECT *, concat_ws(',', CASE WHEN pct_missing > 30 THEN 'high_missing' END, CASE WHEN pct_spikes > 5 THEN 'spiky' END) AS flags FROM g)"""


@query("crv_features", f"""WITH {SAMPLES}, {_FEATURES}
SELECT well, curve, num_samples, num_valid, round("min", 6) AS "min", round("max", 6) AS "max", round(mean, 6) AS mean, round(std, 6) AS std, round(p05, 6) AS p05,
  round(p50, 6) AS p50, round(p95, 6) AS p95, round(pct_missing, 6) AS pct_missing, round(pct_spikes, 6) AS pct_spikes, flags FROM fl""")
def crv_features(spark, sf):
    f = curves.features(samples(spark, sf))
    f = f.withColumn("flags", F.array_join(C.quality_flags(F.col("pct_missing"), F.col("pct_spikes")), ","))
    return r6(f, "min", "max", "mean", "std", "p05", "p50", "p95", "pct_missing", "pct_spikes")


@query("crv_well_info", f"""WITH {SAMPLES} SELECT well, round(arg_min(depth, idx), 6) AS first_depth, round(arg_max(depth, idx), 6) AS last_depth, count(*) AS num_samples FROM samples GROUP BY 1""")
def crv_well_info(spark, sf):
    return r6(curves.well_info(samples(spark, sf)), "first_depth", "last_depth")


@query("crv_type_guess", """WITH x AS (SELECT p_partkey, upper(['GR', 'SGR', 'RHOZ', 'RHOB2', 'TNPH', 'nphi', 'DTCO', 'CALI', 'CAL', 'SP', 'ILD', 'RESD', 'XX'][1 + p_partkey % 13]) AS m,
  upper(['GAPI', 'G/C3', 'OHMM', 'ohm-m', '', 'V/V'][1 + p_size % 6]) AS u,
  upper(['gamma ray', 'bulk density', 'neutron', 'porosity', 'sonic', 'caliper', 'Spontaneous potential', 'resistivity', 'rho b', ''][1 + (p_partkey // 13) % 10]) AS d FROM part),
y AS (SELECT *, m || ' ' || u || ' ' || d AS s FROM x),
z AS (SELECT p_partkey, CASE WHEN contains(m, 'GR') OR contains(s, 'GAMMA') THEN 'GR' WHEN contains(m, 'RHOB') OR contains(s, 'DENSITY') OR contains(s, 'RHO B') THEN 'RHOB'
  WHEN contains(m, 'NPHI') OR contains(s, 'NEUT') OR contains(s, 'POROSITY') THEN 'NPHI' WHEN contains(m, 'DT') OR contains(s, 'SONIC') THEN 'DT' WHEN contains(m, 'CALI') OR contains(s, 'CALIPER') THEN 'CALI'
  WHEN contains(m, 'SP') OR contains(s, 'SPONTANEOUS') THEN 'SP' WHEN contains(m, 'RES') OR contains(s, 'RESISTIVITY') OR contains(s, 'OHMM') OR contains(u, 'OHM-M') THEN 'RES' END AS type FROM y)
SELECT p_partkey, type, CASE type WHEN 'GR' THEN 'GR' WHEN 'RHOB' THEN 'RHOB' WHEN 'NPHI' THEN 'NPHI' WHEN 'DT' THEN 'DTC' WHEN 'CALI' THEN 'CALI' WHEN 'SP' THEN 'SP' END AS mnemonic,
  CASE type WHEN 'GR' THEN 'API' WHEN 'RHOB' THEN 'G/CC' WHEN 'NPHI' THEN 'V/V' WHEN 'DT' THEN 'US/F' WHEN 'CALI' THEN 'IN' WHEN 'SP' THEN 'MV' END AS unit FROM z""")
def crv_type_guess(spark, sf):
    k = F.col("p_partkey")
    m = pick(k % 13, "GR", "SGR", "RHOZ", "RHOB2", "TNPH", "nphi", "DTCO", "CALI", "CAL", "SP", "ILD", "RESD", "XX")
    u = pick(F.col("p_size") % 6, "GAPI", "G/C3", "OHMM", "ohm-m", "", "V/V")
    d = pick(F.floor(k / 13) % 10, "gamma ray", "bulk density", "neutron", "porosity", "sonic", "caliper", "Spontaneous potential", "resistivity", "rho b", "")
    p = t(spark, sf, "part").select("p_partkey", C.curve_type(m, u, d).alias("type"))
    return p.select("p_partkey", "type", C.type_default(F.col("type"), 0).alias("mnemonic"), C.type_default(F.col("type"), 1).alias("unit"))


@query("crv_labels", """WITH x AS (SELECT p_partkey, upper(p_name || ' ' || ['gamma ray', 'LWD Res', 'RHO B', 'phi n', 'photoelectric', 'Pe', 'neut', 'ILD', 'bulk density', '-', 'lld'][1 + p_partkey % 11] || ' ' || p_brand) AS s FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN contains(s, 'GR') OR contains(s, 'GAMMA RAY') THEN 'GR' END,
  CASE WHEN contains(s, 'NPHI') OR contains(s, 'NEUTRON POROSITY') OR contains(s, 'NEUT') OR contains(s, 'PHI N') THEN 'NPHI' END,
  CASE WHEN contains(s, 'PEF') OR contains(s, 'PHOTOELECTRIC') OR contains(s, 'PE') THEN 'PEF' END,
  CASE WHEN contains(s, 'RES') OR contains(s, 'RESISTIVITY') OR contains(s, 'ILD') OR contains(s, 'LLD') OR contains(s, 'LWD RES') THEN 'RES' END,
  CASE WHEN contains(s, 'RHOB') OR contains(s, 'DENSITY') OR contains(s, 'RHO B') OR contains(s, 'BULK DENSITY') THEN 'RHOB' END) AS labels FROM x""")
def crv_labels(spark, sf):
    word = pick(F.col("p_partkey") % 11, "gamma ray", "LWD Res", "RHO B", "phi n", "photoelectric", "Pe", "neut", "ILD", "bulk density", "-", "lld")
    return t(spark, sf, "part").select("p_partkey", F.array_join(C.curve_labels(F.concat_ws(" ", "p_name", word, "p_brand")), ",").alias("labels"))


@query("crv_label_mapping", """WITH c AS (SELECT p_brand AS well, p_partkey AS pos, CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS mnemonic FROM part),
l AS (SELECT DISTINCT p_brand AS well, upper(split_part(p_name, ' ', 2)) AS label FROM part),
j AS (SELECT l.well, l.label, c.mnemonic, upper(c.mnemonic) <> l.label AS loose, c.pos FROM l LEFT JOIN c ON c.well = l.well AND contains(upper(c.mnemonic), l.label))
SELECT well, label, mnemonic FROM (SELECT *, row_number() OVER (PARTITION BY well, label ORDER BY loose, CASE WHEN loose THEN pos ELSE -pos END) AS n FROM j) WHERE n = 1""")
def crv_label_mapping(spark, sf):
    p = t(spark, sf, "part")
    second = F.split("p_name", " ")[1]
    m = F.when(F.col("p_size") % 4 == 0, second).otherwise(F.col("p_name"))
    labels = p.select(F.col("p_brand").alias("well"), F.upper(second).alias("label")).distinct()
    return curves.label_mapping(labels, p.select(F.col("p_brand").alias("well"), F.col("p_partkey").alias("pos"), m.alias("mnemonic")))


@query("pair_aliases", """WITH c AS (SELECT p_brand AS well, p_partkey AS pos, ['gr', 'SGR', 'DEN', 'RHOB', 'Dtco', 'cali', 'HCAL', 'TNPH', 'PHI', 'RT', 'ILD', 'TMP', 'X', 'NGR'][1 + (p_size * 31 + p_partkey // 50) % 14] AS mnemonic FROM part WHERE p_partkey % 7 < 2),
a AS (SELECT target, unnest(names) AS alias, unnest(range(len(names))) AS place FROM (VALUES ('GR', ['GR', 'CGR', 'SGR', 'GAMMA', 'GAM', 'NGR']), ('CAL', ['CAL', 'CALI', 'CALIPER', 'HCAL']),
  ('BD', ['BD', 'RHOB', 'DEN', 'DENS', 'ZDEN']), ('DPHI', ['DPHI', 'NPHI', 'TNPH', 'NPHI_LS', 'PHI']), ('RILD', ['RILD', 'ILD', 'LLD', 'RT', 'RES', 'COND']), ('TEMP', ['TEMP', 'TMP', 'TEMPERATURE']), ('DTCO', ['DTCO'])) v(target, names)),
j AS (SELECT well, target, mnemonic, row_number() OVER (PARTITION BY well, target ORDER BY place, pos DESC) AS n FROM c JOIN a ON upper(mnemonic) = alias)
SELECT well, target, mnemonic FROM j WHERE n = 1""")
def pair_aliases(spark, sf):
    p = t(spark, sf, "part").where("p_partkey % 7 < 2")  # wells of few curves, so that first aliases are absent
    m = pick((F.col("p_size") * 31 + F.floor(F.col("p_partkey") / 50)) % 14, "gr", "SGR", "DEN", "RHOB", "Dtco", "cali", "HCAL", "TNPH", "PHI", "RT", "ILD", "TMP", "X", "NGR")
    held = p.select(F.col("p_brand").alias("well"), F.col("p_partkey").alias("pos"), m.alias("mnemonic"))
    return curves.aliases(held, ("GR", "CAL", "BD", "DPHI", "RILD", "TEMP", "dtco"))


@query("crv_numeric_tokens", r"""WITH x AS (SELECT event_id, unnest(regexp_extract_all(props || ' x-3.5y .25 7', '(-?\d*\.?\d+)')) AS token, user_id AS x FROM events)
SELECT event_id, string_agg(token, ' ' ORDER BY token) AS tokens, round(sum(token::DOUBLE), 6) AS total, max(x) AS x FROM x GROUP BY 1""")
def crv_numeric_tokens(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.explode(C.token_numbers(F.concat("props", F.lit(" x-3.5y .25 7")), F.col("user_id"), F.lit(0))).alias("n"))
    return e.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("n.text")), " ").alias("tokens"), F.round(F.sum("n.value"), 6).alias("total"), F.max("n.x").alias("x"))


@query("crv_first_json", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events""")
def crv_first_json(spark, sf):
    e = t(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), "props", F.lit(" end"))).otherwise("no {json")
    return e.select("event_id", F.get_json_object(C.first_json(text), "$.k").cast("long").alias("k"))


@query("crv_ocr_text", """SELECT conv_id AS image_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY 1""")
def crv_ocr_text(spark, sf):
    c = t(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return c.select(F.col("conv_id").alias("image_id"), F.array_join(F.transform("a", lambda x: x["text"]), "\n").alias("text"))


_NAME = "CASE curve WHEN 'click' THEN 'GR1' WHEN 'view' THEN 'RHOB' WHEN 'error' THEN 'DTC' WHEN 'purchase' THEN 'CALI' ELSE 'ILD_RES' END"


@query("crv_payload", f"""WITH s0 AS (SELECT user_id AS well, event_type AS curve, row_number() OVER w - 1 AS idx, 100 + (row_number() OVER w - 1) * 0.3::DOUBLE AS depth,
  CASE WHEN event_id % 11 = 0 THEN -999.25::DOUBLE ELSE value END AS value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
samples AS (SELECT well, {_NAME} AS curve, idx, depth, value FROM s0), {_FEATURES},
i AS (SELECT well, count(*) AS n, min(curve) AS first_curve FROM samples GROUP BY 1), c AS (SELECT well, max(CASE WHEN curve = 'GR1' THEN 'GR1' END) AS gr, max(CASE WHEN curve = 'ILD_RES' THEN 'ILD_RES' END) AS res FROM samples GROUP BY 1)
SELECT i.well, CASE WHEN i.well % 2 = 0 THEN 'GR,RES' ELSE 'RES' END AS labels, CASE WHEN i.well % 2 = 0 THEN gr END AS gr, res, i.n AS num_samples, fl.num_valid AS first_valid, fl.flags,
  CASE first_curve WHEN 'CALI' THEN 'CALI' WHEN 'DTC' THEN 'DT' WHEN 'GR1' THEN 'GR' WHEN 'ILD_RES' THEN 'RES' ELSE 'RHOB' END AS first_type, 'DT' AS user_type
FROM i JOIN c USING (well) JOIN fl ON fl.well = i.well AND fl.curve = first_curve""")
def crv_payload(spark, sf):
    s = samples(spark, sf)
    name = F.when(F.col("curve") == "click", "GR1").when(F.col("curve") == "view", "RHOB").when(F.col("curve") == "error", "DTC").when(F.col("curve") == "purchase", "CALI").otherwise("ILD_RES")
    s = s.withColumn("curve", name)
    f = curves.features(s).withColumn("pos", F.rank().over(curves.Window.partitionBy("well").orderBy("curve"))).withColumn("unit", F.lit("")).withColumn("description", F.lit(""))
    wells = s.select("well").distinct()
    texts = wells.select("well", F.when(F.col("well") % 2 == 0, "Gamma Ray and\nlwd res").otherwise("ILD only").alias("text"))
    user = F.struct(*(F.lit(v).alias(k) for k, v in (("type", "DT"), ("las_mnemonic", "dtc"), ("name", "Sonic"), ("las_unit", ""), ("unit", "us/f"), ("display_name", ""), ("display_unit", ""))))
    p = curves.payload(f, curves.well_info(s), texts, wells.select("well", F.array(user).alias("curves")))
    of = lambda path: F.get_json_object("payload", f"$.{path}")
    labels = F.array_join(F.from_json(of("vision_curve_labels"), "array<string>"), ",")
    first = "las_summary.curve_features[0]"
    flags = F.array_join(F.from_json(of(f"{first}.flags"), "array<string>"), ",")
    return p.select("well", labels.alias("labels"), of("vision_to_las_mapping.GR").alias("gr"), of("vision_to_las_mapping.RES").alias("res"), of("las_summary.well_info.num_samples").cast("long").alias("num_samples"),
                    of(f"{first}.num_valid").cast("long").alias("first_valid"), flags.alias("flags"), of(f"{first}.rule_type_guess").alias("first_type"), of("user_curve_type_by_mnemonic.DTC").alias("user_type"))
