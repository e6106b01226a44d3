"""Items against their curve: residuals, flags, corruption tests."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import r6
from tallyframe.functions.ordered import Grouped
from tallyframe.operators import curves as C
from tallyframe.plans.base import (
    SQL_CENTERS,
    SQL_PRESETS,
    SQL_VARIANTS,
    centers,
    rounded,
    sql_cubic_residuals,
    sql_residuals,
    sql_tested,
)
from tallyframe.plans.registry import REGISTRY, query
from tallyframe.session import cut
from tallyframe.sources.tables import table

KEY = ["cluster"]
SQL_RESID = SQL_CENTERS + "," + sql_residuals("centers", "cluster")
SQL_TESTED = SQL_RESID + "," + SQL_PRESETS + "," + sql_tested("cluster")
SQL_VTESTED = SQL_VARIANTS + "," + sql_residuals("variants", "variant, cluster") + "," + SQL_PRESETS + "," + sql_tested("variant, cluster")


def residuals(spark, sf, degree=1):
    return C.curve_residuals(centers(spark, sf), KEY, degree)


def tested(spark, sf, degree=1):
    return C.score_items(residuals(spark, sf, degree), KEY, whole=True)


def tested_variants(spark, sf, degree=1, offset=10.0):
    """Every corruption fitted once; the marks of changed items ride along."""
    rows = C.inject(centers(spark, sf), KEY, offset)
    keys = ["variant", *KEY]
    resid = C.by_cluster(C.curve_residuals(rows, keys, degree, ("perturbed", "site")), KEY, table(spark, sf, "lineitem").count())
    return C.score_items(resid, keys, whole=True)


RESIDUAL_COLUMNS = "cluster, ord::BIGINT AS ord, region, scope, n_fit::BIGINT AS n_fit, round(residual, 5) AS residual"


def shown(df, *more):
    return df.select(
        "cluster", F.col("ord").cast("bigint").alias("ord"), "region", "scope", F.col("n_fit").cast("bigint").alias("n_fit"), *more
    )


@query("curve_residual_linear", "WITH" + SQL_RESID + f" SELECT {RESIDUAL_COLUMNS}, round(deployed_residual, 5) AS deployed_residual FROM resid")
def curve_residual_linear(spark, sf):
    return shown(residuals(spark, sf), F.round("residual", 5).alias("residual"), F.round("deployed_residual", 5).alias("deployed_residual"))


@query("loo_residual_linear", "WITH" + SQL_RESID + " SELECT cluster, ord::BIGINT AS ord, round(loo_residual, 5) AS loo_residual FROM resid")
def loo_residual_linear(spark, sf):
    return residuals(spark, sf).select("cluster", F.col("ord").cast("bigint").alias("ord"), F.round("loo_residual", 5).alias("loo_residual"))


SQL_CUBIC = SQL_CENTERS + "," + sql_cubic_residuals("centers", "cluster")
SQL_CUBIC_TESTED = SQL_CUBIC + "," + SQL_PRESETS + "," + sql_tested("cluster")


@query(
    "curve_residual_cubic",
    "WITH" + SQL_CUBIC + f" SELECT {RESIDUAL_COLUMNS}, round(loo_residual, 5) AS loo_residual, round(deployed_residual, 5) AS deployed_residual FROM resid",
)
def curve_residual_cubic(spark, sf):
    """Cubic fits, in sample and leave-one-out."""
    return shown(residuals(spark, sf, 3), *[F.round(c, 5).alias(c) for c in ("residual", "loo_residual", "deployed_residual")])


FLAG_COUNTS_SQL = " SELECT rule, count(*)::BIGINT AS n, count(tested)::BIGINT AS n_tested, (count(*) FILTER (WHERE flagged))::BIGINT AS n_flagged, round(avg(tested), 4) AS mean_z FROM tested GROUP BY rule"


@query("flag_rules_cubic", "WITH" + SQL_CUBIC_TESTED + FLAG_COUNTS_SQL)
def flag_rules_cubic(spark, sf):
    return C.score_items(residuals(spark, sf, 3), KEY, whole=True).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.count("tested").alias("n_tested"), F.count_if(C.flag()).alias("n_flagged"), F.round(F.avg("tested"), 4).alias("mean_z")
    )


@query(
    "size_contrast_cubic",
    "WITH" + SQL_CUBIC + " SELECT scope, region_size = 4 AS of_four, count(residual)::BIGINT AS n, round(avg(residual), 4) AS mean_residual, round(avg(loo_residual), 4) AS mean_loo FROM resid WHERE residual IS NOT NULL GROUP BY ALL",
)
def size_contrast_cubic(spark, sf):
    """A cubic goes through four points: regions of four against the rest, in sample and without the item."""
    rows = residuals(spark, sf, 3).filter("residual IS NOT NULL")
    return rows.groupBy("scope", (F.col("region_size") == 4).alias("of_four")).agg(
        F.count("residual").alias("n"), F.round(F.avg("residual"), 4).alias("mean_residual"), F.round(F.avg("loo_residual"), 4).alias("mean_loo")
    )


@query(
    "fit_rms_cubic",
    "WITH"
    + SQL_CUBIC
    + """, g AS (SELECT cluster, region, any_value(region_size) AS region_size, avg(rms_x) AS rms_x, avg(rms_y) AS rms_y FROM resid WHERE scope = 'region' AND rms_x IS NOT NULL GROUP BY ALL)
SELECT region_size::BIGINT AS region_size, count(*)::BIGINT AS n_fits, round(avg(rms_x), 4) AS mean_x, round(avg(rms_y), 4) AS mean_y FROM g GROUP BY 1""",
)
def fit_rms_cubic(spark, sf):
    rows = residuals(spark, sf, 3).filter("scope = 'region' AND rms_x IS NOT NULL AND idx = 0")
    return rows.groupBy(F.col("region_size").cast("bigint").alias("region_size")).agg(
        F.count(F.lit(1)).alias("n_fits"), *[F.round(F.avg(f"rms_{a}"), 4).alias(f"mean_{a}") for a in "xy"]
    )


@query(
    "flag_rules",
    "WITH" + SQL_TESTED + " SELECT rule, count(*)::BIGINT AS n, count(tested)::BIGINT AS n_tested, (count(*) FILTER (WHERE flagged))::BIGINT AS n_flagged, round(avg(tested), 4) AS mean_z FROM tested GROUP BY rule",
)
def flag_rules(spark, sf):
    return tested(spark, sf).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.count("tested").alias("n_tested"), F.count_if(C.flag()).alias("n_flagged"), F.round(F.avg("tested"), 4).alias("mean_z")
    )


ROBUST = [("robust", "z_robust", 1.5, 0.1, 0.0), ("robust_guarded", "z_robust", 1.5, 1.0, 3.0)]


@query(
    "flag_rules_robust",
    "WITH"
    + SQL_RESID
    + """, med AS (SELECT cluster, median(residual) AS med FROM resid GROUP BY 1),
mad AS (SELECT cluster, any_value(med) AS med, median(abs(residual - med)) AS mad FROM resid JOIN med USING (cluster) GROUP BY 1),
rz AS (SELECT rule, residual, least_mm, round((residual - med) / greatest(1.4826 * mad, floor_), 9) AS z
  FROM resid JOIN mad USING (cluster), (VALUES ('robust', 0.1::DOUBLE, 0.0::DOUBLE), ('robust_guarded', 1.0::DOUBLE, 3.0::DOUBLE)) AS p(rule, floor_, least_mm))
SELECT rule, count(*)::BIGINT AS n, count(z)::BIGINT AS n_tested, (count(*) FILTER (WHERE z > 1.5 AND residual >= least_mm))::BIGINT AS n_flagged, round(avg(z), 4) AS mean_z FROM rz GROUP BY rule""",
)
def flag_rules_robust(spark, sf):
    """The decision rules on robust z."""
    scored = C.score_items(residuals(spark, sf), KEY, presets=ROBUST, whole=True)
    return scored.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.count("tested").alias("n_tested"), F.count_if(C.flag()).alias("n_flagged"), F.round(F.avg("tested"), 4).alias("mean_z")
    )


@query(
    "fp_profile",
    "WITH"
    + SQL_TESTED
    + """ SELECT rule, endpoint, least(idx, region_size - 1 - idx)::BIGINT AS depth, region_size::BIGINT AS region_size, scope, count(*)::BIGINT AS n, (count(*) FILTER (WHERE flagged))::BIGINT AS fp,
  round((count(*) FILTER (WHERE flagged)) / count(*), 6) AS fp_rate, (count(*) FILTER (WHERE tested > threshold))::BIGINT AS z_passed, (count(*) FILTER (WHERE tested > threshold AND NOT flagged))::BIGINT AS blocked,
  (count(DISTINCT cluster) FILTER (WHERE flagged))::BIGINT AS clusters_hit FROM tested WHERE tested IS NOT NULL AND tested_mm IS NOT NULL
GROUP BY GROUPING SETS ((rule), (rule, endpoint), (rule, 3), (rule, region_size), (rule, scope))""",
)
def fp_profile(spark, sf, degree=1):
    out = C.false_positives(tested(spark, sf, degree), KEY)
    out = out.withColumn("depth", F.col("depth").cast("bigint")).withColumn("region_size", F.col("region_size").cast("bigint"))
    return rounded(out, "fp_rate")


@query(
    "fp_residuals",
    "WITH"
    + SQL_TESTED
    + """ SELECT rule, round(median(residual), 4) AS residual_median, round(quantile_cont(residual, 0.95), 4) AS residual_p95, round(median(loo_residual), 4) AS loo_median, round(quantile_cont(loo_residual, 0.95), 4) AS loo_p95
FROM tested WHERE tested IS NOT NULL AND tested_mm IS NOT NULL GROUP BY rule""",
)
def fp_residuals(spark, sf, degree=1):
    rows = cut(tested(spark, sf, degree).filter("tested IS NOT NULL AND tested_mm IS NOT NULL").select("rule", "residual", "loo_residual"))
    group = Grouped(rows, ["rule"])
    inside = group.quantiles("residual", {"residual_median": 0.5, "residual_p95": 0.95})
    left = group.quantiles("loo_residual", {"loo_median": 0.5, "loo_p95": 0.95})
    out = inside.join(left, "rule")
    return out.select("rule", *[F.round(c, 4).alias(c) for c in out.columns if c != "rule"])


@query(
    "paired_injection",
    "WITH"
    + SQL_VTESTED
    + """, was AS (SELECT cluster, ord, rule, flagged AS was FROM tested WHERE variant = 'clean'),
per AS (SELECT variant, rule, cluster, bool_or(flagged AND site) AS s, bool_or(coalesce(was, false) AND site) AS s0, bool_or(flagged AND perturbed) AS a, bool_or(coalesce(was, false) AND perturbed) AS a0,
  count(*) FILTER (WHERE NOT perturbed) AS r, count(*) FILTER (WHERE NOT perturbed AND flagged) AS rh FROM tested LEFT JOIN was USING (cluster, ord, rule) WHERE variant <> 'clean' GROUP BY ALL)
SELECT variant, rule, count(*)::BIGINT AS n, round(avg(s::INT), 6) AS site_rate, round(avg(s0::INT), 6) AS site_rate_clean, round(avg(a::INT), 6) AS any_rate, round(avg(a0::INT), 6) AS any_rate_clean,
  round(sum(rh) / nullif(sum(r), 0), 6) AS fp_on_rest FROM per GROUP BY ALL""",
)
def paired_injection(spark, sf, degree=1):
    out = C.paired_injection(tested_variants(spark, sf, degree), KEY)
    return rounded(out, "site_rate", "site_rate_clean", "any_rate", "any_rate_clean", "fp_on_rest")


# The grid of thresholds.
THRESHOLDS = [1.0 + 0.25 * i for i in range(13)]


@query(
    "threshold_sweep",
    "WITH"
    + SQL_VTESTED
    + """, st AS (SELECT *, coalesce(tested > z_cut AND tested_mm >= least_mm, false) AS f FROM tested, (SELECT 1 + 0.25 * range AS z_cut FROM range(13))),
per AS (SELECT variant, rule, z_cut, cluster, count(*) FILTER (WHERE tested IS NOT NULL AND tested_mm IS NOT NULL) AS items, count(*) FILTER (WHERE f) AS flags, bool_or(f) AS hit, bool_or(f AND perturbed) AS found FROM st GROUP BY ALL)
SELECT variant, rule, z_cut::DOUBLE AS z_cut, count(*)::BIGINT AS n, round(sum(flags) / nullif(sum(items), 0), 6) AS item_rate, round(avg(hit::INT), 6) AS cluster_rate, round(avg(found::INT), 6) AS detection FROM per GROUP BY ALL""",
)
def threshold_sweep(spark, sf, degree=1):
    out = C.threshold_sweep(tested_variants(spark, sf, degree), KEY, THRESHOLDS)
    return rounded(out, "item_rate", "cluster_rate", "detection")


# The grid of offsets.
OFFSETS = [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0]


@query(
    "masking_curve",
    "WITH"
    + SQL_CENTERS
    + """, spot AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY cluster) AS n FROM centers),
moved AS (SELECT off AS variant, cluster, ord, region, x + CASE WHEN pos = n // 2 THEN off ELSE 0 END AS x, y, pos - n // 2 AS away FROM spot, (SELECT unnest([0, 0.5, 1, 2, 5, 10, 20, 40, 80])::DOUBLE AS off)),"""
    + sql_residuals("moved", "variant, cluster")
    + ","
    + SQL_PRESETS
    + ","
    + sql_tested("variant, cluster")
    + """ SELECT variant AS offset_mm, (count(*) FILTER (WHERE away = 0 AND rule = 'deployed'))::BIGINT AS n, round(median(residual) FILTER (WHERE away = 0 AND rule = 'deployed'), 4) AS site_median,
  round(median(loo_residual) FILTER (WHERE away = 0 AND rule = 'deployed'), 4) AS site_loo_median, round(median(residual) FILTER (WHERE abs(away) = 1 AND rule = 'deployed'), 4) AS neighbour_median,
  round(avg(flagged::INT) FILTER (WHERE away = 0 AND rule = 'deployed'), 6) AS detect_deployed, round(avg(flagged::INT) FILTER (WHERE away = 0 AND rule = 'guarded'), 6) AS detect_guarded,
  round(avg(flagged::INT) FILTER (WHERE away = 0 AND rule = 'loo'), 6) AS detect_loo, round(avg(flagged::INT) FILTER (WHERE away = 0 AND rule = 'loo_raw'), 6) AS detect_loo_raw FROM tested GROUP BY 1""",
)
def masking_curve(spark, sf, degree=1):
    along, whole = Window.partitionBy(*KEY).orderBy("ord"), Window.partitionBy(*KEY)
    away = (F.row_number().over(along) - 1 - F.floor(F.count(F.lit(1)).over(whole) / 2)).alias("away")
    rows = centers(spark, sf).select("*", away)
    moved = rows.withColumn("offset_mm", F.explode(F.array(*[F.lit(o) for o in OFFSETS])))
    moved = moved.withColumn("x", F.col("x") + F.when(F.col("away") == 0, F.col("offset_mm")).otherwise(0.0))
    keys = ["offset_mm", *KEY]
    scored = C.score_items(C.curve_residuals(moved, keys, degree, ("away",)), keys, whole=True).withColumn("flagged", C.flag().cast("double"))
    # only the moved item and its two neighbours are reported
    scored = cut(scored.filter(F.abs("away") <= 1).select("offset_mm", "away", "rule", "residual", "loo_residual", "flagged"))
    site, one = F.col("away") == 0, F.col("rule") == "deployed"
    near = F.abs("away") == 1
    facts = scored.filter(one).select(
        "offset_mm", F.when(site, F.col("residual")).alias("s"), F.when(site, F.col("loo_residual")).alias("l"), F.when(near, F.col("residual")).alias("v")
    )
    group = Grouped(facts, ["offset_mm"])
    mids = [group.quantiles(c, {name: 0.5}) for c, name in (("s", "site_median"), ("l", "site_loo_median"), ("v", "neighbour_median"))]
    rates = scored.filter(site).groupBy("offset_mm").agg(
        F.count_if(one).cast("bigint").alias("n"),
        *[r6(F.avg(F.when(F.col("rule") == k, F.col("flagged")))).alias(f"detect_{k}") for k, *_ in C.PRESETS],
    )
    for m in mids:
        name = m.columns[-1]
        rates = rates.join(m.withColumn(name, F.round(name, 4)), "offset_mm")
    return rates


@query(
    "fit_rms",
    "WITH"
    + SQL_RESID
    + """, g AS (SELECT DISTINCT cluster, region, region_size, rms_x, rms_y FROM resid WHERE scope = 'region' AND rms_x IS NOT NULL)
SELECT count(*)::BIGINT AS n_fits, round(avg(rms_x), 4) AS mean_x, round(avg(rms_y), 4) AS mean_y, round(max(rms_x), 4) AS max_x, round(max(rms_y), 4) AS max_y, min(region_size)::BIGINT AS least, max(region_size)::BIGINT AS most
FROM (SELECT cluster, region, any_value(region_size) AS region_size, avg(rms_x) AS rms_x, avg(rms_y) AS rms_y FROM g GROUP BY ALL)""",
)
def fit_rms(spark, sf):
    rows = residuals(spark, sf).filter("scope = 'region' AND rms_x IS NOT NULL AND idx = 0")
    return rows.agg(
        F.count(F.lit(1)).alias("n_fits"),
        *[F.round(f(f"rms_{a}"), 4).alias(f"{n}_{a}") for n, f in (("mean", F.avg), ("max", F.max)) for a in "xy"],
        F.min("region_size").cast("bigint").alias("least"),
        F.max("region_size").cast("bigint").alias("most"),
    )


@query(
    "size_contrast",
    "WITH"
    + SQL_RESID
    + " SELECT scope, region_size = 4 AS of_four, count(residual)::BIGINT AS n, round(avg(residual), 4) AS mean_residual FROM resid WHERE residual IS NOT NULL GROUP BY ALL",
)
def size_contrast(spark, sf):
    rows = residuals(spark, sf).filter("residual IS NOT NULL")
    return rows.groupBy("scope", (F.col("region_size") == 4).alias("of_four")).agg(
        F.count("residual").alias("n"), F.round(F.avg("residual"), 4).alias("mean_residual")
    )


# The same detectors on cubics: the fits differ, everything after them is the same.
for _make, _source, _keys in (
    (fp_profile, "centers", "cluster"),
    (fp_residuals, "centers", "cluster"),
    (paired_injection, "variants", "variant, cluster"),
    (threshold_sweep, "variants", "variant, cluster"),
    (masking_curve, "moved", "variant, cluster"),
):
    _sql = REGISTRY[_make.__name__][1].replace(sql_residuals(_source, _keys), sql_cubic_residuals(_source, _keys))
    query(f"{_make.__name__}_cubic", _sql)(partial(_make, degree=3))
