"""Detector evaluation, resampling and ceilings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, penalty, r6
from tallyframe.functions.draws import sql_drawn
from tallyframe.functions.ordered import Grouped, small
from tallyframe.operators import ceilings as C
from tallyframe.operators import detection as D
from tallyframe.operators import resampling as B
from tallyframe.operators import rules as R
from tallyframe.operators.curves import pooled_z
from tallyframe.operators.matching import identification_hits
from tallyframe.operators.reductions import dice
from tallyframe.operators.replicates import Halves, Labels, LabelsInHalves, replicate_auc
from tallyframe.plans.base import (
    DOC_RULES,
    SCENARIOS_SQL,
    SQL_DOC,
    SQL_ITEM,
    SQL_REFERENCE,
    SQL_RULES,
    analysis_items,
    doc_features,
    doc_scored,
    item_scored,
    items,
    long_rules,
    reference_scores,
    rounded,
    sql_auc,
    sql_hanley,
)
from tallyframe.plans.registry import query
from tallyframe.session import cut
from tallyframe.sources.tables import table

REPS, SEED, SPLITS = 2000, 7, 20

AUC_COLUMNS = "n_wrong, n_right, round(auc, 6) AS auc"


@query(
    "auc_rank",
    "WITH"
    + SQL_DOC
    + ", one AS (SELECT 1 AS one, wrong, score FROM scored WHERE rule = 'chars'),"
    + sql_auc("one", "one", "a")
    + ","
    + sql_hanley("h", "a")
    + f" SELECT {AUC_COLUMNS}, round(lo, 6) AS lo, round(hi, 6) AS hi FROM h",
)
def auc_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("wrong"), F.lit(1).alias("one"))
    out = D.hanley_mcneil(D.auc(docs.join(labels, "doc_id"), ["one"]))
    return rounded(out.drop("one"), "auc", "lo", "hi")


@query(
    "auc_hanley_mcneil",
    "WITH" + SQL_DOC + "," + sql_auc("scored", "rule", "a") + "," + sql_hanley("h", "a") + f" SELECT rule, {AUC_COLUMNS}, round(lo, 6) AS lo, round(hi, 6) AS hi FROM h",
)
def auc_hanley_mcneil(spark, sf):
    return rounded(D.hanley_mcneil(D.auc(doc_scored(spark, sf), ["rule"])), "auc", "lo", "hi")


@query(
    "auc_verdict",
    "WITH"
    + SQL_RULES
    + ", own AS (SELECT * FROM long_rule WHERE matched),"
    + sql_auc("own", "rule", "a")
    + f""" SELECT rule, {AUC_COLUMNS}, CASE WHEN auc < 0.55 AND auc > 0.45 THEN 'no signal' WHEN auc <= 0.45 THEN 'inverted'
  WHEN auc >= 0.7 THEN 'usable' WHEN auc IS NOT NULL THEN 'weak' END AS verdict FROM a""",
)
def auc_verdict(spark, sf):
    out = D.auc(item_scored(spark, sf).filter("matched"), ["rule"])
    return rounded(out.withColumn("verdict", D.verdict(F.col("auc"))), "auc")


def sql_weighted(source: str, keys: str, name: str, weights: str = "weights") -> str:
    """CTE of AUC per (keys, rep) from weighted rows."""
    return f"""
{name}_c AS (SELECT {keys}, rep, score, sum(w) FILTER (WHERE wrong)::DOUBLE AS p, sum(w) FILTER (WHERE NOT wrong)::DOUBLE AS q
  FROM {source} JOIN {weights} USING (cluster) WHERE score IS NOT NULL AND wrong IS NOT NULL GROUP BY {keys}, rep, score),
{name}_z AS (SELECT {keys}, rep, score, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM {name}_c),
{name}_w AS (SELECT *, sum(q) OVER (PARTITION BY {keys}, rep ORDER BY score DESC) AS above FROM {name}_z),
{name} AS (SELECT {keys}, rep, sum(p * (above - 0.5 * q)) / nullif(sum(p) * sum(q), 0) AS auc FROM {name}_w GROUP BY {keys}, rep)"""


def draws_sql(source: str, reps: int = REPS, seed: int = SEED) -> str:
    """CTEs: clusters drawn with replacement, ``weights`` (rep, cluster, w)."""
    return f"""
ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM {source})),
places AS (SELECT any_value(n) AS n, unnest(range(any_value(n))) AS j FROM ids),{sql_drawn("numbers", "places", "j", seed, reps, "n")},
weights AS (SELECT rep, cluster, count(*) AS w FROM (SELECT rep, draw % n AS idx FROM numbers) JOIN ids USING (idx) GROUP BY ALL)"""


def halves_sql(splits: int, seed: int = 3) -> str:
    """CTEs: random halves of the clusters, ``weights`` (cluster, rep, w) with rep 2r and 2r + 1 for split r."""
    return f"""
ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM feat)),{sql_drawn("sides", "ids", "idx", seed, splits, "cluster, n")},
placed AS (SELECT cluster, n, rep AS r, row_number() OVER (PARTITION BY rep ORDER BY draw) - 1 AS k FROM sides),
weights AS (SELECT cluster, r * 2 + CASE WHEN k < n // 2 THEN 0 ELSE 1 END AS rep, 1 AS w FROM placed)"""


def interval_sql(source: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, n_wrong, n_right, auc, lo, hi, reps) of scored rows with a cluster."""
    known = f"(SELECT * FROM {source} WHERE score IS NOT NULL AND wrong IS NOT NULL)"
    same = " AND ".join(f"{name}_a.{k.strip()} IS NOT DISTINCT FROM {name}_i.{k.strip()}" for k in keys.split(","))
    return (
        draws_sql(known)
        + ","
        + sql_weighted(source, keys, f"{name}_b")
        + ","
        + sql_auc(source, keys, f"{name}_a")
        + f""",
{name}_i AS (SELECT {keys}, CASE WHEN count(auc) >= 50 THEN quantile_cont(auc, 0.025) END AS lo, CASE WHEN count(auc) >= 50 THEN quantile_cont(auc, 0.975) END AS hi,
  count(auc)::BIGINT AS reps FROM {name}_b WHERE auc IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {name}_a.*, lo, hi, coalesce(reps, 0) AS reps FROM {name}_a LEFT JOIN {name}_i ON {same})"""
    )


INTERVAL_COLUMNS = f"{AUC_COLUMNS}, round(lo, 6) AS lo, round(hi, 6) AS hi, reps"


@query(
    "auc_cluster_bootstrap",
    "WITH"
    + SQL_DOC
    + ","
    + draws_sql("feat")
    + ","
    + sql_weighted("scored", "rule", "b")
    + """ SELECT rule, CASE WHEN count(auc) >= 50 THEN round(quantile_cont(auc, 0.025), 6) END AS lo, CASE WHEN count(auc) >= 50 THEN round(quantile_cont(auc, 0.975), 6) END AS hi, count(auc)::BIGINT AS reps FROM b WHERE auc IS NOT NULL GROUP BY rule""",
)
def auc_cluster_bootstrap(spark, sf):
    feats = cut(doc_features(spark, sf))
    draws = B.bootstrap_auc(long_rules(feats, DOC_RULES), "cluster", ["rule"], REPS, SEED, population=feats)
    return rounded(B.percentile_interval(draws, ["rule"], "auc"), "lo", "hi")


@query(
    "auc_paired_delta",
    "WITH"
    + SQL_DOC
    + ","
    + draws_sql("feat")
    + ","
    + sql_weighted("scored", "rule", "b")
    + """, d AS (SELECT x.auc - y.auc AS delta FROM b x JOIN b y USING (rep) WHERE x.rule = 'words' AND y.rule = 'density' AND x.auc IS NOT NULL AND y.auc IS NOT NULL)
SELECT round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, round(avg((delta <= 0)::INT), 6) AS p_le_zero, count(*)::BIGINT AS reps FROM d""",
)
def auc_paired_delta(spark, sf):
    feats = cut(doc_features(spark, sf))
    draws = B.bootstrap_auc(long_rules(feats, DOC_RULES), "cluster", ["rule"], REPS, SEED, population=feats)
    return rounded(B.paired_delta(draws, "rule", "words", "density"), "lo", "hi", "p_le_zero")


SQL_SCEN = SQL_RULES + "," + SCENARIOS_SQL.format(src="long_rule") + "," + interval_sql("scenario_scored", "scenario, rule", "a")


@query("auc_scenarios", "WITH" + SQL_SCEN + f" SELECT scenario, rule, {INTERVAL_COLUMNS} FROM a")
def auc_scenarios(spark, sf):
    rows = D.scenarios(item_scored(spark, sf), F.col("matched"), F.col("present"))
    return rounded(B.auc_interval(rows, "cluster", ["scenario", "rule"], REPS, SEED), "auc", "lo", "hi")


@query(
    "excluded_profile",
    "WITH"
    + SQL_RULES
    + """
SELECT (count(*) FILTER (WHERE NOT matched))::BIGINT AS unmatched, (count(*) FILTER (WHERE NOT matched AND NOT present))::BIGINT AS absent,
  (count(*) FILTER (WHERE NOT matched AND present))::BIGINT AS beyond, round(median(parity_region_deployed) FILTER (WHERE NOT matched AND NOT present), 6) AS median_absent,
  round(median(parity_region_deployed) FILTER (WHERE matched AND NOT wrong), 6) AS median_correct, round(median(parity_region_deployed) FILTER (WHERE matched AND wrong), 6) AS median_wrong,
  (count(*) FILTER (WHERE NOT matched AND NOT present AND parity_region_deployed >= 0.3))::BIGINT AS absent_high,
  (count(*) FILTER (WHERE NOT matched AND NOT present AND z < -0.1))::BIGINT AS absent_flagged FROM wide""",
)
def excluded_profile(spark, sf):
    shipped = {"parity_region_deployed": R.rule_columns()["parity_region_deployed"]}
    rows = R.score_rules(analysis_items(spark, sf), shipped)
    rows = cut(rows.select("matched", "present", "wrong", "score", "z"))
    out = ~F.col("matched")
    gone = out & ~F.col("present")
    kind = F.when(gone, "absent").when(F.col("matched") & ~F.col("wrong"), "correct").when(F.col("matched"), "wrong")
    mids = Grouped(rows.withColumn("kind", kind).filter("kind IS NOT NULL"), ["kind"]).quantiles("score", {"m": 0.5})
    mids = mids.agg(*[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(f"median_{k}") for k in ("absent", "correct", "wrong")])
    counts = rows.agg(
        count_if(out).alias("unmatched"),
        count_if(gone).alias("absent"),
        count_if(out & F.col("present")).alias("beyond"),
        count_if(gone & (F.col("score") >= 0.3)).alias("absent_high"),
        count_if(gone & (F.col("z") < -0.1)).alias("absent_flagged"),
    )
    names = ("median_absent", "median_correct", "median_wrong")
    return counts.select("*", *[r6(mids.select(n).scalar()).alias(n) for n in names])


@query(
    "reference_scores",
    "WITH"
    + SQL_REFERENCE
    + ","
    + SCENARIOS_SQL.format(src="reference_long")
    + ", kept AS (SELECT * FROM scenario_scored WHERE scenario IN ('as_published', 'worst_case')),"
    + interval_sql("kept", "scenario, rule", "a")
    + f" SELECT scenario, rule, {INTERVAL_COLUMNS} FROM a",
)
def reference_score_aucs(spark, sf):
    wide = reference_scores(spark, sf)
    rows = D.scenarios(long_rules(wide, ["entropy_inv", "size_regularity", "spacing_regularity"]), F.col("matched"), F.col("present"))
    kept = rows.filter("scenario IN ('as_published', 'worst_case')")
    return rounded(B.auc_interval(kept, "cluster", ["scenario", "rule"], REPS, SEED), "auc", "lo", "hi")


@query(
    "reference_score_values",
    "WITH" + SQL_REFERENCE + " SELECT vec_id, round(entropy_inv, 6) AS entropy_inv, round(size_regularity, 6) AS size_regularity, round(spacing_regularity, 6) AS spacing_regularity FROM reference_wide",
)
def reference_score_values(spark, sf):
    names = ("entropy_inv", "size_regularity", "spacing_regularity")
    return rounded(reference_scores(spark, sf).select("vec_id", *names), *names)


@query(
    "common_subset_auc",
    "WITH"
    + SQL_RULES
    + ", own AS (SELECT * FROM long_rule WHERE matched), full_ AS (SELECT vec_id FROM own GROUP BY 1 HAVING count(score) = 9), kept AS (SELECT * FROM own WHERE vec_id IN (SELECT vec_id FROM full_)),"
    + sql_auc("kept", "rule", "a")
    + ","
    + sql_hanley("h", "a")
    + f" SELECT rule, {AUC_COLUMNS}, round(lo, 6) AS lo, round(hi, 6) AS hi FROM h",
)
def common_subset_auc(spark, sf):
    rows = cut(item_scored(spark, sf).filter("matched"))
    kept = D.common_subset(rows, ["vec_id"], len(R.RULES))
    return rounded(D.hanley_mcneil(D.auc(kept, ["rule"])), "auc", "lo", "hi")


def flagged_docs(spark, sf):
    """Documents flagged for being short; unchecked where no digits score exists."""
    rows = doc_features(spark, sf)
    return rows.select("doc_id", "cluster", "category", "wrong", "toxic", (F.col("chars") < 400).alias("flag"), F.col("digits").isNotNull().alias("checked"), (F.col("density") > 6).alias("other_flag"))


SQL_FLAGGED = SQL_DOC + ", fl AS (SELECT *, chars < 400 AS flag, digits IS NOT NULL AS checked, density > 6 AS other_flag FROM feat)"


@query(
    "flag_metrics",
    "WITH"
    + SQL_FLAGGED
    + """, c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE flag) AS f, count(*) FILTER (WHERE wrong) AS w, count(*) FILTER (WHERE flag AND wrong) AS h,
  count(*) FILTER (WHERE NOT flag AND NOT wrong) AS r, count(*) FILTER (WHERE NOT checked) AS u FROM fl GROUP BY 1)
SELECT category, n::BIGINT AS n, f::BIGINT AS n_flag, w::BIGINT AS n_wrong, h::BIGINT AS n_hit, r::BIGINT AS n_rest, u::BIGINT AS not_checked, round(f / n, 6) AS firing_rate,
  round(h / nullif(w, 0), 6) AS sensitivity, round(r / nullif(n - w, 0), 6) AS specificity, round(h / nullif(f, 0), 6) AS ppv, round(r / nullif(n - f, 0), 6) AS npv, round(w / n, 6) AS prevalence FROM c""",
)
def flag_metrics(spark, sf):
    out = D.flag_metrics(flagged_docs(spark, sf), ["category"], F.col("flag"), F.col("wrong"), F.col("checked"))
    return rounded(out, "firing_rate", "sensitivity", "specificity", "ppv", "npv", "prevalence")


@query(
    "flag_metric_intervals",
    "WITH"
    + SQL_FLAGGED
    + ","
    + draws_sql("fl")
    + """, m AS (SELECT category, cluster, 'firing_rate' AS metric, flag AS num, true AS den FROM fl UNION ALL SELECT category, cluster, 'sensitivity', flag, wrong FROM fl
  UNION ALL SELECT category, cluster, 'specificity', NOT flag, NOT wrong FROM fl UNION ALL SELECT category, cluster, 'ppv', wrong, flag FROM fl UNION ALL SELECT category, cluster, 'npv', NOT wrong, NOT flag FROM fl),
per AS (SELECT category, metric, cluster, count(*) FILTER (WHERE num AND den) AS num, count(*) FILTER (WHERE den) AS den FROM m GROUP BY ALL),
v AS (SELECT category, metric, rep, sum(num * w)::DOUBLE / nullif(sum(den * w), 0) AS rate FROM per JOIN weights USING (cluster) GROUP BY ALL),
i AS (SELECT category, metric, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi, count(rate)::BIGINT AS reps FROM v WHERE rate IS NOT NULL GROUP BY ALL)
SELECT p.category, p.metric, round(sum(num)::DOUBLE / nullif(sum(den), 0), 6) AS value, sum(num)::BIGINT AS num, sum(den)::BIGINT AS den, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, any_value(reps) AS reps
FROM per p LEFT JOIN i ON p.category IS NOT DISTINCT FROM i.category AND p.metric = i.metric GROUP BY p.category, p.metric""",
)
def flag_metric_intervals(spark, sf):
    """Every rate of a flag with its clustered interval."""
    rows = flagged_docs(spark, sf)
    flag, wrong = F.col("flag"), F.col("wrong")
    rates = {"firing_rate": (flag, F.lit(True)), "sensitivity": (flag, wrong), "specificity": (~flag, ~wrong), "ppv": (wrong, flag), "npv": (~wrong, ~flag)}
    each = F.array(*[F.struct(F.lit(m).alias("metric"), a.alias("num"), b.alias("den")) for m, (a, b) in rates.items()])
    long = cut(rows.select("category", "cluster", F.explode(each).alias("m")).select("category", "cluster", "m.*"))
    out = B.bootstrap_rate(long, "cluster", ["category", "metric"], F.col("num"), F.col("den"), REPS, SEED)
    return rounded(out, "value", "lo", "hi")


@query(
    "rate_cluster_bootstrap",
    "WITH"
    + SQL_FLAGGED
    + ","
    + draws_sql("fl")
    + """, per AS (SELECT cluster, count(*) FILTER (WHERE flag AND wrong) AS num, count(*) FILTER (WHERE wrong) AS den FROM fl GROUP BY 1),
v AS (SELECT rep, sum(num * w)::DOUBLE / nullif(sum(den * w), 0) AS rate FROM per JOIN weights USING (cluster) GROUP BY rep)
SELECT round((SELECT sum(num)::DOUBLE / sum(den) FROM per), 6) AS value, (SELECT sum(num) FROM per)::BIGINT AS num, (SELECT sum(den) FROM per)::BIGINT AS den,
  round(quantile_cont(rate, 0.025), 6) AS lo, round(quantile_cont(rate, 0.975), 6) AS hi, count(rate)::BIGINT AS reps FROM v WHERE rate IS NOT NULL""",
)
def rate_cluster_bootstrap(spark, sf):
    out = B.bootstrap_rate(cut(flagged_docs(spark, sf)), "cluster", [], F.col("flag"), F.col("wrong"), REPS, SEED)
    return rounded(out, "value", "lo", "hi")


@query(
    "clusters_flagged",
    "WITH" + SQL_FLAGGED + ", c AS (SELECT cluster, bool_or(flag AND toxic) AS a FROM fl GROUP BY 1) SELECT (count(*) FILTER (WHERE a))::BIGINT AS num, count(*)::BIGINT AS den FROM c",
)
def clusters_flagged(spark, sf):
    return D.clusters_flagged(flagged_docs(spark, sf), "cluster", F.col("flag") & F.col("toxic"))


@query(
    "penalised_auc",
    "WITH"
    + SQL_DOC
    + """, z AS (SELECT *, (chars - avg(chars) OVER w) / greatest(stddev_pop(chars) OVER w, 0.1) AS z, count(*) OVER w AS k FROM feat WINDOW w AS (PARTITION BY cluster)),
s AS (SELECT cluster, wrong, 'displayed' AS rule, density * CASE WHEN k >= 2 AND z > 1.5 THEN greatest(0.3, 1 - (z - 1.5) * 0.4) ELSE 1 END AS score FROM z
  UNION ALL SELECT cluster, wrong, 'minus_z', CASE WHEN k >= 2 THEN -z END FROM z),"""
    + interval_sql("s", "rule", "a")
    + f" SELECT rule, {INTERVAL_COLUMNS} FROM a",
)
def penalised_auc(spark, sf):
    rows = pooled_z(doc_features(spark, sf), ["cluster"], "chars", 0.1, "z", ["doc_id"])
    rows = rows.withColumn("displayed", F.col("density") * penalty(F.col("z"))).withColumn("minus_z", -F.col("z"))
    scored = long_rules(rows.select("cluster", "wrong", "displayed", "minus_z"), ["displayed", "minus_z"])
    return rounded(B.auc_interval(scored, "cluster", ["rule"], REPS, SEED), "auc", "lo", "hi")


def channel_scored(spark, sf):
    """Labelled documents with every score as a channel."""
    return long_rules(doc_features(spark, sf), DOC_RULES, "channel")


@query(
    "best_fixed_channel",
    "WITH"
    + SQL_DOC
    + ","
    + sql_auc("scored", "rule", "a")
    + f" SELECT rule AS channel, {AUC_COLUMNS} FROM a ORDER BY a.auc DESC, rule LIMIT 1",
)
def best_fixed_channel(spark, sf):
    rows = channel_scored(spark, sf).withColumn("rep", F.lit(0))
    return rounded(C.best_fixed_channel(rows, ["rep"]).drop("rep"), "auc")


@query(
    "split_half_selection",
    "WITH"
    + SQL_DOC
    + ","
    + halves_sql(SPLITS)
    + ","
    + sql_weighted("scored", "rule", "b")
    + """, best AS (SELECT * FROM (SELECT rep, rule, row_number() OVER (PARTITION BY rep ORDER BY auc DESC, rule) AS k FROM b WHERE auc IS NOT NULL) WHERE k = 1),
held AS (SELECT best.rep AS fold, best.rule, b.auc FROM best JOIN b ON b.rule = best.rule AND b.rep = xor(best.rep, 1) WHERE b.auc IS NOT NULL)
SELECT rule, count(*)::BIGINT AS times_chosen, round(avg(auc), 6) AS held_mean, (SELECT count(*) FROM held)::BIGINT AS folds, round((SELECT avg(auc) FROM held), 6) AS mean, round((SELECT stddev_samp(auc) FROM held), 6) AS sd
FROM held GROUP BY rule""",
)
def split_half_selection(spark, sf):
    held = cut(B.split_half(doc_scored(spark, sf), "cluster", "rule", SPLITS, 3))
    whole = held.agg(F.count(F.lit(1)).alias("folds"), F.avg("held_auc").alias("mean"), F.stddev_samp("held_auc").alias("sd"))
    return held.groupBy("rule").agg(
        F.count(F.lit(1)).alias("times_chosen"),
        r6(F.avg("held_auc")).alias("held_mean"),
        whole.select("folds").scalar().alias("folds"),
        r6(whole.select("mean").scalar()).alias("mean"),
        r6(whole.select("sd").scalar()).alias("sd"),
    )


def sql_best_mappings(keys: str, name: str) -> str:
    """CTEs: pairs ``u`` between cells of ``cell_rows`` (keys, category, rule, score, wrong), every mapping of four
    categories to channels, and ``name`` (keys, m, auc) for each mapping."""
    return f"""
ch AS (SELECT DISTINCT rule FROM cell_rows), cats AS (SELECT category, row_number() OVER (ORDER BY category) AS i FROM (SELECT DISTINCT category FROM cell_rows)),
maps AS (SELECT row_number() OVER (ORDER BY a.rule, b.rule, c.rule, d.rule) AS m, [a.rule, b.rule, c.rule, d.rule] AS r FROM ch a, ch b, ch c, ch d),
picks AS (SELECT m, category, r[i] AS rule FROM maps, cats),
cell_counts AS (SELECT {keys}, category, rule, score, count(*) FILTER (WHERE wrong) AS p, count(*) FILTER (WHERE NOT wrong) AS n FROM cell_rows WHERE score IS NOT NULL AND wrong IS NOT NULL GROUP BY ALL),
cell_totals AS (SELECT {keys}, category, rule, sum(p) AS p, sum(n) AS n FROM cell_counts GROUP BY ALL),
u AS (SELECT {keys}, e.category AS c1, e.rule AS h1, q.category AS c2, q.rule AS h2, sum(e.p * q.n * CASE WHEN e.score < q.score THEN 1 WHEN e.score = q.score THEN 0.5 ELSE 0 END)::DOUBLE AS w
  FROM (SELECT * FROM cell_counts WHERE p > 0) e JOIN (SELECT * FROM cell_counts WHERE n > 0) q USING ({keys}) GROUP BY ALL),
map_totals AS (SELECT {keys}, m, sum(p)::DOUBLE AS p, sum(n)::DOUBLE AS n FROM cell_totals JOIN picks USING (category, rule) GROUP BY ALL),
map_wins AS (SELECT {keys}, a.m, sum(w) AS w FROM u JOIN picks a ON a.category = c1 AND a.rule = h1 JOIN picks b ON b.m = a.m AND b.category = c2 AND b.rule = h2 GROUP BY ALL),
{name} AS (SELECT {keys}, m, w / (p * n) AS auc FROM map_wins JOIN map_totals USING ({keys}, m) WHERE p * n > 0)"""


@query(
    "best_mapping",
    "WITH"
    + SQL_DOC
    + ", cell_rows AS (SELECT 0 AS one, * FROM scored),"
    + sql_best_mappings("one", "tried")
    + """, top AS (SELECT m, auc FROM tried ORDER BY auc DESC, m LIMIT 1)
SELECT category, rule AS channel, round(auc, 6) AS search_auc, round(auc, 6) AS auc FROM top JOIN picks USING (m)""",
)
def best_mapping(spark, sf):
    """Best score per language; the AUC reported is exact."""
    rows = cut(channel_scored(spark, sf).withColumn("rep", F.lit(0)).select("rep", "category", "channel", "score", "wrong"))
    found = cut(C.best_mapping(rows, ["rep"]))
    exact = C.mapping_auc(rows, found, ["rep"])
    return rounded(found.join(small(exact.select("rep", "auc")), "rep").drop("rep", "start"), "search_auc", "auc")


NULL_REPS, HELD_REPS = 1000, 200


def sql_permuted(group: str, seed: int, reps: int = NULL_REPS) -> str:
    """CTEs: labels permuted within groups, ``perm`` (rep, doc_id, wrong) and ``null_scored``."""
    return f"""
base AS (SELECT doc_id, {group} AS grp, row_number() OVER (ORDER BY doc_id) - 1 AS j, count(*) FILTER (WHERE wrong) OVER (PARTITION BY {group}) AS errors FROM feat),{sql_drawn("numbers", "base", "j", seed, reps, "doc_id, grp, errors")},
perm AS (SELECT rep, doc_id, row_number() OVER (PARTITION BY rep, grp ORDER BY draw) <= errors AS wrong FROM numbers),
null_scored AS (SELECT p.rep, s.rule, s.score, p.wrong FROM perm p JOIN scored s USING (doc_id)),"""


def masked_scores(spark, sf, group, seed, reps=NULL_REPS):
    """The documents, and every channel's scores with the permuted labels as bits."""
    feats = cut(doc_features(spark, sf))
    masks = B.permuted_masks(feats, [group] if group else [], "doc_id", "wrong", reps, seed).select("doc_id", "mask")
    names = [r for r in DOC_RULES if r in feats.columns]
    rows = feats.join(masks, "doc_id").select("doc_id", "cluster", "mask", *names)
    long = long_rules(rows, names, "channel").filter("score IS NOT NULL")
    return feats, cut(long)


def null_draws(rows, reps=NULL_REPS):
    """AUC of every channel under every replicate's labels."""
    return replicate_auc(rows, ["channel"], Labels(reps)).filter("auc IS NOT NULL")


def sql_null(group: str, seed: int) -> str:
    return (
        "WITH"
        + SQL_DOC
        + ","
        + sql_permuted(group, seed)
        + sql_auc("null_scored", "rep, rule", "n")
        + ","
        + sql_auc("scored", "rule", "o")
        + """, draws AS (SELECT rep, max(auc) AS best FROM n GROUP BY rep), obs AS (SELECT max(auc) AS observed FROM o)
SELECT count(best)::BIGINT AS reps, round(avg(best), 6) AS mean, round(stddev_samp(best), 6) AS sd, round(quantile_cont(best, 0.95), 6) AS p95, round(max(best), 6) AS max,
  round(any_value(observed), 6) AS observed, round((1 + count(*) FILTER (WHERE best >= observed)) / (1 + count(best)), 6) AS monte_carlo_p FROM draws, obs"""
    )


def null_summary(spark, sf, group, seed):
    feats, rows = masked_scores(spark, sf, group, seed)
    best = null_draws(rows).groupBy("rep").agg(F.max("auc").alias("auc"))
    real = C.best_fixed_channel(long_rules(feats, DOC_RULES, "channel").withColumn("one", F.lit(1)), ["one"])
    want = cut(real.select("one", F.col("auc").alias("want")))
    joined = best.withColumn("one", F.lit(1)).join(small(want), "one")
    out = B.monte_carlo(joined, ["one"], "auc", F.col("want"))
    return rounded(out.drop("one"), "mean", "sd", "p95", "max", "observed", "monte_carlo_p")


@query("permutation_null", sql_null("cluster", 21))
def permutation_null(spark, sf):
    return null_summary(spark, sf, "cluster", 21)


@query("permutation_null_category", sql_null("category", 22))
def permutation_null_category(spark, sf):
    return null_summary(spark, sf, "category", 22)


@query("permutation_null_free", sql_null("'all'", 23))
def permutation_null_free(spark, sf):
    return null_summary(spark, sf, None, 23)


@query(
    "heldout_null",
    "WITH"
    + SQL_DOC
    + ","
    + sql_permuted("category", 22, HELD_REPS)
    + halves_sql(SPLITS)
    + """,
folded AS (SELECT p.rep, w.rep AS fold, s.rule, s.score, p.wrong FROM perm p JOIN scored s USING (doc_id) JOIN weights w ON w.cluster = s.cluster),"""
    + sql_auc("folded", "rep, fold, rule", "b")
    + """, best AS (SELECT * FROM (SELECT rep, fold, rule, row_number() OVER (PARTITION BY rep, fold ORDER BY auc DESC, rule) AS k FROM b WHERE auc IS NOT NULL) WHERE k = 1)
SELECT best.rep::BIGINT AS rep, count(*)::BIGINT AS folds, round(avg(b.auc), 6) AS held_mean FROM best JOIN b ON b.rep = best.rep AND b.rule = best.rule AND b.fold = xor(best.fold, 1) WHERE b.auc IS NOT NULL GROUP BY 1""",
)
def heldout_null(spark, sf):
    """Held-out mean of the best score under labels permuted within language."""
    feats, rows = masked_scores(spark, sf, "category", 22, HELD_REPS)
    clusters = B.index_clusters(feats, "cluster")
    numbered = cut(rows.join(small(clusters), "cluster"))
    folds = 2 * SPLITS
    auc = replicate_auc(numbered, ["channel"], LabelsInHalves(HELD_REPS, Halves(clusters.count(), folds, 3)), "column")
    auc = auc.withColumn("rep", F.floor(F.col("column") / folds)).withColumn("fold", F.col("column") % folds).drop("column")
    held = B.held_out(auc, "channel", ["rep"])
    return held.groupBy(F.col("rep").cast("bigint").alias("rep")).agg(F.count(F.lit(1)).alias("folds"), r6(F.avg("held_auc")).alias("held_mean"))


@query(
    "permutation_draws",
    "WITH"
    + SQL_DOC
    + ","
    + sql_permuted("cluster", 21)
    + sql_auc("null_scored", "rep, rule", "n")
    + " SELECT rep::BIGINT AS rep, rule AS channel, round(auc, 6) AS auc FROM n WHERE auc IS NOT NULL",
)
def permutation_draws(spark, sf):
    _, rows = masked_scores(spark, sf, "cluster", 21)
    out = null_draws(rows).select(F.col("rep").cast("bigint").alias("rep"), "channel", "auc")
    return rounded(out, "auc")


@query("mapping_null")
def mapping_null(spark, sf):
    """Null of the mapping search over matched items: labels permuted within each cluster."""
    rows = cut(analysis_items(spark, sf).filter("matched").select("vec_id", "cluster", "category", "wrong", "n_cells", "channels"))
    masks = B.permuted_masks(rows, ["cluster"], "vec_id", "wrong", NULL_REPS, 31)
    found = C.mapping_null(item_channels(rows), masks.select("vec_id", "mask"), "vec_id", NULL_REPS)
    return rounded(found, "auc").withColumn("rep", F.col("rep").cast("bigint"))


@query(
    "mapping_pairs",
    "WITH"
    + SQL_DOC
    + ","
    + sql_permuted("cluster", 41, 64)
    + " cell_rows AS (SELECT p.rep, s.category, s.rule, s.score, p.wrong FROM perm p JOIN scored s USING (doc_id)),"
    + sql_best_mappings("rep", "tried")
    + " SELECT rep::BIGINT AS rep, c1 AS category, h1 AS channel, c2 AS other_category, h2 AS other_channel, w AS pairs FROM u WHERE w > 0",
)
def mapping_pairs(spark, sf):
    """What the mapping search works on, under 64 permutations: errors of one cell below correct rows of another."""
    feats = cut(doc_features(spark, sf))
    cells = C.cells_of(long_rules(feats, DOC_RULES, "channel"))
    return C.cell_pairs(cell_masks(feats, cells, "cluster", 64), Labels(64), cells)


MAPPING_NULLS = {"cluster": 41, "category": 42}
def null_rows(draws, observed, kind):
    """One summary row of a null: draws (auc) against the observed value."""
    want = cut(observed).select("want").scalar() - 1e-9
    rows = draws.filter("auc IS NOT NULL").select(F.lit(kind).alias("kind"), "auc", want.alias("want"))
    out = B.monte_carlo(rows, ["kind"], "auc", F.col("want"))
    return rounded(out.withColumn("observed", F.col("observed") + 1e-9), "mean", "sd", "p95", "max", "observed", "monte_carlo_p")


def cell_masks(feats, cells, group, reps, numbered=None):
    """Every channel's cells with permuted labels as bits."""
    masks = B.permuted_masks(feats, [group], "doc_id", "wrong", reps, MAPPING_NULLS[group]).select("doc_id", "mask")
    rows = C.coded(long_rules(feats, DOC_RULES, "channel"), cells).join(masks, "doc_id")
    rows = rows.join(small(numbered), "cluster") if numbered is not None else rows
    return cut(rows.select("cell", "score", "mask", *(["idx"] if numbered is not None else [])))


def mapping_null_within(group):
    def run(spark, sf):
        feats = cut(doc_features(spark, sf))
        scored = long_rules(feats, DOC_RULES, "channel")
        cells = C.cells_of(scored)
        observed = C.best_mapping(scored.withColumn("one", F.lit(1)), ["one"]).agg(F.max("search_auc").alias("want"))
        return null_rows(C.mapping_draws(cell_masks(feats, cells, group, NULL_REPS), Labels(NULL_REPS), cells), observed, group)

    return run


for _group in MAPPING_NULLS:
    query(f"mapping_null_{_group}")(mapping_null_within(_group))


def mapping_null_heldout(group):
    def run(spark, sf):
        feats = cut(doc_features(spark, sf))
        cells = C.cells_of(long_rules(feats, DOC_RULES, "channel"))
        clusters = B.index_clusters(feats, "cluster")
        halves = Halves(clusters.count(), 2 * SPLITS, 3)
        numbered = long_rules(feats, DOC_RULES, "channel").join(small(clusters), "cluster")
        real = C.held_out_mappings(C.score_cells(numbered, [], ["idx"], cells), halves, cells).agg(F.avg("auc").alias("want"))
        rows = cell_masks(feats, cells, group, HELD_REPS, clusters)
        held = C.held_out_mappings(rows, LabelsInHalves(HELD_REPS, halves), cells, C.GROUPS)
        means = held.groupBy(F.floor(F.col("column") / (2 * SPLITS)).alias("rep")).agg(F.avg("auc").alias("auc"))
        return null_rows(means, real, f"heldout_{group}")

    return run


for _group in MAPPING_NULLS:
    query(f"mapping_null_heldout_{_group}")(mapping_null_heldout(_group))


def item_channels(rows):
    """The confidence formula on every channel of every item."""
    long = rows.select("vec_id", "category", "n_cells", F.explode("channels").alias("c"))
    score = R.confidence(F.col("c.mean"), F.col("c.p95"), F.col("c.n_gt"), F.greatest(F.lit(1), F.col("n_cells")))
    return long.select("vec_id", "category", "c.channel", score.alias("score"))


@query("best_item_mapping")
def best_item_mapping(spark, sf):
    """Best channel per level over matched items, with the exact AUC it attains."""
    rows = cut(analysis_items(spark, sf).filter("matched").select("vec_id", "category", "wrong", "n_cells", "channels"))
    scored = cut(item_channels(rows).join(rows.select("vec_id", "wrong"), "vec_id").withColumn("rep", F.lit(0)))
    found = cut(C.best_mapping(scored, ["rep"]))
    exact = C.mapping_auc(scored, found, ["rep"])
    out = found.join(small(exact.select("rep", "auc")), "rep").drop("rep", "start")
    return rounded(out.withColumn("channel", F.col("channel").cast("bigint")), "search_auc", "auc")


@query("heldout_mapping")
def heldout_mapping(spark, sf):
    """Mapping fitted on half the clusters, scored exactly on the other half, both directions."""
    scored = cut(channel_scored(spark, sf).select("cluster", "category", "channel", "score", "wrong"))
    cells, clusters = C.cells_of(scored), B.index_clusters(scored, "cluster")
    rows = C.score_cells(scored.join(small(clusters), "cluster"), [], ["idx"], cells)
    found = C.held_out_mappings(rows, Halves(clusters.count(), 2 * SPLITS, 3), cells)
    return rounded(found.select(F.col("column").cast("bigint").alias("fold"), "auc"), "auc")


@query(
    "monte_carlo_p",
    "WITH"
    + SQL_DOC
    + ","
    + sql_permuted("cluster", 21)
    + sql_auc("null_scored", "rep, rule", "n")
    + ","
    + sql_auc("scored", "rule", "o")
    + """ SELECT n.rule AS channel, count(n.auc)::BIGINT AS reps, round(avg(n.auc), 6) AS mean, round(stddev_samp(n.auc), 6) AS sd, round(quantile_cont(n.auc, 0.95), 6) AS p95,
  round(max(n.auc), 6) AS max, round(any_value(o.auc), 6) AS observed, round((1 + count(*) FILTER (WHERE n.auc >= o.auc)) / (1 + count(n.auc)), 6) AS monte_carlo_p
FROM n JOIN o USING (rule) WHERE n.auc IS NOT NULL GROUP BY 1""",
)
def monte_carlo_p(spark, sf):
    feats, rows = masked_scores(spark, sf, "cluster", 21)
    real = D.auc(long_rules(feats, DOC_RULES, "channel"), ["channel"]).select("channel", F.col("auc").alias("want"))
    out = B.monte_carlo(null_draws(rows).join(small(cut(real)), "channel"), ["channel"], "auc", F.col("want"))
    return rounded(out, "mean", "sd", "p95", "max", "observed", "monte_carlo_p")


SQL_ROC = (
    SQL_DOC
    + """, pts AS (SELECT rule, score, count(*) FILTER (WHERE wrong) AS p, count(*) FILTER (WHERE NOT wrong) AS q FROM scored WHERE score IS NOT NULL GROUP BY ALL),
tot AS (SELECT rule, sum(p) AS P, sum(q) AS N, count(*) + 1 AS k FROM pts GROUP BY 1),
cum AS (SELECT rule, score, row_number() OVER w AS place, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM pts WINDOW w AS (PARTITION BY rule ORDER BY score DESC)),
curve AS (SELECT rule, place, score AS threshold, tp / nullif(P, 0) AS tpr, fp / nullif(N, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision, P, N, k FROM cum JOIN tot USING (rule)
  UNION ALL SELECT rule, 0, NULL, 0, 0, 1, P, N, k FROM tot)"""
)


@query(
    "roc_curve",
    "WITH"
    + SQL_ROC
    + """ SELECT rule, place::BIGINT AS place, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS "precision" FROM curve WHERE place % greatest(1, k // 400) = 0""",
)
def roc_curve(spark, sf):
    points = D.thin(D.roc_points(doc_scored(spark, sf), ["rule"]), ["rule"], "place")
    return points.select("rule", "place", *[r6(c).alias(c) for c in ("tpr", "fpr", "precision")])


@query(
    "roc_curve_full",
    "WITH" + SQL_ROC + """ SELECT rule, place::BIGINT AS place, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS "precision" FROM curve""",
)
def roc_curve_full(spark, sf):
    """Every point of the curve, nothing thinned."""
    points = D.roc_points(doc_scored(spark, sf), ["rule"])
    return points.select("rule", "place", *[r6(c).alias(c) for c in ("tpr", "fpr", "precision")])


@query(
    "pr_summary",
    "WITH"
    + SQL_ROC
    + """, st AS (SELECT *, lag(tpr) OVER w AS t0, lag(fpr) OVER w AS f0 FROM curve WINDOW w AS (PARTITION BY rule ORDER BY place)),
op AS (SELECT rule, count(*) FILTER (WHERE wrong) AS h, count(*) FILTER (WHERE NOT wrong) AS f FROM scored WHERE score > 40 GROUP BY 1)
SELECT rule, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, round(sum((tpr - t0) * precision), 6) AS average_precision, round(any_value(P) / (any_value(P) + any_value(N)), 6) AS prevalence,
  any_value(P)::BIGINT AS n_pos, any_value(N)::BIGINT AS n_neg, round(coalesce(any_value(h), 0) / any_value(P), 6) AS op_tpr, round(coalesce(any_value(f), 0) / any_value(N), 6) AS op_fpr,
  round(any_value(h) / nullif(any_value(h) + any_value(f), 0), 6) AS op_ppv FROM st LEFT JOIN op USING (rule) GROUP BY rule""",
)
def pr_summary(spark, sf):
    out = D.pr_summary(D.roc_points(doc_scored(spark, sf), ["rule"]), ["rule"], 40.0)
    return rounded(out, "auc", "average_precision", "prevalence", "op_tpr", "op_fpr", "op_ppv")


@query(
    "flag_agreement",
    "WITH"
    + SQL_FLAGGED
    + """ SELECT category, (count(*) FILTER (WHERE flag AND other_flag))::BIGINT AS both_flags, (count(*) FILTER (WHERE flag AND NOT other_flag))::BIGINT AS only_a,
  (count(*) FILTER (WHERE NOT flag AND other_flag))::BIGINT AS only_b, (count(*) FILTER (WHERE NOT flag AND NOT other_flag))::BIGINT AS neither,
  (count(DISTINCT cluster) FILTER (WHERE flag))::BIGINT AS clusters_a, (count(DISTINCT cluster) FILTER (WHERE other_flag))::BIGINT AS clusters_b FROM fl GROUP BY 1""",
)
def flag_agreement(spark, sf):
    rows = flagged_docs(spark, sf)
    out = D.flag_agreement(rows, ["category"], F.col("flag"), F.col("other_flag"))
    hit = rows.groupBy("category", "cluster").agg(F.bool_or("flag").alias("a"), F.bool_or("other_flag").alias("b"))
    per = hit.groupBy("category").agg(count_if(F.col("a")).alias("clusters_a"), count_if(F.col("b")).alias("clusters_b"))
    return out.join(per, "category")


@query(
    "self_check",
    "WITH"
    + SQL_ITEM
    + """, t AS (SELECT cluster, code AS label, 100 * avg(x) AS x, 100 * avg(y) AS y, 100 * avg(z) AS z FROM item GROUP BY ALL),
v AS (SELECT 'identity' AS variant, *, label AS claim FROM t UNION ALL SELECT 'shift', *, label + 1 FROM t),
both_ AS (SELECT v.variant, v.cluster, v.claim, v.x, v.y, v.z FROM v WHERE EXISTS (SELECT 1 FROM t WHERE t.cluster = v.cluster AND t.label = v.claim)),
near AS (SELECT b.variant, b.cluster, b.claim, t.label, row_number() OVER (PARTITION BY b.variant, b.cluster, b.claim ORDER BY sqrt((b.x - t.x)^2 + (b.y - t.y)^2 + (b.z - t.z)^2), t.label) AS k,
  sqrt((b.x - t.x)^2 + (b.y - t.y)^2 + (b.z - t.z)^2) AS d FROM both_ b JOIN t USING (cluster)
  WHERE EXISTS (SELECT 1 FROM v WHERE v.variant = b.variant AND v.cluster = t.cluster AND v.claim = t.label)),
hit AS (SELECT variant, count(*) AS h FROM near WHERE k = 1 AND label = claim AND d <= 20 GROUP BY 1)
SELECT w.variant, (SELECT count(*) FROM t)::BIGINT AS n, coalesce(h, 0)::BIGINT AS hits, round(coalesce(h, 0) / (SELECT count(*) FROM t), 6) AS id_rate, w.fg AS dice_fg, w.lab AS dice_label
FROM (VALUES ('identity', 1.0::DOUBLE, 1.0::DOUBLE), ('shift', 1.0::DOUBLE, 0.0::DOUBLE)) AS w(variant, fg, lab) LEFT JOIN hit USING (variant)""",
)
def self_check(spark, sf):
    """Scoring the truth against itself must be perfect; against shifted labels it must collapse."""
    axes = ["x", "y", "z"]
    truth = items(spark, sf).groupBy("cluster", F.col("code").alias("label")).agg(*[(100 * F.avg(a)).alias(a) for a in axes])
    truth = cut(truth)
    cells = truth.select("cluster", F.col("label").alias("cell"), "label")
    out = []
    for name, by in (("identity", 0), ("shift", 1)):
        pred = truth.withColumn("label", F.col("label") + by)
        hits = identification_hits(truth, pred, ["cluster"], axes, "label")
        fore, per = dice(cells, cells.withColumn("label", F.col("label") + by), ["cluster"], ["cell"], "label")
        out.append(
            hits.agg(
                F.lit(name).alias("variant"),
                F.count(F.lit(1)).alias("n"),
                F.sum("hit").cast("bigint").alias("hits"),
                r6(F.avg("hit")).alias("id_rate"),
                r6(fore.select(F.avg("dice_fg")).scalar()).alias("dice_fg"),
                r6(per.select(F.avg("dice")).scalar()).alias("dice_label"),
            )
        )
    return out[0].unionByName(out[1])
