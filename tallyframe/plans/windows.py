"""Ordered queries, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import micros, r6
from tallyframe.functions.draws import sql_drawn
from tallyframe.operators import logs as L
from tallyframe.operators import sequences as Q
from tallyframe.operators.curves import inject, pooled_z, robust_z
from tallyframe.operators.detection import average_rank
from tallyframe.operators.resampling import mask_totals, permute_within, permuted_masks
from tallyframe.operators.rules import phase_estimate
from tallyframe.plans.base import SQL_RULES, SQL_VARIANTS, analysis_items, centers, rounded
from tallyframe.plans.registry import query
from tallyframe.sources.tables import table

BY_TIME = ["ts", "event_id"]


def events(spark, sf, *more):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", *more)


@query(
    "detection_order",
    "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1)::BIGINT AS seq FROM events",
)
def detection_order(spark, sf):
    return Q.detection_order(events(spark, sf, "value"), ["user_id"], "value", "event_id").select("event_id", "seq")


@query(
    "neighbour_ratio",
    """
WITH e AS (SELECT event_id, user_id, value - 1 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT a.event_id, a.v, median(b.v) AS med FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND abs(a.i - b.i) BETWEEN 1 AND 2 AND b.v > 0 GROUP BY ALL)
SELECT event_id, round(CASE WHEN v > 0 AND med IS NOT NULL THEN -abs(ln(v / med)) END, 6) AS ratio_score FROM m""",
)
def neighbour_ratio(spark, sf):
    rows = events(spark, sf, (F.col("value") - 1).alias("v"))
    return Q.neighbour_ratio(rows, ["user_id"], BY_TIME, "v").select("event_id", r6("ratio_score").alias("ratio_score"))


@query(
    "spacing_regularity",
    """
WITH g AS (SELECT event_id, user_id, ts, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back, median(gap) OVER (PARTITION BY user_id) AS med, count(*) OVER (PARTITION BY user_id) AS n FROM g)
SELECT event_id, round(CASE WHEN n >= 3 AND med > 0 THEN -greatest(coalesce(abs(ln(CASE WHEN gap IS NOT NULL THEN greatest(gap, 1e-6) END / med)), 0), coalesce(abs(ln(CASE WHEN back IS NOT NULL THEN greatest(back, 1e-6) END / med)), 0)) END, 6) AS spacing_score FROM b""",
)
def spacing_regularity(spark, sf):
    rows = events(spark, sf).withColumn("at", micros("ts"))
    gap = Q.Gap(["at"], lambda a, b: (b["at"] - a["at"]) / F.lit(1e6))
    return Q.spacing_regularity(rows, ["user_id"], BY_TIME, gap).select("event_id", r6("spacing_score").alias("spacing_score"))


@query(
    "position_facts",
    """
WITH p AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, idx::BIGINT AS idx, n::BIGINT AS group_size, idx = 0 OR idx = n - 1 AS endpoint, least(idx, n - 1 - idx)::BIGINT AS depth FROM p""",
)
def position_facts(spark, sf):
    return Q.position_facts(events(spark, sf), ["user_id"], BY_TIME).drop("user_id", "ts")


@query(
    "pooled_z",
    """
SELECT event_id, round(CASE WHEN k >= 2 THEN (value - m) / greatest(s, 30) END, 6) AS z, CASE WHEN k >= 2 THEN s < 30 END AS z_floored
FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id))""",
)
def pooled(spark, sf):
    return rounded(pooled_z(events(spark, sf, "value"), ["user_id"], "value", 30.0, "z", ["event_id"]), "z").select("event_id", "z", "z_floored")


@query(
    "robust_z",
    """
WITH a AS (SELECT event_id, user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events),
b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY user_id) AS mad FROM a)
SELECT event_id, round((value - med) / greatest(1.4826 * mad, 0.1), 6) AS z FROM b""",
)
def robust(spark, sf):
    return rounded(robust_z(events(spark, sf, "value"), ["user_id"], "value", 0.1, "z", ["event_id"]), "z").select("event_id", "z")


@query(
    "avg_rank",
    """
SELECT DISTINCT event_type, value, round(rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2, 6) AS avg_rank,
  (count(*) OVER (PARTITION BY event_type, value))::BIGINT AS ties FROM events""",
)
def avg_rank(spark, sf):
    return rounded(average_rank(table(spark, sf, "events"), ["event_type"], "value"), "avg_rank")


@query(
    "log_sessions",
    """
WITH t AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
SELECT user_id, session, (count(*) FILTER (WHERE event_type <> 'signup'))::BIGINT AS n, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS last_view,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM t WHERE session IS NOT NULL GROUP BY ALL""",
)
def log_sessions(spark, sf):
    kind = F.col("event_type")
    rows = Q.log_sessions(events(spark, sf, "event_type", "value"), ["user_id"], BY_TIME, F.when(kind == "signup", F.col("event_id")))
    view = kind == "view"
    return rows.groupBy("user_id", "session").agg(
        F.count_if(kind != "signup").cast("bigint").alias("n"),
        F.max_by("value", F.when(view, F.struct("ts", "event_id"))).alias("last_view"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


def injected(variant):
    def make(spark, sf):
        rows = inject(centers(spark, sf), ["cluster"]).filter(F.col("variant") == variant)
        rows = rows.select("cluster", F.col("ord").cast("bigint").alias("ord"), "x", "y", "perturbed", "site")
        return rounded(rows, "x", "y")

    return make


for _name, _variant in (
    ("inject_shift", "level_shift"),
    ("inject_swap", "swap"),
    ("inject_off_by_one", "off_by_one"),
    ("inject_offset", "offset"),
):
    query(
        _name,
        "WITH"
        + SQL_VARIANTS
        + f" SELECT cluster, ord::BIGINT AS ord, round(x, 6) AS x, round(y, 6) AS y, perturbed, site FROM variants WHERE variant = '{_variant}'",
    )(injected(_variant))


@query(
    "permute_within",
    """
WITH b AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id)),
r AS (SELECT rep, source, doc_id, row_number() OVER (PARTITION BY rep, source ORDER BY ('0x' || substr(md5(concat_ws('|', 11, rep, doc_id)), 1, 8))::BIGINT, doc_id) AS k FROM b, (SELECT range AS rep FROM range(5)))
SELECT rep::BIGINT AS rep, source, doc_id, b.quality::BIGINT AS quality FROM r JOIN b USING (source, k, doc_id) WHERE false
UNION ALL SELECT r.rep::BIGINT, r.source, r.doc_id, b.quality::BIGINT FROM r JOIN b ON r.source = b.source AND r.k = b.k""",
)
def permuted(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    out = permute_within(rows, ["source"], "doc_id", "quality", 5, 11)
    return out.select(F.col("rep").cast("bigint").alias("rep"), "source", "doc_id", F.col("quality").cast("bigint").alias("quality"))


MASK_REPS = 1000


@query(
    "permutation_masks",
    """
WITH b AS (SELECT source, doc_id, quality = 0 AS wrong, row_number() OVER (ORDER BY doc_id) - 1 AS j, count(*) FILTER (WHERE quality = 0) OVER (PARTITION BY source) AS errors
  FROM documents JOIN labels USING (doc_id)),"""
    + sql_drawn("numbers", "b", "j", 11, MASK_REPS, "source, doc_id, errors")
    + """,
p AS (SELECT rep, source, doc_id, row_number() OVER (PARTITION BY rep, source ORDER BY draw) <= errors AS hit FROM numbers)
SELECT source, doc_id, (count(*) FILTER (WHERE hit))::BIGINT AS times, coalesce(sum(rep) FILTER (WHERE hit), 0)::BIGINT AS reps_sum FROM p GROUP BY ALL""",
)
def permutation_masks(spark, sf):
    """How often, and in which replicates, a document is an error when labels are permuted within its source."""
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("wrong")), "doc_id")
    masks = permuted_masks(rows, ["source"], "doc_id", "wrong", MASK_REPS, 11)
    return mask_totals(masks, ["source", "doc_id"], MASK_REPS)


@query(
    "series_regularity",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER w - 1 AS i, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, count(*) AS n, min(t) AS f, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS step FROM e GROUP BY 1)
SELECT user_id, any_value(n)::BIGINT AS n, round(any_value(step), 3) AS step, round(max(abs(t - (f + i * step))), 3) AS worst_residual, round(max(abs(gap - step)), 3) AS worst_gap
FROM e JOIN s USING (user_id) GROUP BY 1""",
)
def series_regularity(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", (micros("ts") / F.lit(1e6)).alias("t"))
    out = Q.series_regularity(rows, ["user_id"], "t", "event_id")
    return out.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("step", "worst_residual", "worst_gap")])


@query(
    "phase_estimate",
    "WITH"
    + SQL_RULES
    + " SELECT cluster::BIGINT AS cluster, round(total_0, 6) AS total_0, round(total_1, 6) AS total_1, CASE WHEN total_1 > total_0 THEN 1 ELSE 0 END::BIGINT AS phase FROM phases",
)
def phase(spark, sf):
    rows = analysis_items(spark, sf).drop("phase").withColumn("cluster", F.col("cluster").cast("bigint"))
    out = phase_estimate(rows, ["cluster"])
    return rounded(out.withColumn("phase", F.col("phase").cast("bigint")), "total_0", "total_1")


@query(
    "top2_margin",
    """
WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS k FROM c)
SELECT user_id, max(event_type) FILTER (WHERE k = 1) AS best, round(max(v) FILTER (WHERE k = 1), 6) AS top1,
  round(max(v) FILTER (WHERE k = 1) - coalesce(max(v) FILTER (WHERE k = 2), 0), 6) AS margin FROM r GROUP BY 1""",
)
def top2_margin(spark, sf):
    means = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("down"), "event_type")))
    rows = means.groupBy("user_id").agg(ranked.alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    top = -first["down"]
    return rows.select("user_id", first["event_type"].alias("best"), r6(top).alias("top1"), r6(top + F.coalesce(second["down"], F.lit(0.0))).alias("margin"))


@query("first_n", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 20")
def first_n(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_name").limit(20)


@query(
    "strided_sample",
    """
WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang, place::BIGINT AS place FROM p WHERE place % greatest(1, n // 60) = 0 AND place < 60 * greatest(1, n // 60)""",
)
def strided_sample(spark, sf):
    return Q.strided(table(spark, sf, "documents").select("doc_id", "lang"), ["lang", "doc_id"], 60)


@query(
    "alternate_labels",
    """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE k % 2 = 1""",
)
def alternate_labels(spark, sf):
    out = Q.alternate(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query(
    "subset_violations",
    """
WITH e AS (SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('purchase', 'view'))
SELECT user_id, day, 'missing' AS problem FROM e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.day = e.day)
UNION ALL SELECT user_id, day, 'extra' FROM e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.day = e.day)""",
)
def subset_violations(spark, sf):
    """Days on which a user bought without viewing, and the other way round."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = table(spark, sf, "events").select("user_id", "event_type", day).distinct()
    bought, viewed = rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'view'")

    def listed(part, whole, name):
        return L.subset_violations(part, whole, ["user_id", "day"]).select("user_id", "day", F.lit(name).alias("problem"))

    return listed(bought, viewed, "missing").unionByName(listed(viewed, bought, "extra"))


@query(
    "contamination",
    r"""
WITH b AS (SELECT DISTINCT trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r]+', ' ', 'g')) AS line FROM benchmark),
d AS (SELECT DISTINCT trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r]+', ' ', 'g')) AS line FROM documents)
SELECT sha256(line) AS digest FROM b WHERE line <> '' AND line IN (SELECT line FROM d)""",
)
def contamination(spark, sf):
    """Digests of the benchmark's lines, white space aside, that documents hold too."""

    def digests(name):
        lines = table(spark, sf, name).select(F.explode(F.split("text", "\n")).alias("line"))
        line = F.trim(F.regexp_replace("line", r"[ \t\r]+", " "))
        return lines.select(line.alias("line")).filter("line <> ''").select(F.sha2("line", 256).alias("digest"))

    return digests("benchmark").intersect(digests("documents"))


@query(
    "line_overlap",
    """
WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
b AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark),
a AS (SELECT source, line, EXISTS (SELECT 1 FROM b WHERE b.line = l.line AND length(b.line) > 25) AS hit FROM l WHERE length(line) > 25)
SELECT source, grouping_id(source)::BIGINT AS grain, count(*)::BIGINT AS lines, (count(*) FILTER (WHERE hit))::BIGINT AS shared, round((count(*) FILTER (WHERE hit)) / count(*), 6) AS share
FROM a GROUP BY GROUPING SETS ((), (source))""",
)
def line_overlap(spark, sf):
    ours = L.split_lines(table(spark, sf, "documents"), ["source"], "text").drop("line_no")
    theirs = L.split_lines(table(spark, sf, "benchmark"), ["item_id"], "text").drop("line_no")
    return rounded(L.line_overlap(ours, theirs, "source", "line"), "share")


@query(
    "source_line_overlap",
    """
WITH l AS (SELECT source, lang, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
a AS (SELECT source, line, EXISTS (SELECT 1 FROM l b WHERE b.lang = 'fr' AND b.line = l.line) AS hit FROM l WHERE lang <> 'fr' AND length(line) > 25)
SELECT source, grouping_id(source)::BIGINT AS grain, count(*)::BIGINT AS lines, (count(*) FILTER (WHERE hit))::BIGINT AS shared, round((count(*) FILTER (WHERE hit)) / count(*), 6) AS share
FROM a GROUP BY GROUPING SETS ((), (source))""",
)
def source_line_overlap(spark, sf):
    lines = L.split_lines(table(spark, sf, "documents"), ["source", "lang"], "text").drop("line_no")
    return rounded(L.line_overlap(lines.filter("lang <> 'fr'"), lines.filter("lang = 'fr'"), "source", "line"), "share")


