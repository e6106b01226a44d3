"""Shared inputs of the registered queries, in Spark and as SQL building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import r6
from tallyframe.operators import rules as R
from tallyframe.operators.matching import has_own, match
from tallyframe.operators.reductions import mapping_free
from tallyframe.operators.sequences import Gap, detection_order, neighbour_ratio, spacing_regularity
from tallyframe.functions.columns import distance
from tallyframe.functions.ordered import small
from tallyframe.session import cut
from tallyframe.sources.tables import table

DOC_RULES = ["chars", "lines", "words", "density", "digits"]
TOLERANCE = 0.06


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named double columns for comparison."""
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- labelled documents, five text scores as rules, source as cluster, quality 0 as error


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    text = F.col("text")

    def lost(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")

    words = lost(" ") + 1
    digits = lost("[0-9]")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("source").alias("cluster"),
        F.col("lang").alias("category"),
        (F.col("quality") == 0).alias("wrong"),
        (F.col("toxic") == 1).alias("toxic"),
        F.col("n_chars").cast("double").alias("chars"),
        (lost("\n") + 1).alias("lines"),
        words.alias("words"),
        (F.col("n_chars") / words).alias("density"),
        F.when(digits > 0, digits).alias("digits"),
    )


def long_rules(features: DataFrame, names: list[str], rule: str = "rule") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(rule), F.col(n).alias("score")) for n in names])
    rest = [c for c in features.columns if c not in names]
    return features.withColumn("__p", F.explode(pairs)).select(*rest, "__p.*")


def doc_scored(spark: SparkSession, sf: str) -> DataFrame:
    return long_rules(doc_features(spark, sf), DOC_RULES)


SQL_DOC = """
feat AS (
  SELECT d.doc_id, d.source AS cluster, d.lang AS category, l.quality = 0 AS wrong, l.toxic = 1 AS toxic,
    d.n_chars::DOUBLE AS chars,
    (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS lines,
    (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS words,
    d.n_chars::DOUBLE / (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS density,
    nullif(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')), 0)::DOUBLE AS digits
  FROM documents d JOIN labels l USING (doc_id)),
scored AS (
  SELECT doc_id, cluster, category, wrong, 'chars' AS rule, chars AS score FROM feat
  UNION ALL SELECT doc_id, cluster, category, wrong, 'lines', lines FROM feat
  UNION ALL SELECT doc_id, cluster, category, wrong, 'words', words FROM feat
  UNION ALL SELECT doc_id, cluster, category, wrong, 'density', density FROM feat
  UNION ALL SELECT doc_id, cluster, category, wrong, 'digits', digits FROM feat)"""


def sql_auc(source: str, keys: str, name: str) -> str:
    """CTEs giving (keys, n_wrong, n_right, auc) from average ranks."""
    return f"""
{name}_r AS (
  SELECT {keys}, wrong, rank() OVER (PARTITION BY {keys} ORDER BY score)
    + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2::DOUBLE AS rk
  FROM {source} WHERE score IS NOT NULL AND wrong IS NOT NULL),
{name}_s AS (
  SELECT {keys}, (count(*) FILTER (WHERE wrong))::BIGINT AS n_wrong, (count(*) FILTER (WHERE NOT wrong))::BIGINT AS n_right,
    coalesce(sum(rk) FILTER (WHERE wrong), 0)::DOUBLE AS sr
  FROM {name}_r GROUP BY {keys}),
{name} AS (
  SELECT {keys}, n_wrong, n_right,
    (n_wrong::DOUBLE * n_right + n_wrong * (n_wrong + 1) / 2::DOUBLE - sr) / nullif(n_wrong::DOUBLE * n_right, 0) AS auc
  FROM {name}_s)"""


def sql_hanley(name: str, source: str) -> str:
    return f"""
{name}_v AS (
  SELECT *, greatest((auc * (1 - auc) + (n_wrong - 1) * (auc / (2 - auc) - auc * auc)
    + (n_right - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / nullif(n_wrong::DOUBLE * n_right, 0), 0) AS var FROM {source}),
{name} AS (
  SELECT * EXCLUDE (var), CASE WHEN auc IS NOT NULL THEN greatest(0, auc - 1.96::DOUBLE * sqrt(var)) END AS lo,
    CASE WHEN auc IS NOT NULL THEN least(1, auc + 1.96::DOUBLE * sqrt(var)) END AS hi FROM {name}_v)"""


# ---- items of the embedding table: three coordinates, eleven channels, label as cluster


def items(spark: SparkSession, sf: str) -> DataFrame:
    vec = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))

    def e(i) -> Column:
        return F.get("e", i if isinstance(i, Column) else F.lit(i))

    code = (F.pmod("vec_id", F.lit(28)) + 1).cast("int")
    channels = F.transform(
        F.sequence(F.lit(0), F.lit(10)),
        lambda c: F.struct(
            c.alias("channel"),
            F.abs(e(c + 4)).alias("mean"),
            F.abs(e(c + 15)).alias("p95"),
            F.floor(F.abs(e(c + 26)) * 100).alias("n_gt"),
        ),
    )
    return vec.select(
        "vec_id",
        F.col("label").alias("cluster"),
        code.alias("code"),
        R.normalise_category(R.level_name(code)).alias("category"),
        (F.pmod("vec_id", F.lit(50)) + 1).alias("n_cells"),
        e(0).alias("x"),
        e(1).alias("y"),
        e(2).alias("z"),
        (e(0) + 0.3 * e(3)).alias("rx"),
        (e(1) + 0.3 * e(4)).alias("ry"),
        (e(2) + 0.3 * e(5)).alias("rz"),
        (e(6) > 0).alias("seen"),
        channels.alias("channels"),
    )


def reference_points(rows: DataFrame) -> DataFrame:
    """The reference side: the same items at their moved places."""
    return rows.filter("seen").select(
        "cluster", "category", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rz").alias("z")
    )


SQL_ITEM = """
item AS (
  SELECT vec_id, label AS cluster, (vec_id % 28 + 1)::INT AS code, vec_id % 50 + 1 AS n_cells,
    CASE WHEN vec_id % 28 < 7 THEN 'C' || (vec_id % 28 + 1) WHEN vec_id % 28 < 19 THEN 'T' || (vec_id % 28 - 6)
      WHEN vec_id % 28 < 25 THEN 'L' || (vec_id % 28 - 18) WHEN vec_id % 28 = 25 THEN 'SACRUM'
      WHEN vec_id % 28 = 26 THEN 'COCCYX' ELSE 'T13' END AS category,
    embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
    embedding[1]::DOUBLE + 0.3::DOUBLE * embedding[4]::DOUBLE AS rx,
    embedding[2]::DOUBLE + 0.3::DOUBLE * embedding[5]::DOUBLE AS ry,
    embedding[3]::DOUBLE + 0.3::DOUBLE * embedding[6]::DOUBLE AS rz,
    embedding[7] > 0 AS seen,
    list_transform(range(0, 11), lambda c: abs(embedding[5 + c]::DOUBLE)) AS m,
    list_transform(range(0, 11), lambda c: abs(embedding[16 + c]::DOUBLE)) AS q,
    list_transform(range(0, 11), lambda c: floor(abs(embedding[27 + c]::DOUBLE) * 100)) AS g
  FROM embeddings),
reference AS (SELECT cluster, category, rx AS x, ry AS y, rz AS z FROM item WHERE seen)"""

SQL_MATCH = (
    SQL_ITEM
    + f""",
paired AS (
  SELECT i.vec_id, r.category AS nearest, sqrt((i.x - r.x)^2 + (i.y - r.y)^2 + (i.z - r.z)^2) AS dist
  FROM item i JOIN reference r USING (cluster)),
closest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nearest) AS rn FROM paired) WHERE rn = 1),
matched_item AS (
  SELECT i.*, c.nearest, c.dist, coalesce(c.dist <= {TOLERANCE}, false) AS matched,
    CASE WHEN c.dist <= {TOLERANCE} THEN c.nearest <> i.category END AS wrong,
    EXISTS (SELECT 1 FROM reference r WHERE r.cluster = i.cluster AND r.category = i.category) AS present
  FROM item i LEFT JOIN closest c USING (vec_id))"""
)


def analysis_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items matched, ordered, phased: what every rule and evaluation reads."""
    rows = items(spark, sf)
    ref = reference_points(rows)
    # written once: the steps below count groups before they choose a plan
    out = cut(match(rows, ref, ["cluster"], ["x", "y", "z"], "category", "category", TOLERANCE))
    out = has_own(out, ref, ["cluster", "category"])
    out = cut(detection_order(out, ["cluster"], "z", "vec_id"))
    phases = R.phase_estimate(out, ["cluster"]).select("cluster", "phase")
    return out.join(small(phases), "cluster")


def _conf(channel: str) -> str:
    """SQL of the confidence formula on a 0-based channel number."""
    c = f"({channel})"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN 0.2::DOUBLE * m[{c} + 1] + 0.5::DOUBLE * q[{c} + 1]"
        f" + 0.3::DOUBLE * least(1.0::DOUBLE, g[{c} + 1] / greatest(1, n_cells)) END"
    )


_PLACE = (
    "CASE WHEN category IN ('T13', 'L6', 'COCCYX') THEN NULL WHEN category LIKE 'C%' THEN substr(category, 2)::INT - 1"
    " WHEN category LIKE 'T%' THEN substr(category, 2)::INT + 6 WHEN category LIKE 'L%' THEN substr(category, 2)::INT + 18 END"
)


def _parity(place: str) -> str:
    return f"CASE WHEN category = 'SACRUM' THEN 8 WHEN ({place}) IS NULL THEN NULL WHEN ({place}) % 2 = 0 THEN 6 ELSE 7 END"


SQL_RULES = (
    SQL_MATCH
    + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, vec_id) - 1 AS seq FROM matched_item),
phases AS (
  SELECT cluster, sum(m[({_parity('seq')}) + 1]) AS total_0, sum(m[({_parity('seq + 1')}) + 1]) AS total_1
  FROM placed GROUP BY cluster),
ready AS (SELECT p.*, CASE WHEN total_1 > total_0 THEN 1 ELSE 0 END AS phase FROM placed p JOIN phases USING (cluster)),
wide AS (
  SELECT *,
    {_conf("CASE substr(category, 1, 1) WHEN 'C' THEN 6 WHEN 'T' THEN 7 WHEN 'L' THEN 8 ELSE 9 END")} AS region_retired,
    {_conf(_parity(_PLACE))} AS parity_name,
    {_conf("CASE WHEN category LIKE 'S%' THEN 8 WHEN category = 'COCCYX' THEN NULL WHEN try_cast(substr(category, 2) AS INT) % 2 = 1 THEN 6 ELSE 7 END")} AS parity_region_deployed,
    {_conf(_parity('seq'))} AS parity_sequence,
    {_conf(_parity('seq + 1'))} AS parity_sequence_inverted,
    {_conf(_parity('seq + phase'))} AS parity_sequence_phased,
    list_max(m) AS mapping_free_top1,
    list_max(m) - list_reverse_sort(m)[2] AS mapping_free_margin,
    {_conf('list_position(m, list_max(m)) - 1')} AS argmax_mean
  FROM ready),
long_rule AS (
  """
    + "\n  UNION ALL ".join(
        f"SELECT vec_id, cluster, category, matched, present, wrong, '{r}' AS rule, {r} AS score FROM wide" for r in R.RULES
    )
    + ")"
)

SCENARIOS_SQL = """
scenario_rows AS (
  SELECT *, 'as_published' AS scenario, wrong AS err FROM {src} WHERE matched
  UNION ALL SELECT *, 'worst_case', CASE WHEN matched THEN wrong ELSE true END FROM {src}
  UNION ALL SELECT *, 'best_case', CASE WHEN matched THEN wrong ELSE false END FROM {src}
  UNION ALL SELECT *, 'absent_level', CASE WHEN matched THEN wrong ELSE true END FROM {src} WHERE matched OR NOT present),
scenario_scored AS (SELECT * EXCLUDE (wrong, err), err AS wrong FROM scenario_rows)"""


def item_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every item under every rule."""
    keep = ["vec_id", "cluster", "category", "matched", "present", "wrong", "n_cells", "seq", "phase", "channels"]
    return R.score_rules(analysis_items(spark, sf).select(*keep)).drop("n_cells", "seq", "phase")


def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores that know no rule: inverse entropy, size regularity, spacing regularity.

    The regularities are rounded to nine places so that equal ratios tie.
    """
    rows = cut(analysis_items(spark, sf))
    sure = mapping_free(rows.withColumn("p", F.transform("channels", lambda c: c["mean"])), ["vec_id"], "p")
    sized = neighbour_ratio(rows, ["cluster"], ["seq"], "n_cells").select("vec_id", F.round("ratio_score", 9).alias("size_regularity"))
    gap = Gap(["x", "y", "z"], lambda a, b: distance([b[c] for c in "xyz"], [a[c] for c in "xyz"]))
    spaced = spacing_regularity(rows, ["cluster"], ["seq"], gap).select("vec_id", F.round("spacing_score", 9).alias("spacing_regularity"))
    out = rows.join(sure.select("vec_id", "entropy_inv"), "vec_id").join(sized, "vec_id").join(spaced, "vec_id")
    return out.select("vec_id", "cluster", "category", "matched", "present", "wrong", "entropy_inv", "size_regularity", "spacing_regularity")


SQL_REFERENCE = (
    SQL_RULES
    + """,
clipped AS (SELECT vec_id, list_transform(m, lambda p: greatest(1e-12::DOUBLE, least(1.0::DOUBLE, p))) AS c FROM item),
normed AS (SELECT vec_id, list_transform(c, lambda p: p / list_sum(c)) AS c FROM clipped),
sure AS (SELECT vec_id, 1 + list_sum(list_transform(c, lambda p: p * ln(p))) / ln(11::DOUBLE) AS entropy_inv FROM normed),
around AS (
  SELECT a.vec_id, a.n_cells AS v, median(b.n_cells::DOUBLE) AS med FROM ready a
  LEFT JOIN ready b ON a.cluster = b.cluster AND abs(a.seq - b.seq) BETWEEN 1 AND 2 AND b.n_cells > 0
  GROUP BY a.vec_id, a.n_cells),
gaps AS (
  SELECT vec_id, cluster, seq, sqrt((lead(x) OVER w - x)^2 + (lead(y) OVER w - y)^2 + (lead(z) OVER w - z)^2) AS gap
  FROM ready WINDOW w AS (PARTITION BY cluster ORDER BY seq)),
gap2 AS (
  SELECT *, lag(gap) OVER (PARTITION BY cluster ORDER BY seq) AS before,
    median(gap) OVER (PARTITION BY cluster) AS med, count(*) OVER (PARTITION BY cluster) AS n FROM gaps),
spaced AS (
  SELECT vec_id, CASE WHEN n >= 3 AND med > 0 THEN -greatest(coalesce(abs(ln(CASE WHEN gap IS NOT NULL THEN greatest(gap, 1e-6) END / med)), 0),
    coalesce(abs(ln(CASE WHEN before IS NOT NULL THEN greatest(before, 1e-6) END / med)), 0)) END AS spacing_regularity FROM gap2),
reference_wide AS (
  SELECT r.vec_id, r.cluster, r.matched, r.present, r.wrong, entropy_inv,
    CASE WHEN v > 0 AND a.med IS NOT NULL THEN round(-abs(ln(v / a.med)), 9) END AS size_regularity, round(spacing_regularity, 9) AS spacing_regularity
  FROM ready r JOIN sure USING (vec_id) JOIN around a USING (vec_id) JOIN spaced USING (vec_id)),
reference_long AS (
  SELECT vec_id, cluster, matched, present, wrong, 'entropy_inv' AS rule, entropy_inv AS score FROM reference_wide
  UNION ALL SELECT vec_id, cluster, matched, present, wrong, 'size_regularity', size_regularity FROM reference_wide
  UNION ALL SELECT vec_id, cluster, matched, present, wrong, 'spacing_regularity', spacing_regularity FROM reference_wide)"""
)

# ---- centres for curve checks: an order's lines, averaged per line number; lines 1-4 and 5-7 are regions


def centers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("ord")).agg(
        F.avg("l_quantity").alias("x"), F.avg(F.col("l_extendedprice") / 997).alias("y")
    ).withColumn("region", F.when(F.col("ord") <= 4, "A").otherwise("B"))


SQL_CENTERS = """
centers AS (
  SELECT l_orderkey AS cluster, l_linenumber AS ord, CASE WHEN l_linenumber <= 4 THEN 'A' ELSE 'B' END AS region,
    avg(l_quantity) AS x, avg(l_extendedprice / 997) AS y FROM lineitem GROUP BY ALL)"""


def sql_residuals(source: str, keys: str) -> str:
    """CTEs ending in ``resid``: straight-line residuals, in sample and leave-one-out."""
    on = " AND ".join(f"i.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    ik = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    return f"""
sized AS (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_all, count(*) OVER (PARTITION BY {keys}, region) AS region_size,
    row_number() OVER (PARTITION BY {keys}, region ORDER BY ord) - 1 AS idx FROM {source}),
placed_item AS (
  SELECT *, CASE WHEN region_size >= 4 THEN 'region' ELSE 'global' END AS scope,
    CASE WHEN region_size >= 4 THEN region_size ELSE n_all END AS n_fit FROM sized),
fits AS (
  SELECT {ik}, i.ord AS item, m.ord, m.x, m.y, loo FROM placed_item i JOIN placed_item m ON {on},
    (SELECT unnest([0, 1]) AS loo) WHERE (i.scope = 'global' OR m.region = i.region) AND (loo = 0 OR m.ord <> i.ord)),
steps AS (
  SELECT *, coalesce(sqrt((x - lag(x) OVER w)^2 + (y - lag(y) OVER w)^2), 0) AS d FROM fits
  WINDOW w AS (PARTITION BY {keys}, item, loo ORDER BY ord)),
chords AS (
  SELECT *, sum(d) OVER (PARTITION BY {keys}, item, loo ORDER BY ord) AS run,
    sum(d) OVER (PARTITION BY {keys}, item, loo) AS tot, count(*) OVER (PARTITION BY {keys}, item, loo) AS m FROM steps),
lines AS (
  SELECT {keys}, item AS ord, loo, regr_slope(x, run / tot) AS bx, regr_intercept(x, run / tot) AS ax,
    regr_slope(y, run / tot) AS by_, regr_intercept(y, run / tot) AS ay,
    sqrt(greatest(regr_syy(x, run / tot) - coalesce(regr_sxy(x, run / tot)^2 / nullif(regr_sxx(x, run / tot), 0), 0), 0) / count(*)) AS rms_x,
    sqrt(greatest(regr_syy(y, run / tot) - coalesce(regr_sxy(y, run / tot)^2 / nullif(regr_sxx(y, run / tot), 0), 0), 0) / count(*)) AS rms_y
  FROM chords WHERE tot > 0 AND m >= 4 GROUP BY {keys}, item, loo),
near AS (
  SELECT l.*, p.x, p.y, round_even(least(1, greatest(0, coalesce(((p.x - ax) * bx + (p.y - ay) * by_) / nullif(bx^2 + by_^2, 0), 0))) * 999, 0) / 999 AS t
  FROM lines l JOIN placed_item p USING ({keys}, ord)),
dists AS (SELECT *, sqrt((x - ax - bx * t)^2 + (y - ay - by_ * t)^2) AS dist FROM near),
resid AS (
  SELECT p.*, a.dist AS residual, b.dist AS loo_residual, CASE WHEN scope = 'region' THEN a.dist ELSE b.dist END AS deployed_residual,
    a.rms_x, a.rms_y, (idx = 0 OR idx = region_size - 1) AS endpoint
  FROM placed_item p LEFT JOIN dists a ON a.loo = 0 AND {on.replace('i.', 'p.').replace('m.', 'a.')} AND a.ord = p.ord
  LEFT JOIN dists b ON b.loo = 1 AND {on.replace('i.', 'p.').replace('m.', 'b.')} AND b.ord = p.ord)"""


def sql_cubic_residuals(source: str, keys: str) -> str:
    """CTEs ending in ``resid`` as ``sql_residuals``, with cubics: orthogonal polynomials by recurrence, 1000 samples."""
    line = sql_residuals(source, keys)
    head, tail = line[: line.index("lines AS (")], line[line.index("resid AS (") :]
    own = f"PARTITION BY {keys}, item, loo"

    def over(size: str) -> str:
        return f"CASE WHEN {size} > 1e-12 THEN 1 / {size} ELSE 0 END"

    def term(axis: str) -> str:
        q2 = "(s - a1) * (s - a0) - b1"
        q3 = f"((s - a2) * ({q2}) - b2 * (s - a0))"
        return f"{axis}0 + {axis}1 * (s - a0) + {axis}2 * ({q2}) + {axis}3 * {q3}"

    sums = ", ".join(f"sum({a} * q{i}) * any_value(i{i}) AS {a}{i}" for a in "xy" for i in range(4))
    fit = {a: " + ".join(f"{a}{i} * q{i}" for i in range(4)) for a in "xy"}
    on = " AND ".join(f"c.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return (
        head
        + f"""
p0 AS (SELECT {keys}, item, loo, x, y, run / tot AS t, m, 1.0::DOUBLE AS q0, 1 / m::DOUBLE AS i0 FROM chords WHERE tot > 0 AND m >= 4),
p1 AS (SELECT *, t - a0 AS q1 FROM (SELECT *, avg(t) OVER ({own}) AS a0 FROM p0)),
p2 AS (SELECT *, (t - a1) * q1 - b1 AS q2 FROM (SELECT *, tq1 * i1 AS a1, n1 * i0 AS b1 FROM (SELECT *, {over('n1')} AS i1 FROM (
  SELECT *, sum(q1 * q1) OVER ({own}) AS n1, sum(t * q1 * q1) OVER ({own}) AS tq1 FROM p1)))),
p3 AS (SELECT *, (t - a2) * q2 - b2 * q1 AS q3 FROM (SELECT *, tq2 * i2 AS a2, n2 * i1 AS b2 FROM (SELECT *, {over('n2')} AS i2 FROM (
  SELECT *, sum(q2 * q2) OVER ({own}) AS n2, sum(t * q2 * q2) OVER ({own}) AS tq2 FROM p2)))),
p4 AS (SELECT *, {over('n3')} AS i3 FROM (SELECT *, sum(q3 * q3) OVER ({own}) AS n3 FROM p3)),
cubics AS (SELECT {keys}, item, loo, any_value(a0) AS a0, any_value(a1) AS a1, any_value(b1) AS b1, any_value(a2) AS a2, any_value(b2) AS b2, {sums} FROM p4 GROUP BY {keys}, item, loo),
spreads AS (SELECT {', '.join('q.' + k.strip() for k in keys.split(','))}, q.item, q.loo, sqrt(avg((q.x - ({fit['x'].replace('x', 'c.x').replace('q', 'q.q')}))^2)) AS rms_x, sqrt(avg((q.y - ({fit['y'].replace('y', 'c.y').replace('q', 'q.q')}))^2)) AS rms_y
  FROM p4 q JOIN cubics c ON {on} AND c.item = q.item AND c.loo = q.loo GROUP BY ALL),
dists AS (SELECT c.*, c.item AS ord, rms_x, rms_y, sqrt(list_min(list_transform(range(1000), lambda i: (p.x - ({term('c.x').replace('(s ', '(i / 999.0::DOUBLE ')}))^2 + (p.y - ({term('c.y').replace('(s ', '(i / 999.0::DOUBLE ')}))^2))) AS dist
  FROM cubics c JOIN (SELECT *, ord AS item FROM placed_item) p USING ({keys}, item) JOIN spreads USING ({keys}, item, loo)),
"""
        + tail
    )


SQL_PRESETS = """
rules AS (SELECT * FROM (VALUES ('deployed', 'z', 1.5::DOUBLE, 0.1::DOUBLE, 0::DOUBLE), ('guarded', 'z', 1.5, 1.0, 3.0),
  ('loo', 'z_loo', 1.5, 1.0, 3.0), ('loo_raw', 'z_loo', 1.5, 1.0, 0.0)) AS v(rule, uses, threshold, std_floor, least_mm))"""


def sql_tested(keys: str) -> str:
    """CTE ``tested``: residuals under each preset, after ``resid`` and ``rules``."""
    return f"""
standard AS (
  SELECT r.*, u.*,
    CASE WHEN count(residual) OVER w >= 2 THEN (residual - avg(residual) OVER w) / greatest(stddev_pop(residual) OVER w, std_floor) END AS z,
    CASE WHEN count(loo_residual) OVER w >= 2 THEN (loo_residual - avg(loo_residual) OVER w) / greatest(stddev_pop(loo_residual) OVER w, std_floor) END AS z_loo
  FROM resid r, rules u WINDOW w AS (PARTITION BY {keys}, rule)),
tested_0 AS (
  SELECT *, round(CASE WHEN uses = 'z' THEN z ELSE z_loo END, 9) AS tested, CASE WHEN uses = 'z' THEN residual ELSE loo_residual END AS tested_mm FROM standard),
tested AS (SELECT *, coalesce(tested > threshold AND tested_mm >= least_mm, false) AS flagged FROM tested_0)"""


SQL_VARIANTS = (
    SQL_CENTERS
    + """,
nb AS (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS bx, lag(y) OVER w AS by_,
    row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY cluster) AS n FROM centers
  WINDOW w AS (PARTITION BY cluster ORDER BY ord)),
mids AS (SELECT *, n // 2 AS mid FROM nb),
variants AS (
  SELECT 'clean' AS variant, cluster, ord, region, x, y, false AS perturbed, false AS site FROM mids
  UNION ALL SELECT 'level_shift', cluster, ord, region, CASE WHEN pos >= mid THEN nx ELSE x END, CASE WHEN pos >= mid THEN ny ELSE y END, pos >= mid, pos = mid
    FROM mids WHERE NOT (pos >= mid AND pos = n - 1)
  UNION ALL SELECT 'off_by_one', cluster, ord, region, nx, ny, true, pos = 0 FROM mids WHERE pos < n - 1
  UNION ALL SELECT 'swap', cluster, ord, region, CASE WHEN pos = mid THEN nx WHEN pos = mid + 1 THEN bx ELSE x END,
    CASE WHEN pos = mid THEN ny WHEN pos = mid + 1 THEN by_ ELSE y END, pos IN (mid, mid + 1), pos = mid FROM mids WHERE mid + 1 < n
  UNION ALL SELECT 'offset', cluster, ord, region, CASE WHEN pos = mid THEN x + 10 ELSE x END, y, pos = mid, pos = mid FROM mids)"""
)
