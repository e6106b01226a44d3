"""Aggregations: summaries, overlaps, profiles, logs and delivery."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallyframe.functions.columns import count_if, r6
from tallyframe.functions.ordered import Grouped
from tallyframe.operators import diffs as D
from tallyframe.operators import logs as L
from tallyframe.operators import profiling as P
from tallyframe.operators import reductions as A
from tallyframe.operators.matching import identification_hits, label_distance
from tallyframe.operators.rules import channel_by_name, channel_by_number, level_name, normalise_category
from tallyframe.operators.sequences import log_sessions
from tallyframe.plans.base import SQL_MATCH, SQL_RULES, _PLACE, _parity, analysis_items, items, rounded
from tallyframe.plans.joins import AXES, SQL_HITS, landmarks
from tallyframe.plans.registry import query
from tallyframe.plans.scans import LINE_SHAPES
from tallyframe.sources.tables import table
from tallyframe.session import shared_path
from tallyframe.streaming.progress import latest_progress, run_progress_stream


@query("label_histogram", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def label_histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "channel_statistics",
    """
SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS p75,
  round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS max, min(l_quantity) AS min, round(stddev_pop(l_quantity), 6) AS std,
  (count(*) FILTER (WHERE l_quantity > 35))::BIGINT AS n_high FROM lineitem GROUP BY 1""",
)
def channel_statistics(spark, sf):
    return A.channel_statistics(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 35.0)


@query(
    "centroids",
    """
WITH c AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS x, avg(embedding[2]::DOUBLE) AS y, avg(embedding[3]::DOUBLE) AS z FROM embeddings GROUP BY 1)
SELECT label::BIGINT AS label, n::BIGINT AS n_cells, round(x, 6) AS c_x, round(y, 6) AS c_y, round(z, 6) AS c_z, round(5 - 10 * x, 6) AS world_x FROM c""",
)
def centroids(spark, sf):
    out = A.centroids(items(spark, sf).select(F.col("cluster").cast("bigint").alias("label"), *AXES), ["label"], AXES)
    return rounded(out.withColumn("world_x", 5 - 10 * F.col("c_x")), "c_x", "c_y", "c_z", "world_x")


@query(
    "modal_class",
    """
WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS v, count(*) AS c FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL)
SELECT l_orderkey, arg_max(v, (c, v))::BIGINT AS modal, max(c)::BIGINT AS n_modal FROM c GROUP BY 1""",
)
def modal_class(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("bigint").alias("v"))
    return A.modal_class(rows, ["l_orderkey"], "v")


@query(
    "mapping_free",
    """
WITH c AS (SELECT label, list_transform(embedding, lambda p: greatest(1e-12::DOUBLE, least(1.0::DOUBLE, abs(p::DOUBLE)))) AS c FROM embeddings),
q AS (SELECT label, list_transform(c, lambda p: p / list_sum(c)) AS q FROM c),
s AS (SELECT label, list_max(q) AS top1, list_reverse_sort(q)[2] AS top2, -list_sum(list_transform(q, lambda p: p * ln(p))) / ln(len(q)) AS ent,
  list_position(q, list_max(q)) - 1 AS arg FROM q),
m AS (SELECT label, arg, count(*) AS c FROM s GROUP BY ALL),
b AS (SELECT label, arg_max(arg, (c, -arg)) AS modal, max(c) AS c FROM m GROUP BY 1)
SELECT label::BIGINT AS label, round(avg(top1 - top2), 6) AS margin, round(1 - avg(ent), 6) AS entropy_inv, round(avg(top1), 6) AS top1,
  round(any_value(b.c) / count(*), 6) AS agree, any_value(modal)::BIGINT AS modal_channel FROM s JOIN b USING (label) GROUP BY 1""",
)
def mapping_free(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    out = A.mapping_free(vec.withColumn("p", F.transform("e", F.abs)), ["label"], "p")
    out = out.withColumn("modal_channel", F.col("modal_channel").cast("bigint"))
    return rounded(out, "margin", "entropy_inv", "top1", "agree")


SPECIAL = {"has_7": 7, "has_1": 1}


def line_region(col):
    return F.when(col <= 2, "C").when(col <= 4, "T").when(col <= 6, "L").otherwise("S")


@query(
    "composition",
    """
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS v FROM lineitem)
SELECT l_orderkey, count(*)::BIGINT AS n_labels, string_agg(v::VARCHAR, ',' ORDER BY v) AS labels,
  CASE WHEN bool_or(v <= 2) THEN 'C' ELSE '' END || CASE WHEN bool_or(v IN (3, 4)) THEN 'T' ELSE '' END
  || CASE WHEN bool_or(v IN (5, 6)) THEN 'L' ELSE '' END || CASE WHEN bool_or(v = 7) THEN 'S' ELSE '' END AS regions,
  bool_or(v = 7) AS has_7, bool_or(v = 1) AS has_1 FROM p GROUP BY 1""",
)
def composition(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return P.composition(rows, ["l_orderkey"], "l_linenumber", line_region(F.col("l_linenumber")), ["C", "T", "L", "S"], SPECIAL)


@query(
    "pair_availability",
    """
WITH s AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS a1, bool_or(l_linenumber = 2) AS a2, bool_or(l_linenumber = 3) AS a3,
  bool_or(l_linenumber = 6) AS a6, bool_or(l_linenumber = 7) AS a7 FROM lineitem GROUP BY 1)
SELECT '1-2' AS pair, (count(*) FILTER (WHERE a1 AND a2))::BIGINT AS n_strict, (count(*) FILTER (WHERE a1 AND a2))::BIGINT AS n_lenient, count(*)::BIGINT AS n_clusters FROM s
UNION ALL SELECT '2-3', count(*) FILTER (WHERE a2 AND a3), count(*) FILTER (WHERE a2 AND a3), count(*) FROM s
UNION ALL SELECT '6-7', count(*) FILTER (WHERE a6 AND a7), count(*) FILTER (WHERE a6), count(*) FROM s
UNION ALL SELECT '(none)', count(*) FILTER (WHERE NOT (a1 AND a2 OR a2 AND a3 OR a6 AND a7)), count(*) FILTER (WHERE NOT (a1 AND a2 OR a2 AND a3 OR a6)), count(*) FROM s""",
)
def pair_availability(spark, sf):
    pairs = [("1-2", 1, 2, True), ("2-3", 2, 3, True), ("6-7", 6, 7, False)]
    return P.pair_availability(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", pairs)


@query(
    "prevalence",
    """
SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_clusters, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS "of",
  round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM events GROUP BY 1""",
)
def prevalence(spark, sf):
    return rounded(P.prevalence(table(spark, sf, "events"), "user_id", "event_type"), "share")


@query(
    "index_quartiles",
    """
WITH c AS (SELECT count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY l_orderkey),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT max(n)::BIGINT AS n, min(v)::BIGINT AS least, max(v) FILTER (WHERE i = n // 4)::BIGINT AS q1, max(v) FILTER (WHERE i = n // 2)::BIGINT AS q2,
  max(v) FILTER (WHERE i = 3 * n // 4)::BIGINT AS q3, max(v)::BIGINT AS most, round(avg(v), 6) AS mean, sum(v)::BIGINT AS total FROM r""",
)
def index_quartiles(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    sizes = pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("v"))
    return rounded(A.index_quartiles(sizes, "v"), "mean")


@query(
    "top_common",
    """SELECT l_returnflag, l_linenumber::BIGINT AS l_linenumber, l_discount, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 8""",
)
def top_common(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_discount")
    return P.top_common(rows, ["l_returnflag", "l_linenumber", "l_discount"])


@query(
    "count_mismatch",
    """
SELECT l_orderkey, count(*)::BIGINT AS n_items, max(l_linenumber)::BIGINT AS n_listed FROM lineitem GROUP BY 1 HAVING count(*) <> max(l_linenumber)""",
)
def count_mismatch(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey")
    a = lines.agg(F.count(F.lit(1)).alias("n_items"))
    b = lines.agg(F.max("l_linenumber").cast("bigint").alias("n_listed"))
    return P.count_mismatch(a, b, ["l_orderkey"], "n_items", "n_listed")


def order_masks(spark, sf):
    """Two masks per supplier: which (part, line) cells the R lines and the non-F lines mark, with a label."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cluster"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("y"), "l_returnflag", "l_linestatus", "l_quantity"
    )
    label = F.pmod(F.max("l_quantity").cast("int"), F.lit(3)) + 1
    a = rows.filter("l_returnflag <> 'A'").groupBy("cluster", "x", "y").agg(label.alias("label"))
    b = rows.filter("l_linestatus = 'O'").groupBy("cluster", "x", "y").agg(label.alias("label"))
    return a, b


@query(
    "dice",
    """
WITH a AS (SELECT l_suppkey AS cluster, l_partkey AS x, l_linenumber AS y, max(l_quantity)::INT % 3 + 1 AS label FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
b AS (SELECT l_suppkey AS cluster, l_partkey AS x, l_linenumber AS y, max(l_quantity)::INT % 3 + 1 AS label FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
f AS (SELECT cluster, count(a.label) AS na, count(b.label) AS nb, count(a.label + b.label) AS i FROM a FULL JOIN b USING (cluster, x, y) GROUP BY 1),
l AS (SELECT na.cluster, na.label, 2 * coalesce(i, 0) / (na.n + coalesce(nb.n, 0))::DOUBLE AS d FROM (SELECT cluster, label, count(*) AS n FROM a GROUP BY ALL) na
  LEFT JOIN (SELECT cluster, label, count(*) AS n FROM b GROUP BY ALL) nb USING (cluster, label)
  LEFT JOIN (SELECT a.cluster, a.label, count(*) AS i FROM a JOIN b USING (cluster, x, y, label) GROUP BY ALL) ni USING (cluster, label))
SELECT f.cluster, round(coalesce(2 * i / nullif(na + nb, 0)::DOUBLE, 1.0), 6) AS dice_fg, round((SELECT avg(d) FROM l WHERE l.cluster = f.cluster), 6) AS dice_label_mean FROM f""",
)
def dice(spark, sf):
    a, b = order_masks(spark, sf)
    fore, per = A.dice(a, b, ["cluster"], ["x", "y"], "label")
    mean = per.groupBy("cluster").agg(r6(F.avg("dice")).alias("dice_label_mean"))
    return rounded(fore.join(mean, "cluster", "left"), "dice_fg")


# masks: a cell is an item; the reference marks every cell with its level, the prediction those it has seen
SQL_POOLED = (
    SQL_HITS
    + """,
h AS (SELECT h.cluster, h.label, h.hit, CASE WHEN g.x IS NOT NULL THEN sqrt((g.x - t.x)^2 + (g.y - t.y)^2 + (g.z - t.z)^2) END AS dist
  FROM hits h JOIN truth t ON t.cluster IS NOT DISTINCT FROM h.cluster AND t.label IS NOT DISTINCT FROM h.label
  LEFT JOIN guess g ON g.cluster = h.cluster AND g.label = h.label),
p AS (SELECT cluster, label, grouping_id(cluster, label) AS grain, count(hit) AS n, coalesce(sum(hit), 0) AS hits, sum(hit) / count(hit) AS rate,
  avg(dist) FILTER (WHERE NOT isnan(dist)) AS mean_dist FROM h GROUP BY GROUPING SETS ((), (cluster), (label))),
a AS (SELECT cluster, vec_id, min(code) AS label FROM item GROUP BY ALL),
b AS (SELECT cluster, vec_id, min(code) AS label FROM item WHERE seen GROUP BY ALL),
m AS (SELECT cluster, a.label AS la, b.label AS lb FROM a FULL JOIN b USING (cluster, vec_id)),
f AS (SELECT cluster, coalesce(2 * count(la + lb) / nullif(count(la) + count(lb), 0)::DOUBLE, 1.0) AS dice_fg FROM m GROUP BY 1),
l AS (SELECT na.cluster, avg(2 * i / (na.n + coalesce(nb.n, 0))::DOUBLE) AS dice_label
  FROM (SELECT cluster, la AS label, count(*) AS n, count(*) FILTER (WHERE lb = la) AS i FROM m WHERE la IS NOT NULL GROUP BY ALL) na
  LEFT JOIN (SELECT cluster, lb AS label, count(*) AS n FROM m WHERE lb IS NOT NULL GROUP BY ALL) nb ON nb.cluster IS NOT DISTINCT FROM na.cluster AND nb.label = na.label
  GROUP BY 1),
c AS (SELECT p.*, dice_fg, dice_label FROM p JOIN f ON f.cluster IS NOT DISTINCT FROM p.cluster LEFT JOIN l ON l.cluster IS NOT DISTINCT FROM p.cluster WHERE grain = 1),
u AS (SELECT 3 AS grain, count(*) AS n_cases, avg(rate) AS mean_rate, median(rate) AS median_rate, avg(mean_dist) AS mean_case_dist,
  avg(dice_fg) AS dice_fg, median(dice_fg) AS median_dice_fg, avg(dice_label) AS dice_label, median(dice_label) AS median_dice_label FROM c),
v AS (SELECT code AS label, min(category) AS name FROM item GROUP BY 1)"""
)


@query(
    "pooled_rates",
    "WITH"
    + SQL_POOLED
    + """
SELECT p.cluster::BIGINT AS cluster, p.label::BIGINT AS label, v.name, p.grain::BIGINT AS grain, p.n::BIGINT AS n, p.hits::BIGINT AS hits,
  round(p.rate, 6) AS rate, round(p.mean_dist, 6) AS mean_dist, n_cases::BIGINT AS n_cases, round(mean_rate, 6) AS mean_rate, round(median_rate, 6) AS median_rate,
  round(mean_case_dist, 6) AS mean_case_dist, round(coalesce(u.dice_fg, c.dice_fg), 6) AS dice_fg, round(median_dice_fg, 6) AS median_dice_fg,
  round(coalesce(u.dice_label, c.dice_label), 6) AS dice_label, round(median_dice_label, 6) AS median_dice_label
FROM p LEFT JOIN u ON u.grain = p.grain LEFT JOIN c ON c.grain = p.grain AND c.cluster IS NOT DISTINCT FROM p.cluster LEFT JOIN v ON v.label = p.label AND p.grain = 2""",
)
def pooled_rates(spark, sf):
    truth, guess = landmarks(spark, sf)
    keys = ["cluster", "label"]
    hits = identification_hits(truth, guess, ["cluster"], AXES, "label")
    rows = hits.join(label_distance(truth, guess, keys, AXES), keys, "left")
    marks = items(spark, sf).groupBy("cluster", "vec_id").agg(F.min("code").alias("label"), F.bool_or("seen").alias("seen"))
    fore, per = A.dice(marks.drop("seen"), marks.filter("seen").drop("seen"), ["cluster"], ["vec_id"], "label")
    out = A.pooled_rates(rows, fore, per, "cluster", "label")
    out = out.withColumn("name", F.coalesce(normalise_category(level_name(F.col("label"))), F.col("label").cast("string")))
    out = out.withColumns({c: F.col(c).cast("bigint") for c in keys})
    means = ["rate", "mean_dist", "mean_rate", "median_rate", "mean_case_dist", "dice_fg", "median_dice_fg", "dice_label", "median_dice_label"]
    return rounded(out, *means)


@query(
    "pooled_case_rates",
    "WITH"
    + SQL_HITS
    + """
SELECT count(*)::BIGINT AS n_cases, round(avg(r), 6) AS mean_rate, round(median(r), 6) AS median_rate FROM (SELECT cluster, avg(hit) AS r FROM hits GROUP BY 1)""",
)
def pooled_case_rates(spark, sf):
    truth, guess = landmarks(spark, sf)
    hits = identification_hits(truth, guess, ["cluster"], AXES, "label")
    per = hits.groupBy("cluster").agg(F.avg("hit").alias("r"))
    mid = Grouped(per, []).quantiles("r", {"median_rate": 0.5})
    return per.agg(
        F.count(F.lit(1)).alias("n_cases"), r6(F.avg("r")).alias("mean_rate"), r6(mid.select("median_rate").scalar()).alias("median_rate")
    )


@query(
    "run_progress",
    """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, max(value) AS wall FROM events GROUP BY 1),
a AS (SELECT count(*) AS n, avg(wall) AS mean, median(wall) AS med, max(wall) AS mx FROM l)
SELECT status, count(*)::BIGINT AS n, round(count(*) / any_value(a.n), 6) AS share, round(any_value(mean), 6) AS mean_wall, round(any_value(med), 6) AS median_wall,
  any_value(mx) AS max_wall, greatest(0, 5000 - any_value(a.n))::BIGINT AS remaining, round(greatest(0, 5000 - any_value(a.n)) * any_value(med) / 3600, 6) AS remaining_hours
FROM l, a GROUP BY status""",
)
def run_progress(spark, sf):
    latest = table(spark, sf, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_type")).alias("status"), F.max("value").alias("wall")
    )
    out = P.run_progress(latest, "user_id", "status", "wall", F.lit(5000))
    return rounded(out, "share", "mean_wall", "median_wall", "max_wall", "remaining_hours")


SQL_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^ *$') THEN 'empty' WHEN regexp_matches(line, 'https?://') THEN 'link'
  WHEN regexp_matches(line, '[0-9]') THEN 'digits' WHEN regexp_matches(line, '[{}=;]') THEN 'code'
  WHEN regexp_matches(line, '\\.$') THEN 'sentence' WHEN regexp_matches(line, '^[A-Za-z ]+$') THEN 'plain' ELSE 'other' END AS kind FROM l)"""


def doc_findings(spark, sf):
    lines = L.split_lines(table(spark, sf, "documents"), ["doc_id"], "text")
    kind = F.coalesce(L.classify(F.col("line"), LINE_SHAPES), F.lit("other"))
    return lines.select("doc_id", "line_no", "line", kind.alias("kind"))


@query(
    "files_affected",
    SQL_LINES
    + """ SELECT kind, count(DISTINCT doc_id)::BIGINT AS files, (SELECT count(*) FROM documents)::BIGINT AS "of",
  round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS share FROM c GROUP BY 1""",
)
def files_affected(spark, sf):
    total = table(spark, sf, "documents").select(F.count(F.lit(1))).scalar()
    return rounded(L.files_affected(doc_findings(spark, sf), "doc_id", "kind", total), "share")


@query(
    "clean_files",
    SQL_LINES
    + """,
t AS (SELECT doc_id, min(kind) FILTER (WHERE kind IN ('plain', 'sentence')) AS type, bool_or(kind IN ('link', 'code')) AS dirty FROM c GROUP BY 1)
SELECT coalesce(type, '(unrecognised)') AS type, count(*)::BIGINT AS files, (count(*) FILTER (WHERE NOT coalesce(dirty, false)))::BIGINT AS clean
FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1""",
)
def clean_files(spark, sf):
    found = doc_findings(spark, sf)
    named = found.select(
        "doc_id",
        F.when(F.col("kind").isin("plain", "sentence"), "type").when(F.col("kind").isin("link", "code"), "error").otherwise("warning").alias("kind"),
        F.col("kind").alias("name"),
    )
    return L.type_census(table(spark, sf, "documents"), named, "doc_id")


@query(
    "checker_agreement",
    """
WITH r AS (SELECT n_chars >= 500 AND text NOT LIKE '%http%' AS a, quality = 1 AS b FROM documents JOIN labels USING (doc_id))
SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE a))::BIGINT AS ok_first, (count(*) FILTER (WHERE b))::BIGINT AS ok_second,
  (count(*) FILTER (WHERE a <> b))::BIGINT AS disagree FROM r""",
)
def checker_agreement(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return L.checker_agreement(rows, (F.col("n_chars") >= 500) & ~F.col("text").contains("http"), F.col("quality") == 1)


@query(
    "finding_sets",
    """
SELECT finding_set, count(*)::BIGINT AS objects FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS finding_set FROM orders GROUP BY 1) GROUP BY 1""",
)
def finding_sets(spark, sf):
    return L.finding_sets(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query(
    "digest_classes",
    "SELECT sha256(text) AS digest, count(*)::BIGINT AS members, min(doc_id) AS first_member FROM documents GROUP BY 1",
)
def digest_classes(spark, sf):
    return D.digest_classes(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(
    "errors_per_category",
    "WITH"
    + SQL_MATCH
    + """ SELECT category, count(*)::BIGINT AS n, (count(*) FILTER (WHERE wrong))::BIGINT AS n_wrong,
  row_number() OVER (ORDER BY substr(category, 1, 1), coalesce(try_cast(nullif(regexp_replace(category, '[^0-9]', '', 'g'), '') AS BIGINT), 0), category)::BIGINT AS place
FROM matched_item WHERE matched GROUP BY 1""",
)
def errors_per_category(spark, sf):
    rows = analysis_items(spark, sf).filter("matched")
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("wrong")).alias("n_wrong"))
    number = F.coalesce(F.regexp_extract("category", "([0-9]+)", 1).try_cast("bigint"), F.lit(0))
    # categories are a fixed short vocabulary, so listing their order is one small task
    listed = counts.agg(F.array_sort(F.collect_list(F.struct(F.substring("category", 1, 1).alias("a"), number.alias("b"), "category", "n", "n_wrong"))).alias("l"))
    flat = listed.select(F.posexplode("l").alias("place", "e"))
    return flat.select("e.category", "e.n", "e.n_wrong", (F.col("place") + 1).cast("bigint").alias("place"))


@query(
    "bounding_boxes",
    """
SELECT l_linenumber::BIGINT AS l_linenumber, l_suppkey, min(l_quantity) AS first_min, max(l_quantity) AS first_max, min(l_discount) AS second_min,
  max(l_discount) AS second_max, count(*)::BIGINT AS n_cells FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def bounding_boxes(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_suppkey", "l_quantity", "l_discount")
    return A.bounding_boxes(rows, ["l_linenumber", "l_suppkey"], "l_quantity", "l_discount", 20)


@query(
    "size_by_class",
    """
WITH s AS (SELECT 'document' AS class, strlen(text) AS b FROM documents UNION ALL SELECT 'page', strlen(html) FROM pages)
SELECT class, count(*)::BIGINT AS n, round(avg(b), 6) AS mean, min(b)::BIGINT AS least, max(b)::BIGINT AS most,
  round(avg(b) / (SELECT avg(b) FROM s WHERE class = 'document'), 6) AS ratio FROM s GROUP BY 1""",
)
def size_by_class(spark, sf):
    size = lambda c: F.octet_length(c).cast("bigint").alias("b")
    docs = table(spark, sf, "documents").select(F.lit("document").alias("class"), size("text"))
    rows = docs.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("class"), size("html")))
    base = docs.select(F.avg("b")).scalar()
    return rows.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("b")).alias("mean"), F.min("b").alias("least"), F.max("b").alias("most"), r6(F.avg("b") / base).alias("ratio")
    )


@query(
    "delivery_funnel",
    """
WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p, bool_or(value > 200) AS x FROM events GROUP BY 1)
SELECT unnest(['stored', 'found', 'returned', 'intact']) AS stage, unnest([count(*) FILTER (WHERE v), count(*) FILTER (WHERE c), count(*) FILTER (WHERE p), count(*) FILTER (WHERE x)])::BIGINT AS reached,
  count(*)::BIGINT AS "of" FROM u""",
)
def delivery_funnel(spark, sf):
    kind = F.col("event_type")
    stages = {"stored": kind == "view", "found": kind == "click", "returned": kind == "purchase", "intact": F.col("value") > 200}
    return L.funnel(table(spark, sf, "events"), "user_id", stages)


@query(
    "flag_census",
    """
WITH t AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS h FROM events),
s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM t),
b AS (SELECT user_id, session, count(*) FILTER (WHERE event_type <> 'signup') AS n, count(*) FILTER (WHERE event_type = 'error') AS pen,
  max(value / 50) FILTER (WHERE event_type = 'error') AS z FROM s WHERE session IS NOT NULL GROUP BY ALL)
SELECT count(*)::BIGINT AS sessions, (count(*) FILTER (WHERE pen > 0))::BIGINT AS sessions_with_penalty, sum(n)::BIGINT AS items, sum(pen)::BIGINT AS n_penalties,
  round(max(z), 6) AS max_z, (arg_max(n, (z, n)) FILTER (WHERE z IS NOT NULL))::BIGINT AS max_z_n, round(sqrt((arg_max(n, (z, n)) FILTER (WHERE z IS NOT NULL)) - 1), 4) AS max_z_bound,
  (count(*) FILTER (WHERE z > sqrt(greatest(n - 1, 1)) + 1e-9))::BIGINT AS over_bound FROM b""",
)
def flag_census(spark, sf):
    lines = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.col("event_type")
    inside = log_sessions(lines, ["user_id"], ["ts", "event_id"], F.when(kind == "signup", F.col("event_id")))
    per = inside.groupBy("user_id", "session").agg(
        F.count_if(kind != "signup").alias("n"),
        F.count_if(kind == "error").alias("pen"),
        F.max(F.when(kind == "error", F.col("value") / 50)).alias("z"),
    )
    return rounded(L.flag_census(per, "n", "pen", "z"), "max_z")


@query(
    "repair_ablation",
    """
WITH d AS (SELECT text NOT LIKE '%http%' AS a, n_chars >= 400 AS b FROM documents)
SELECT unnest(['none', 'a', 'b', 'both']) AS repair, unnest([count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE b), count(*) FILTER (WHERE a), count(*)])::BIGINT AS n_pass, count(*)::BIGINT AS "of" FROM d""",
)
def repair_ablation(spark, sf):
    return L.repair_ablation(table(spark, sf, "documents"), ~F.col("text").contains("http"), F.col("n_chars") >= 400)


@query(
    "diff_profile",
    """
WITH d AS (SELECT l_suppkey AS row, round(l_discount * 100)::BIGINT - round(l_tax * 100)::BIGINT AS v FROM lineitem),
p AS (SELECT row, count(*) AS c FROM d WHERE v <> 0 GROUP BY 1)
SELECT sum(c)::BIGINT AS cells, count(*)::BIGINT AS rows_occupied, round(avg(c), 6) AS mean_per_row, (SELECT count(DISTINCT v) FROM d WHERE v <> 0)::BIGINT AS distinct_values FROM p""",
)
def diff_profile(spark, sf):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    cells = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row"), (cents("l_discount") - cents("l_tax")).alias("v"))
    return rounded(D.difference_profile(cells, "row", "v"), "mean_per_row")


WANTED = ["k", "tag", "colour"]


@query(
    "nested_keys",
    """
WITH k AS (SELECT event_type, unnest(list_distinct(regexp_extract_all(props, '"([^"]+)" *:', 1))) AS key FROM events)
SELECT event_type, key, count(*)::BIGINT AS n FROM k WHERE key IN ('k', 'tag', 'colour') GROUP BY ALL""",
)
def nested_keys(spark, sf):
    keys = F.regexp_extract_all("props", F.lit('"([^"]+)" *:'), F.lit(1))
    found = F.array_intersect(keys, F.array(*[F.lit(w) for w in WANTED]))
    rows = table(spark, sf, "events").select("event_type", F.explode(found).alias("key"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cluster_error_profile",
    """
WITH c AS (SELECT d.source, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS w FROM documents d JOIN labels USING (doc_id) GROUP BY 1)
SELECT count(*)::BIGINT AS clusters, round(avg(n), 6) AS mean_items, min(n)::BIGINT AS min_items, max(n)::BIGINT AS max_items,
  (count(*) FILTER (WHERE w = 0))::BIGINT AS clusters_no_error, (count(*) FILTER (WHERE w = n))::BIGINT AS clusters_all_wrong, round(sum(n - w) / sum(n), 6) AS accuracy FROM c""",
)
def cluster_error_profile(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return rounded(P.error_profile(rows.withColumn("wrong", F.col("quality") == 0), "source", "wrong"), "mean_items", "accuracy")


@query(
    "rule_disagreement",
    "WITH"
    + SQL_RULES
    + f""",
c AS (SELECT cluster, {_parity(_PLACE)} AS a,
  CASE WHEN category LIKE 'S%' THEN 8 WHEN category = 'COCCYX' THEN NULL WHEN try_cast(substr(category, 2) AS INT) % 2 = 1 THEN 6 ELSE 7 END AS b FROM ready)
SELECT cluster::BIGINT AS cluster, count(a + b)::BIGINT AS n, (count(*) FILTER (WHERE a <> b))::BIGINT AS n_differ, round((count(*) FILTER (WHERE a <> b)) / nullif(count(a + b), 0), 6) AS rate
FROM c GROUP BY 1""",
)
def rule_disagreement(spark, sf):
    name = F.col("category")
    rows = items(spark, sf).withColumn("cluster", F.col("cluster").cast("bigint"))
    return rounded(P.rule_disagreement(rows, ["cluster"], channel_by_name(name), channel_by_number(name)), "rate")


@query(
    "median_findings",
    """
WITH p AS (SELECT c_mktsegment, c_custkey, count(DISTINCT event_type) AS k FROM customer JOIN events ON c_custkey = user_id GROUP BY ALL)
SELECT c_mktsegment, round(median(k), 6) AS median_findings, count(*)::BIGINT AS objects FROM p GROUP BY 1""",
)
def median_findings(spark, sf):
    pairs = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "event_type").distinct()
    per = pairs.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("k"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(per, "c_custkey")
    mid = Grouped(rows, ["c_mktsegment"]).quantiles("k", {"median_findings": 0.5})
    size = rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("objects"))
    return rounded(mid.join(size, "c_mktsegment"), "median_findings")




@query(
    "cell_channel_statistics",
    """
WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS channel FROM embeddings),
c AS (SELECT label, channel, p FROM p JOIN embeddings USING (vec_id))
SELECT label::BIGINT AS label, channel::BIGINT AS channel, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.95), 6) AS p95,
  round(max(p), 6) AS max, round(min(p), 6) AS min, round(stddev_pop(p), 6) AS std, (count(*) FILTER (WHERE p > 0.1))::BIGINT AS n_high FROM c GROUP BY ALL""",
)
def cell_channel_statistics(spark, sf):
    """Cell labels joined to cell probabilities, then summarised per item and channel."""
    vec = table(spark, sf, "embeddings")
    probs = vec.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "p"))
    labels = vec.select("vec_id", F.col("label").cast("bigint").alias("label"))
    cells = probs.join(labels, "vec_id").select("label", F.col("channel").cast("bigint").alias("channel"), "p")
    return A.channel_statistics(cells, ["label", "channel"], "p", 0.1)


@query(
    "dropped_labels",
    "SELECT l_linenumber::BIGINT AS label, count(*)::BIGINT AS n_dropped FROM lineitem WHERE l_linenumber NOT BETWEEN 2 AND 5 GROUP BY 1",
)
def dropped_labels(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("label"))
    return P.drop_out_of_range(rows, "label", 2, 5)[1]


@query(
    "isotropic_count",
    "SELECT (count(*) FILTER (WHERE round(l_discount * 100) = round(l_tax * 100) AND round(l_tax * 100) = l_linenumber))::BIGINT AS n_isotropic, count(*)::BIGINT AS \"of\" FROM lineitem",
)
def isotropic_count(spark, sf):
    cents = [F.round(F.col(c) * 100).cast("int").alias(c) for c in ("l_discount", "l_tax")]
    return P.isotropic(table(spark, sf, "lineitem").select(*cents, "l_linenumber"), ["l_discount", "l_tax", "l_linenumber"])


@query(
    "run_progress_stream",
    """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS status, max(value) AS wall FROM events GROUP BY 1),
a AS (SELECT count(*) AS n, avg(wall) AS mean, median(wall) AS med, max(wall) AS mx FROM l)
SELECT status, count(*)::BIGINT AS n, round(count(*) / any_value(a.n), 6) AS share, round(any_value(mean), 6) AS mean_wall, round(any_value(med), 6) AS median_wall,
  any_value(mx) AS max_wall, greatest(0, 5000 - any_value(a.n))::BIGINT AS remaining, round(greatest(0, 5000 - any_value(a.n)) * any_value(med) / 3600, 6) AS remaining_hours
FROM l, a GROUP BY status""",
)
def progress_stream(spark, sf):
    """The events written out as a run log, followed by the stream, read back from its table."""
    events = table(spark, sf, "events")
    folder = shared_path(spark, "run-log")
    lines = events.select(
        F.col("user_id").cast("string").alias("case"), F.col("event_type").alias("status"), F.col("value").alias("wall_seconds"), F.col("ts").cast("string").alias("utc")
    )
    lines.write.json(f"{folder}/log")
    run_progress_stream(spark, f"{folder}/log", f"{folder}/out", f"{folder}/state", 5000).awaitTermination()
    return rounded(latest_progress(spark, f"{folder}/out"), "share", "mean_wall", "median_wall", "max_wall", "remaining_hours")
