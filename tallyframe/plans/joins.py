"""Matching, diffs and the other joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import r6
from tallyframe.operators import diffs as D
from tallyframe.operators import matching as M
from tallyframe.operators import profiling as P
from tallyframe.plans.base import SQL_ITEM, SQL_MATCH, TOLERANCE, items, reference_points, rounded
from tallyframe.plans.registry import query
from tallyframe.sources.tables import table

AXES = ["x", "y", "z"]


@query("match_nearest", "WITH" + SQL_MATCH + " SELECT vec_id, nearest, round(dist, 6) AS dist, matched, wrong FROM matched_item")
def match_nearest(spark, sf):
    rows = items(spark, sf).select("vec_id", "cluster", "category", *AXES)
    ref = reference_points(items(spark, sf))
    out = M.match(rows, ref, ["cluster"], AXES, "category", "category", TOLERANCE)
    return out.select("vec_id", "nearest", r6("dist").alias("dist"), "matched", "wrong")


# landmarks: mean place per cluster and level; the predicted side is moved and misses some levels
SQL_LANDMARKS = (
    SQL_ITEM
    + """,
truth AS (SELECT cluster, code AS label, 100 * avg(x) AS x, 100 * avg(y) AS y, 100 * avg(z) AS z FROM item GROUP BY ALL),
guess AS (SELECT cluster, code AS label, 100 * avg(rx) AS x, 100 * avg(ry) AS y, 100 * avg(rz) AS z FROM item WHERE seen GROUP BY ALL)"""
)

SQL_HITS = (
    SQL_LANDMARKS
    + """,
shared AS (SELECT cluster, label FROM truth INTERSECT SELECT cluster, label FROM guess),
pairs AS (
  SELECT g.cluster, g.label, t.label AS other, sqrt((g.x - t.x)^2 + (g.y - t.y)^2 + (g.z - t.z)^2) AS dist
  FROM guess g JOIN shared a USING (cluster, label) JOIN truth t ON t.cluster = g.cluster
  JOIN shared b ON b.cluster = t.cluster AND b.label = t.label),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, label ORDER BY dist, other) AS rn FROM pairs) WHERE rn = 1),
hits AS (
  SELECT t.cluster, t.label, CASE WHEN b.other = t.label AND b.dist <= 20 THEN 1 ELSE 0 END AS hit
  FROM truth t LEFT JOIN best b USING (cluster, label))"""
)


def landmarks(spark, sf):
    rows = items(spark, sf)
    key = ["cluster", F.col("code").alias("label")]
    truth = rows.groupBy(*key).agg(*[(100 * F.avg(a)).alias(a) for a in AXES])
    guess = rows.filter("seen").groupBy(*key).agg(*[(100 * F.avg(f"r{a}")).alias(a) for a in AXES])
    return truth, guess


@query("id_hits", "WITH" + SQL_HITS + " SELECT cluster::BIGINT AS cluster, label::BIGINT AS label, hit::BIGINT AS hit FROM hits")
def id_hits(spark, sf):
    truth, guess = landmarks(spark, sf)
    out = M.identification_hits(truth, guess, ["cluster"], AXES, "label")
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in ("cluster", "label", "hit")])


@query(
    "same_label_distance",
    "WITH"
    + SQL_HITS
    + """
SELECT cluster::BIGINT AS cluster, count(*)::BIGINT AS n, round(avg(d), 6) AS mean_dist, round(max(d), 6) AS max_dist, round(avg(d) FILTER (WHERE hit = 1), 6) AS mean_hit_dist
FROM (SELECT t.cluster, h.hit, sqrt((g.x - t.x)^2 + (g.y - t.y)^2 + (g.z - t.z)^2) AS d FROM truth t JOIN guess g USING (cluster, label) JOIN hits h USING (cluster, label))
GROUP BY cluster""",
)
def same_label_distance(spark, sf):
    truth, guess = landmarks(spark, sf)
    keys = ["cluster", "label"]
    hits = M.identification_hits(truth, guess, ["cluster"], AXES, "label")
    rows = M.label_distance(truth, guess, keys, AXES).join(hits, keys)
    return rows.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("dist")).alias("mean_dist"),
        r6(F.max("dist")).alias("max_dist"),
        r6(F.avg(F.when(F.col("hit") == 1, F.col("dist")))).alias("mean_hit_dist"),
    )


@query(
    "resume_todo",
    """SELECT c_custkey, 'full' AS mode FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT c_custkey, 'partial' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O'))""",
)
def resume_todo(spark, sf):
    cases = table(spark, sf, "customer").select("c_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "ok_step1_only").otherwise("failed")
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), status.alias("status"))
    full = P.resume_todo(cases, done, "c_custkey", "status").withColumn("mode", F.lit("full"))
    part = P.resume_todo(cases, done, "c_custkey", "status", partial=True).withColumn("mode", F.lit("partial"))
    return full.unionByName(part)


@query(
    "exists_flag",
    "WITH" + SQL_ITEM + " SELECT vec_id, EXISTS (SELECT 1 FROM reference r WHERE r.cluster = i.cluster AND r.category = i.category) AS present FROM item i",
)
def exists_flag(spark, sf):
    rows = items(spark, sf)
    return M.has_own(rows, reference_points(rows), ["cluster", "category"]).select("vec_id", "present")


def order_attributes(spark, sf, changed: bool):
    orders = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    value = F.when(F.pmod(key, F.lit(5)) == 0, price + 1).otherwise(price) if changed else price
    drop = F.pmod(key, F.lit(7)) == 0
    lost, deep = F.pmod(key, F.lit(3)) == 0, F.pmod(key, F.lit(13)) == 0

    def entry(name, col, nested=False):
        return F.struct(F.lit(name).alias("key"), col.cast("string").alias("value"), F.lit(nested).alias("nested"))

    cents = F.round(value * 100).cast("bigint")
    attrs = [entry("status", F.col("o_orderstatus")), entry("price", cents)]
    if changed:
        attrs += [
            F.when(~drop, entry("priority", F.col("o_orderpriority"))),
            F.when(~lost, entry("history", F.col("o_custkey") + 1, True)),
            F.when(~deep, entry("history/first", F.col("o_custkey"))),
            F.when(F.pmod(key, F.lit(11)) == 0, entry("extra", key)),
        ]
    else:
        attrs += [entry("priority", F.col("o_orderpriority")), entry("history", F.col("o_custkey"), True), entry("history/first", F.col("o_custkey"))]
    return orders.select("o_orderkey", F.explode(F.array_compact(F.array(*attrs))).alias("a")).select("o_orderkey", "a.*")


@query(
    "dataset_diff",
    """
SELECT o_orderkey, 'changed' AS kind, 'price' AS listed, 1::BIGINT AS n FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'removed', concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'history' END, CASE WHEN o_orderkey % 7 = 0 THEN 'priority' END), (o_orderkey % 3 = 0)::BIGINT + (o_orderkey % 7 = 0)::BIGINT
  FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'nested_lost', 'history/first', 1 FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, 'added', 'extra', 1 FROM orders WHERE o_orderkey % 11 = 0""",
)
def dataset_diff(spark, sf):
    diff = D.dataset_diff(order_attributes(spark, sf, False), order_attributes(spark, sf, True), "o_orderkey", "key", "value")
    return D.diff_report(diff, "o_orderkey", "key")


@query(
    "flag_join",
    """
WITH f AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL),
r AS (SELECT o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'purchase' END AS event_type, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT f.user_id, f.event_type, f.n::BIGINT AS n, r.price IS NOT NULL AS in_rows, coalesce(r.price > 300000, false) AS wrong, f.top > 60 AS flag
FROM f LEFT JOIN r USING (user_id, event_type)""",
)
def flag_join(spark, sf):
    flags = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    kind = F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("purchase")
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), kind.alias("event_type")).agg(F.max("o_totalprice").alias("price"))
    out = flags.join(rows, ["user_id", "event_type"], "left")
    return out.select(
        "user_id", "event_type", "n", F.col("price").isNotNull().alias("in_rows"),
        F.coalesce(F.col("price") > 300000, F.lit(False)).alias("wrong"), (F.col("top") > 60).alias("flag"),
    )


PLANES = [
    {
        "plane": k,
        "origin": [0.0, 0.0, 0.02 * k - 0.1],
        "across": [1.0, 0.0, 0.0],
        "down": [0.0, 0.8, 0.6],
        "normal": [0.0, -0.6, 0.8],
        "row_step": 0.02,
        "col_step": 0.01,
    }
    for k in range(10)
]


@query(
    "best_plane",
    "WITH"
    + SQL_ITEM
    + """,
p AS (SELECT k AS plane, 0.02::DOUBLE * k - 0.1::DOUBLE AS oz FROM range(10) t(k)),
o AS (SELECT cluster, plane, (y * 0.8::DOUBLE + (z - oz) * 0.6::DOUBLE) / 0.02::DOUBLE AS r, x / 0.01::DOUBLE AS c,
  y * -0.6::DOUBLE + (z - oz) * 0.8::DOUBLE AS off FROM item, p),
s AS (SELECT cluster, plane, sum(abs(off)) AS total, count(*) FILTER (WHERE r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 19) AS inside FROM o GROUP BY ALL)
SELECT cluster::BIGINT AS cluster, plane::BIGINT AS plane, round(total, 6) AS total_offset, inside::BIGINT AS inside
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total, plane) AS rn FROM s) WHERE rn = 1""",
)
def best_plane(spark, sf):
    offsets = M.plane_offsets(items(spark, sf).select("cluster", *AXES), PLANES, AXES)
    out = M.best_plane(offsets, ["cluster"], 10, 20)
    return out.select(F.col("cluster").cast("bigint").alias("cluster"), F.col("plane").cast("bigint").alias("plane"), r6("total_offset").alias("total_offset"), "inside")


@query(
    "nearest_bin",
    """
WITH e AS (SELECT k, k * 5000::DOUBLE AS edge FROM range(20) t(k)),
b AS (SELECT l_extendedprice, arg_min(k, (abs(l_extendedprice - edge), k)) AS bin FROM (SELECT DISTINCT l_extendedprice FROM lineitem), e GROUP BY 1)
SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem JOIN b USING (l_extendedprice) GROUP BY 1""",
)
def nearest_bin(spark, sf):
    spot = M.nearest_bin(F.col("l_extendedprice"), 0.0, 5000.0, 20)
    return table(spark, sf, "lineitem").groupBy(spot.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "grid_gather",
    """
WITH c AS (SELECT l_linenumber, l_suppkey AS i, l_quantity::BIGINT AS j, max(round(l_discount * 100))::BIGINT AS v FROM lineitem GROUP BY ALL),
t AS (SELECT l_linenumber, round_even(l_partkey * 0.25 + 1, 0)::BIGINT AS i, round_even(l_quantity * 0.5 + 0.25, 0)::BIGINT AS j FROM lineitem)
SELECT l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n, (count(v) FILTER (WHERE v <> 0))::BIGINT AS n_filled, sum(coalesce(v, 0))::BIGINT AS total
FROM t LEFT JOIN c USING (l_linenumber, i, j) GROUP BY 1""",
)
def grid_gather(spark, sf):
    lines = table(spark, sf, "lineitem")
    cells = lines.groupBy("l_linenumber", F.col("l_suppkey").alias("i"), F.col("l_quantity").cast("bigint").alias("j")).agg(
        F.max(F.round(F.col("l_discount") * 100)).cast("bigint").alias("v")
    )
    places = {"i": F.col("l_partkey") * 0.25 + 1, "j": F.col("l_quantity") * 0.5 + 0.25}
    # targets that read the same cell are counted first, so a crowded target is one row
    spots = lines.select("l_linenumber", *[F.rint(c).cast("long").alias(n) for n, c in places.items()])
    spots = spots.groupBy("l_linenumber", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    out = M.grid_gather(spots.withColumnsRenamed({"i": "ti", "j": "tj"}), cells, ["l_linenumber"], {"i": F.col("ti"), "j": F.col("tj")}, "v")
    return out.groupBy(F.col("l_linenumber").cast("bigint").alias("l_linenumber")).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("v") != 0, F.col("c")).otherwise(0)).alias("n_filled"), F.sum(F.col("v") * F.col("c")).alias("total")
    )


@query(
    "reference_lookup",
    """
SELECT coalesce(o_orderstatus, '(none)') AS status, count(*)::BIGINT AS n, round(sum(l_quantity), 6) AS quantity
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def reference_lookup(spark, sf):
    # lines are summed per referenced order before the join
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q")
    )
    found = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "left")
    return found.groupBy(F.coalesce("o_orderstatus", F.lit("(none)")).alias("status")).agg(
        F.sum("c").alias("n"), r6(F.sum("q")).alias("quantity")
    )


@query(
    "roundtrip_compare",
    """
SELECT count(*)::BIGINT AS n_cells, (count(*) FILTER (WHERE o_totalprice <> o_totalprice::FLOAT::DOUBLE))::BIGINT AS n_differ,
  round(max(abs(o_totalprice - o_totalprice::FLOAT::DOUBLE)), 6) AS max_error FROM orders""",
)
def roundtrip_compare(spark, sf):
    sent = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    got = sent.withColumn("o_totalprice", F.col("o_totalprice").cast("float").cast("double"))
    return rounded(D.roundtrip(sent, got, ["o_orderkey"], "o_totalprice"), "max_error")


