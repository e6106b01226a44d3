"""Scans, projections and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import affine, count_if, penalty, r6
from tallyframe.functions.ordered import small
from tallyframe.operators import profiling as P
from tallyframe.operators import rules as R
from tallyframe.operators.curves import pooled_z
from tallyframe.operators.logs import classify, split_lines
from tallyframe.operators.matching import has_own
from tallyframe.operators.reductions import channel_statistics
from tallyframe.operators.sequences import renumber
from tallyframe.plans.base import SQL_ITEM, SQL_RULES, item_scored, items
from tallyframe.plans.registry import query
from tallyframe.sources import records as S
from tallyframe.sources.tables import table


@query(
    "scan_json_status",
    """
WITH truth AS (SELECT o_custkey AS u, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_type = 'signup' THEN event_type
    WHEN try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) < 20 THEN 'no_vertebrae'
    WHEN t.n IS NULL THEN 'no_gt_mask' ELSE 'used' END AS reason
  FROM events e LEFT JOIN truth t ON t.u = e.user_id)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason""",
)
def scan_json_status(spark, sf):
    events = table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    cases = events.select(
        F.col("user_id").alias("case"),
        F.when(F.col("event_type") == "signup", "signup").otherwise("ok").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("_corrupt_record"),
        F.when(k >= 20, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("vertebrae"),
    )
    truth = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case")).agg(F.count(F.lit(1)).alias("n_truth"))
    used, skipped = S.scan_cases(cases, truth)
    kept = used.agg(F.lit("used").alias("reason"), F.count(F.lit(1)).alias("n"))
    return skipped.unionByName(kept)


@query(
    "complete_sets",
    """
SELECT user_id::VARCHAR AS stem, any_value(user_id || '_view') AS has_view, any_value(user_id || '_purchase') AS has_purchase
FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2""",
)
def complete_sets(spark, sf):
    names = table(spark, sf, "events").select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("name")).distinct()
    parts = {"view": "_view", "purchase": "_purchase"}
    out = S.complete_sets(names, "name", parts, ["view", "purchase"])
    return out.select("stem", F.col("view").alias("has_view"), F.col("purchase").alias("has_purchase"))


LINE_SHAPES = [
    ("empty", "^ *$"),
    ("link", "https?://"),
    ("digits", "[0-9]"),
    ("code", r"[{}=;]"),
    ("sentence", r"\.$"),
    ("plain", "^[A-Za-z ]+$"),
]


@query(
    "log_classify",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^ *$') THEN 'empty' WHEN regexp_matches(line, 'https?://') THEN 'link'
  WHEN regexp_matches(line, '[0-9]') THEN 'digits' WHEN regexp_matches(line, '[{}=;]') THEN 'code'
  WHEN regexp_matches(line, '\\.$') THEN 'sentence' WHEN regexp_matches(line, '^[A-Za-z ]+$') THEN 'plain' ELSE 'other' END AS kind FROM l)
SELECT kind, count(*)::BIGINT AS n_lines, count(DISTINCT doc_id)::BIGINT AS n_files FROM c GROUP BY kind""",
)
def log_classify(spark, sf):
    lines = split_lines(table(spark, sf, "documents"), ["doc_id"], "text")
    kind = F.coalesce(classify(F.col("line"), LINE_SHAPES), F.lit("other"))
    per = lines.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("kind").agg(F.sum("c").cast("bigint").alias("n_lines"), F.count(F.lit(1)).cast("bigint").alias("n_files"))


@query("content_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents")
def content_manifest(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size")
    )


@query("incremental_new", "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_new(spark, sf):
    return S.incremental(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "normalise_category",
    """
WITH n AS (SELECT p_partkey, upper(regexp_replace(trim(' Vertebrae_' || p_type), '^vertebrae[_-]?', '', 'i')) AS s FROM part)
SELECT p_partkey, CASE WHEN s LIKE 'S%' AND NOT regexp_matches(s, '^S[0-9]') THEN 'SACRUM' ELSE s END AS category FROM n""",
)
def normalise_category(spark, sf):
    raw = F.concat(F.lit(" Vertebrae_"), "p_type")
    return table(spark, sf, "part").select("p_partkey", R.normalise_category(raw).alias("category"))


@query(
    "lookup_dimension",
    """
SELECT r_name, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def lookup_dimension(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(small(region), nation.n_regionkey == region.r_regionkey)
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(small(named), counts.c_nationkey == named.n_nationkey).select("r_name", "n_name", "n")


@query(
    "region_of_code",
    "WITH"
    + SQL_ITEM
    + """
SELECT code::BIGINT AS code, category, CASE WHEN code <= 7 THEN 'C' WHEN code <= 19 OR code = 28 THEN 'T' WHEN code <= 25 THEN 'L' ELSE 'S' END AS region,
  count(*)::BIGINT AS n FROM item GROUP BY ALL""",
)
def region_of_code(spark, sf):
    rows = items(spark, sf).groupBy("code", "category").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("code").cast("bigint").alias("code"), "category", R.region_of_code(F.col("code")).alias("region"), "n")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(
    "ordinal_lookup",
    """
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 999 END::BIGINT AS ord,
  count(*)::BIGINT AS n FROM orders GROUP BY ALL""",
)
def ordinal_lookup(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("o_orderpriority", R.ordinal(F.col("o_orderpriority"), PRIORITIES).cast("bigint").alias("ord"), "n")


@query("rule_scores", "WITH" + SQL_RULES + " SELECT vec_id, rule, round(score, 6) AS score FROM long_rule")
def rule_scores(spark, sf):
    return item_scored(spark, sf).select("vec_id", "rule", r6("score").alias("score"))


@query(
    "rule_undefined_counts",
    "WITH" + SQL_RULES + " SELECT rule, count(*)::BIGINT AS n, (count(*) FILTER (WHERE score IS NULL))::BIGINT AS n_undefined FROM long_rule GROUP BY rule",
)
def rule_undefined_counts(spark, sf):
    return R.undefined_counts(item_scored(spark, sf), ["rule"])


@query(
    "confidence_formula",
    """
WITH s AS (SELECT l_suppkey, avg(l_extendedprice / 1e5) AS mean, quantile_cont(l_extendedprice / 1e5, 0.95) AS p95,
  count(*) FILTER (WHERE l_extendedprice / 1e5 > 0.7) AS hi, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(0.2 * round(mean, 6) + 0.5 * round(p95, 6) + 0.3 * least(1.0, hi / greatest(1, n)), 5) AS confidence FROM s""",
)
def confidence_formula(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1e5).alias("v"))
    stats = channel_statistics(cells, ["l_suppkey"], "v", 0.7)
    sizes = cells.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    score = R.confidence(F.col("mean"), F.col("p95"), F.col("n_high"), F.col("n"))
    return stats.join(sizes, "l_suppkey").select("l_suppkey", F.round(score, 5).alias("confidence"))


CHECKS_SQL = """
SELECT 'discount_high' AS "check", (count(*) FILTER (WHERE l_discount > 0.08))::BIGINT AS n_bad FROM lineitem
UNION ALL SELECT 'discount_negative', (count(*) FILTER (WHERE l_discount < 0))::BIGINT FROM lineitem
UNION ALL SELECT 'quantity_range', (count(*) FILTER (WHERE l_quantity < 3 OR l_quantity > 45))::BIGINT FROM lineitem
UNION ALL SELECT 'label_range', (count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 6))::BIGINT FROM lineitem"""


@query("range_violations", CHECKS_SQL)
def range_violations(spark, sf):
    checks = {
        "discount_high": F.col("l_discount") > 0.08,
        "discount_negative": F.col("l_discount") < 0,
        "quantity_range": ~F.col("l_quantity").between(3, 45),
        "label_range": ~F.col("l_linenumber").between(1, 6),
    }
    return P.violations(table(spark, sf, "lineitem"), checks)


@query(
    "affine_points",
    """
SELECT vec_id, round(-2 * embedding[2]::DOUBLE + 1, 6) AS x, round(0.5 * embedding[1]::DOUBLE - 3, 6) AS y,
  round(10 - embedding[3]::DOUBLE, 6) AS z, round_even(embedding[1]::DOUBLE * 293, 1) AS scaled FROM embeddings""",
)
def affine_points(spark, sf):
    pts = items(spark, sf)
    mapped = affine([F.col(c) for c in "xyz"], [[0, -2, 0], [0.5, 0, 0], [0, 0, -1]], [1, -3, 10])
    return pts.select("vec_id", *[r6(m).alias(a) for m, a in zip(mapped, "xyz")], F.bround(F.col("x") * 293, 1).alias("scaled"))


@query(
    "displayed_confidence",
    """
WITH s AS (SELECT event_id, least(1.0, value / 500) AS conf, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 0.1) AS z,
  count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(conf * CASE WHEN k >= 2 AND z > 1.5 THEN greatest(0.3, 1 - (z - 1.5) * 0.4) ELSE 1 END, 6) AS displayed FROM s""",
)
def displayed_confidence(spark, sf):
    rows = pooled_z(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "value", 0.1, "z", ["event_id"])
    conf = F.least(F.lit(1.0), F.col("value") / 500)
    return rows.select("event_id", r6(conf * penalty(F.col("z"))).alias("displayed"))


@query(
    "renumber",
    """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS number
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def renumber_lines(spark, sf):
    out = renumber(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "number")
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query(
    "drop_reasons",
    """
SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'written' WHEN lang NOT IN ('de', 'en', 'fr') THEN 'invalid name'
  WHEN n_chars < 300 THEN 'small box' ELSE 'other' END AS reason, count(*)::BIGINT AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def drop_reasons(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    seen = has_own(docs, table(spark, sf, "labels"), ["doc_id"], "written")
    reason = P.drop_reason(F.col("written"), F.col("lang").isin("de", "en", "fr"), F.col("n_chars") < 300)
    return seen.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "outcome_verdict",
    """
SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'transport error' WHEN o_totalprice >= 400000 THEN 'rejected'
  WHEN o_orderpriority = '2-HIGH' THEN 'duplicate' WHEN o_orderstatus <> 'P' THEN 'accepted' ELSE 'error' END AS outcome, count(*)::BIGINT AS n
FROM orders GROUP BY 1""",
)
def outcome_verdict(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    found = P.outcome(
        (status == "F") & (priority == "1-URGENT"), F.col("o_totalprice") / 1000, priority == "2-HIGH", status != "P"
    )
    return table(spark, sf, "orders").groupBy(found.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "inside_and_flag",
    """
SELECT l_returnflag, count(*)::BIGINT AS n, (count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 40 AND l_discount BETWEEN 0.02 AND 0.08))::BIGINT AS n_inside,
  (count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 40 AND l_discount BETWEEN 0.02 AND 0.08 AND l_tax * 10 < 0.35))::BIGINT AS n_flagged
FROM lineitem GROUP BY 1""",
)
def inside_and_flag(spark, sf):
    inside = F.col("l_quantity").between(5, 40) & F.col("l_discount").between(0.02, 0.08)
    low = F.col("l_tax") * 10 < 0.35
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), count_if(inside).alias("n_inside"), count_if(inside & low).alias("n_flagged")
    )


