"""Queries that write a table out in an operator's own file format and read it back with its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import logs as L
from tallyframe.operators.profiling import regressions
from tallyframe.plans.registry import query
from tallyframe.session import shared_path
from tallyframe.sources.records import read_checker_log, read_landmarks, write_table
from tallyframe.sources.tables import table


@query(
    "emitter_log",
    """
WITH e AS (SELECT *, user_id // 50 AS log FROM events),
s AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (PARTITION BY log ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e),
p AS (SELECT log, session, event_id % 5 AS label, arg_max(floor(value * 10), (ts, event_id)) AS z FROM s WHERE session IS NOT NULL AND event_type = 'purchase' GROUP BY ALL),
q AS (SELECT log, session, count(*) AS n, max(z) AS top FROM p GROUP BY ALL),
m AS (SELECT log, session, arg_max(floor(value), (ts, event_id)) FILTER (WHERE event_type = 'view') AS extracted, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 7 END) AS n_small
  FROM s WHERE session IS NOT NULL GROUP BY ALL)
SELECT m.session::VARCHAR AS session, extracted::BIGINT AS extracted, n_small::BIGINT AS n_small, coalesce(q.n, 0)::BIGINT AS n_penalties, q.top::DOUBLE AS top_z FROM m LEFT JOIN q USING (log, session)""",
)
def emitter_log(spark, sf):
    """Events as the emitter's log, a file per fifty users, parsed back into sessions."""
    kind, text = F.col("event_type"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = (
        F.when(kind == "signup", text("Processing patient: pat_", F.col("user_id")))
        .when(kind == "view", text("Extracted confidence for ", F.floor("value").cast("bigint"), " vertebrae"))
        .when(kind == "click", text("Excluded small box: vertebrae_", F.col("event_id") % 7))
        .when(kind == "purchase", text("Penalty for ", F.col("event_id") % 5, ": z-score=", F.floor(F.col("value") * 10).cast("bigint")))
        .otherwise(text("Other ", F.col("event_id")))
    )
    path = shared_path(spark, "emitter-log")
    rows = table(spark, sf, "events").select(F.floor(F.col("user_id") / 50).cast("bigint").alias("log"), "ts", "event_id", line.alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"])
    files = rows.groupBy("log").agg(F.array_join(ordered, "\n").alias("value"))  # a log is one file, read whole later
    files.repartition("log").write.partitionBy("log").text(path)
    found = L.emitter_sessions(read_checker_log(spark, f"{path}/*"), "path")
    n_small = F.size("small_boxes").cast("bigint").alias("n_small")
    return found.select("session", "extracted", n_small, F.col("n_penalties").cast("bigint").alias("n_penalties"), "top_z")


@query(
    "landmark_scan",
    """
SELECT c_nationkey::BIGINT AS label, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS x, sum(c_custkey)::DOUBLE AS y FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1""",
)
def landmark_scan(spark, sf):
    """Customers as landmark lists, a file per fifty, with a direction entry and NaN places; read back and counted."""
    place = F.when(F.col("c_custkey") % 3 == 0, F.lit("NaN")).otherwise(F.format_string("%.2f", "c_acctbal"))
    entry = F.concat(
        F.lit('{"label": '), F.col("c_nationkey").cast("string"), F.lit(', "X": '), place, F.lit(', "Y": '), F.col("c_custkey").cast("string"), F.lit(', "Z": 1.0}')
    )
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 50).cast("bigint").alias("case"), entry.alias("entry"))
    lists = rows.groupBy("case").agg(F.concat(F.lit('[{"direction": ["P", "I", "R"]}, '), F.array_join(F.collect_list("entry"), ", "), F.lit("]")).alias("value"))
    path = shared_path(spark, "landmarks")
    lists.repartition("case").write.partitionBy("case").text(path)
    found = read_landmarks(spark, f"{path}/*")
    return found.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("x"), F.sum("y").alias("y")
    )


@query(
    "table_sink",
    "SELECT o_orderstatus, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders",
)
def table_sink(spark, sf):
    """Orders through the partitioned table sink and back."""
    path = shared_path(spark, "sink")
    write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path, ["o_orderstatus"])
    return spark.read.parquet(path).select(F.col("o_orderstatus").cast("string").alias("o_orderstatus"), "o_orderkey", "o_totalprice")


@query(
    "regression_rows",
    """
WITH w AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1), g AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1)
SELECT o_custkey, w.total AS want, g.total AS got FROM w LEFT JOIN g USING (o_custkey) WHERE g.total IS NULL OR abs(g.total - w.total) > 0.01""",
)
def regression_rows(spark, sf):
    """Totals per customer after some orders were lost, against the published ones: what the gate would refuse."""
    orders = table(spark, sf, "orders")

    def totals(rows):
        return rows.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))

    return regressions(totals(orders.filter("o_orderkey % 97 <> 0")), totals(orders), ["o_custkey"], "total", 0.01)
