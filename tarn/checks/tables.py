"""Table entity and metrics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.checks.base import query, table
from tarn.operators import metrics as M
from tarn.operators import tables as Q


@query("query_table", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1")
def query_table(spark, sf):
    return Q.query_table(
        table(spark, sf, "orders"),
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1",
    )


@query(
    "query_tables",
    """SELECT c_mktsegment, l_returnflag, 'line' AS source, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def query_tables(spark, sf):
    return Q.query_tables(
        {"cust": table(spark, sf, "customer"), "ord": table(spark, sf, "orders"), "line": table(spark, sf, "lineitem")},
        """SELECT c_mktsegment, l_returnflag, line._entity_id AS source, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
                  count(DISTINCT o_orderkey) AS orders
           FROM cust JOIN ord ON o_custkey = c_custkey JOIN line ON l_orderkey = o_orderkey
           GROUP BY c_mktsegment, l_returnflag, line._entity_id""",
    )


@query(
    "route_queries",
    """WITH q AS (
  SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'revenue > 100 for parts that mention ' || p_name WHEN 1 THEN 'top 10 of ' || p_type WHEN 2 THEN 'relation of ' || p_name
         WHEN 3 THEN 'screenshot of ' || p_name WHEN 4 THEN 'audio about ' || p_name WHEN 5 THEN 'phone for ' || p_brand ELSE 'what is ' || p_name END AS text,
         ['mixed', 'structural', 'graph', 'visual', 'audio', 'lexical', 'hybrid'][p_size % 7 + 1] AS route FROM part)
SELECT p_partkey, route FROM q""",
)
def route_queries(spark, sf):
    text = F.expr(
        """CASE p_size % 7 WHEN 0 THEN concat('revenue > 100 for parts that mention ', p_name) WHEN 1 THEN concat('top 10 of ', p_type)
           WHEN 2 THEN concat('relation of ', p_name) WHEN 3 THEN concat('screenshot of ', p_name) WHEN 4 THEN concat('audio about ', p_name)
           WHEN 5 THEN concat('phone for ', p_brand) ELSE concat('what is ', p_name) END"""
    )
    return Q.route_queries(table(spark, sf, "part").select("p_partkey", text.alias("text"))).drop("text")


PROFILED = ["c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"]


def _profile_sql(columns, numeric):
    parts = []
    for c in columns:
        number = f"{c}::double" if c in numeric else "NULL::double"
        parts.append(
            f"""SELECT '{c}' AS column_name, count(*) AS row_count, count_if({c} IS NULL)::bigint AS null_count, count(DISTINCT {c}) AS distinct_count,
  round(coalesce(min({number}), -1), 4) AS min, round(coalesce(max({number}), -1), 4) AS max, round(coalesce(avg({number}), -1), 4) AS mean, round(coalesce(stddev({number}), -1), 4) AS std FROM src"""
        )
    return "WITH src AS (SELECT * REPLACE (nullif(c_nationkey, 3) AS c_nationkey) FROM customer) " + " UNION ALL ".join(parts)


@query("profile", _profile_sql(PROFILED, PROFILED[:3]))
def profile(spark, sf):
    src = table(spark, sf, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    rounded = [F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c) for c in ("min", "max", "mean", "std")]
    return Q.profile(src).select("column_name", "row_count", "null_count", "distinct_count", *rounded)


@query(
    "profile_top_values",
    """WITH v AS (UNPIVOT_COLUMNS),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM v)
SELECT column_name, string_agg(value, ',' ORDER BY r) AS top_values FROM r WHERE r <= 5 GROUP BY column_name""".replace(
        "UNPIVOT_COLUMNS",
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {c}::varchar AS value, count(*) AS n FROM events GROUP BY ALL"
            for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
        ),
    ),
)
def profile_top_values(spark, sf):
    return Q.profile(table(spark, sf, "events")).select(
        "column_name", F.array_join("top_values", ",").alias("top_values")
    )


PREVIEW_SQL = """WITH n AS (SELECT count(*) AS n FROM {t})
SELECT {c} FROM {t}, n QUALIFY n < 1000 OR row_number() OVER (ORDER BY {k}) <= 50 OR row_number() OVER (ORDER BY {k} DESC) <= 50"""


@query("preview_small", PREVIEW_SQL.format(t="supplier", k="s_suppkey", c="s_suppkey, s_name"))
def preview_small(spark, sf):
    return Q.preview(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


@query("preview_medium", PREVIEW_SQL.format(t="customer", k="c_custkey", c="c_custkey, c_name"))
def preview_medium(spark, sf):
    return Q.preview(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")


@query(
    "preview_large",
    """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, l_quantity FROM lineitem),
head AS (SELECT * FROM l ORDER BY line_id LIMIT 30),
size AS (SELECT count(*) AS n FROM l),
small AS (SELECT * FROM l ORDER BY line_id LIMIT 50),
tail AS (SELECT * FROM l ORDER BY line_id DESC LIMIT 50),
drawn AS (SELECT * FROM l WHERE line_id NOT IN (SELECT line_id FROM head) ORDER BY sha256('0:' || line_id), line_id LIMIT 70)
SELECT x.* FROM (SELECT * FROM head UNION ALL SELECT * FROM drawn) x, size WHERE n > 100000
UNION ALL SELECT x.* FROM (SELECT * FROM small UNION ALL SELECT * FROM tail) x, size WHERE n <= 100000""",
)
def preview_large(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return Q.preview(lines.select("line_id", "l_quantity"), "line_id")


@query("preview_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def preview_page(spark, sf):
    return Q.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", offset=100, limit=25)


@query(
    "ops_histogram",
    """WITH b(le) AS (VALUES (0.1::double), (0.5), (1.0), (2.5), (5.0), (10.0), (30.0), ('inf'::double))
SELECT event_type, le, count_if(value <= le)::bigint AS cumulative, round(sum(value), 4) AS total, count(*) AS n FROM events, b GROUP BY ALL""",
)
def ops_histogram(spark, sf):
    return M.histogram(table(spark, sf, "events"), M.BUCKETS["reconcile_seconds"], "value", "event_type").withColumn("total", F.round("total", 4))


METRIC = "CASE event_type WHEN 'click' THEN 'search_queries_total' WHEN 'view' THEN 'sync_queue_depth' WHEN 'error' THEN 'pipeline_errors_total' WHEN 'signup' THEN 'entity_ops_total' ELSE 'unknown' END"


@query(
    "ops_metrics",
    f"""WITH l AS (SELECT {METRIC} AS metric, 'u' || user_id % 3 AS label, value, ts FROM events)
SELECT metric, label, round(CASE WHEN metric = 'sync_queue_depth' THEN max_by(value, ts) ELSE sum(value) END, 4) AS value, count(*) AS observations FROM l WHERE metric <> 'unknown' GROUP BY metric, label""",
)
def ops_metrics(spark, sf):
    log = table(spark, sf, "events").select(
        F.expr(METRIC).alias("metric"), F.concat(F.lit("u"), (F.col("user_id") % 3)).alias("label"), "value", "ts"
    )
    return M.ops_metrics(log).withColumn("value", F.round("value", 4))


@query(
    "watch_status",
    """SELECT event_type AS strategy_id, count_if(ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00')::bigint AS events_last_hour,
       quantile_disc(value, 0.99) AS lag_p99, count(DISTINCT user_id) AS entities_managed FROM events GROUP BY 1""",
)
def watch_status(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("strategy_id"), "ts", F.col("value").alias("lag"), F.col("user_id").alias("entity_id")
    )
    return M.watch_status(events, F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query(
    "dead_letter_alerts",
    """WITH l AS (SELECT user_id AS s, ts, floor(value * 100)::bigint AS size FROM events WHERE event_type = 'error'),
d AS (SELECT DISTINCT s, ts::date AS d FROM l),
i AS (SELECT s, d, d - row_number() OVER (PARTITION BY s ORDER BY d)::int AS isl FROM d)
SELECT 'burst' AS alert, '' AS strategy_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::bigint AS at_s, count(*) AS n FROM l GROUP BY 3 HAVING count(*) > 5
UNION ALL SELECT 'stale', s::varchar, epoch(min(d)::timestamp)::bigint, count(*) FROM i GROUP BY s, isl HAVING count(*) >= 3
UNION ALL SELECT 'disk_full', '', epoch(date_trunc('second', max(ts)))::bigint, sum(size)::bigint FROM l HAVING sum(size) > 9000""",
)
def dead_letter_alerts(spark, sf):
    letters = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("strategy_id"), F.col("ts").alias("created_at"), F.floor(F.col("value") * 100).alias("size")
    )
    alerts = M.dead_letter_alerts(letters, 5, 3, 10_000)
    return alerts.select("alert", "strategy_id", F.unix_timestamp("at").alias("at_s"), "n")
