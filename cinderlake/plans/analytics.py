"""Analytics over the incident star: orders are incidents, customers adversaries, nations countries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderlake.operators import analytics as A
from cinderlake.session import table

ORDERS_AS_OF, EVENTS_AS_OF = "2001-08-01 00:00:00", "2024-01-31 00:00:00"


def top_groups_window(spark, d):
    orders = table(spark, d, "orders").where(A.in_period(F.col("o_orderdate"), ORDERS_AS_OF, "1y"))
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.top_k(named.select("c_custkey", "c_name", "n"), 10, "n", "c_custkey")


def country_counts_window(spark, d):
    orders = table(spark, d, "orders").where(A.in_window(F.col("o_orderdate"), ORDERS_AS_OF, 365))
    nations = table(spark, d, "nation")
    per_group = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    per_nation = per_group.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return nations.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n")


def groups_with_zero(spark, d):
    orders = table(spark, d, "orders").where(A.in_window(F.col("o_orderdate"), ORDERS_AS_OF, 92))
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    left = table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return left.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def kpi_distinct_window(spark, d):
    orders = table(spark, d, "orders")
    recent = A.in_window(F.col("o_orderdate"), ORDERS_AS_OF, 30)
    return orders.where(recent).agg(F.count(F.lit(1)).alias("incidents"), F.countDistinct("o_custkey").alias("groups"), F.countDistinct("o_orderpriority").alias("priorities"))


def global_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in ("customer", "orders", "lineitem", "nation", "supplier")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def monthly_series_zero_filled(spark, d):
    return A.monthly_series(table(spark, d, "orders"), "o_orderdate", ORDERS_AS_OF, 24)


def group_sparks(spark, d):
    sparks = A.group_sparks(table(spark, d, "orders"), "o_custkey", "o_orderdate", ORDERS_AS_OF, 12)
    return sparks.select("o_custkey", F.posexplode("spark").alias("month_no", "n"))


def kpi_trend(spark, d):
    return A.kpi_trend(table(spark, d, "events"), ["event_type"], "ts", EVENTS_AS_OF, 14)


def daily_buckets(spark, d):
    return A.daily_series(table(spark, d, "events"), "ts", EVENTS_AS_OF, 30)


def coverage_matrix(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return A.coverage_matrix(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_returnflag", "p_brand", "l_suppkey", ["R", "A"])


def address_rollup(spark, d):
    money = F.col("l_extendedprice").cast("decimal(14,2)")
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).alias("usd"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("btc"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )
    hits = table(spark, d, "supplier").where(A.contains_ci("#00000000", "s_name"))
    out = hits.join(lines, F.col("s_suppkey") == F.col("l_suppkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c + "_day")
    return out.select("s_suppkey", "s_name", "n", F.col("usd").cast("double").alias("usd"), F.col("btc").cast("double").alias("btc"), day("first"), day("last"))


def rollup_summary(spark, d):
    return address_rollup(spark, d).agg(F.count(F.lit(1)).alias("addresses"), F.sum("n").alias("n"), F.bround(F.sum("usd"), 2).alias("usd"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def search_ilike_escape(spark, d):
    like = A.like_escape("d_g")
    part = table(spark, d, "part")
    wild = F.col("p_name").ilike("%D G%") | F.col("p_brand").ilike("%#1_%") | F.col("p_name").ilike(f"%{like}%")
    return part.where(wild).select("p_partkey", "p_name", "p_brand")


def given_filters(spark, d):
    df = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    for column, value in (("c_mktsegment", "MACHINERY"), ("o_orderstatus", ""), ("o_orderpriority", "1-URGENT")):
        if value:
            df = df.where(F.col(column) == value)
    return df.select("o_orderkey", "c_name", "o_orderpriority")


def page_n(spark, d):
    orders = table(spark, d, "orders")
    return A.page(orders, 3, 50, F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def page_totals(spark, d):
    return A.page_counts(table(spark, d, "orders"), 50)


def triage_tiers(spark, d):
    strength = F.coalesce(F.try_element_at(F.create_map(F.lit("error"), F.lit(0), F.lit("purchase"), F.lit(1), F.lit("signup"), F.lit(2)), F.col("event_type")), F.lit(9))
    out = A.triage(table(spark, d, "events"), "ts", F.col("value") < 50, strength, EVENTS_AS_OF, 7)
    return out.groupBy("tier", "strength").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


def activity_counters(spark, d):
    recent = table(spark, d, "events").where(A.in_period(F.col("ts"), EVENTS_AS_OF, "7d"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def filter_menu(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


def last_update(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderkey").alias("last_id"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


def top_countries_per_group(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    supplier, part = table(spark, d, "supplier"), table(spark, d, "part")
    cells = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "s_nationkey").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "s_nationkey"))
    return cells.withColumn("place", place).where("place <= 5")


def tools_by_category(spark, d):
    parts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first_tool"))
    held = parts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("by_type"), F.sum("n").alias("total"))
    return held.select("p_brand", "total", F.explode("by_type").alias("p_type", "n"))


def pipeline_rollup(spark, d):
    events = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("large"))
    orders = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.countDistinct(F.year("o_orderdate")).alias("years"))
    docs = table(spark, d, "documents").agg(F.count_if(F.length("text") > 1000).alias("long_texts"), F.countDistinct("source").alias("sources"))
    return events.crossJoin(orders).crossJoin(docs)


def map_counts(spark, d):
    counts = country_counts_window(spark, d)
    return counts.select("n_name", "n", F.round(F.log1p("n"), 6).alias("shade"))


def funnel_counters(spark, d):
    e = table(spark, d, "events")
    user = lambda kind: F.countDistinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    out = e.agg(F.countDistinct("user_id").alias("total"), user("signup").alias("finished"), user("error").alias("refused"))
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("finished")).cast("long"))


QUERIES = {f.__name__: f for f in (
    top_groups_window, country_counts_window, groups_with_zero, kpi_distinct_window, global_counts, monthly_series_zero_filled, group_sparks, kpi_trend, daily_buckets,
    coverage_matrix, address_rollup, rollup_summary, search_ilike_escape, given_filters, page_n, page_totals, triage_tiers, activity_counters, filter_menu, last_update,
    top_countries_per_group, tools_by_category, pipeline_rollup, map_counts, funnel_counters,
)}

_COUNTRIES = """SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY AND o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY n_name"""
_ROLLUP = """SELECT s_suppkey, s_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS usd, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS btc,
strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '#00000000') GROUP BY s_suppkey, s_name"""

ORACLES = {
    "top_groups_window": """SELECT c_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY AND o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY c_custkey, c_name ORDER BY n DESC, c_custkey LIMIT 10""",
    "country_counts_window": _COUNTRIES,
    "groups_with_zero": """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey
AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 92 DAY AND o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY c_custkey""",
    "kpi_distinct_window": """SELECT count(*) AS incidents, count(DISTINCT o_custkey) AS groups, count(DISTINCT o_orderpriority) AS priorities FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '2001-08-01'""",
    "global_counts": " UNION ALL ".join(f"SELECT '{t}' AS what, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "nation", "supplier")),
    "monthly_series_zero_filled": """WITH c AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(TIMESTAMP '1999-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) t(m)),
o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY 1)
SELECT month, coalesce(n, 0) AS n FROM c LEFT JOIN o USING (month)""",
    "group_sparks": """WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-09-01' AND o_orderdate <= TIMESTAMP '2001-08-01'),
m AS (SELECT i AS month_no, strftime(TIMESTAMP '2000-09-01' + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month FROM range(12) t(i)),
o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '2001-08-01' GROUP BY 1, 2)
SELECT k.o_custkey, CAST(month_no AS INTEGER) AS month_no, coalesce(n, 0) AS n FROM k CROSS JOIN m LEFT JOIN o ON o.o_custkey = k.o_custkey AND o.month = m.month""",
    "kpi_trend": """WITH c AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31') AS current, count(*) FILTER (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-17') AS previous FROM events GROUP BY 1)
SELECT event_type, current, previous, CAST(round_even((current - previous) * 100.0 / nullif(previous, 0), 0) AS BIGINT) AS pct FROM c""",
    "daily_buckets": """WITH c AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d)),
e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM c LEFT JOIN e USING (day)""",
    "coverage_matrix": """WITH c AS (SELECT l_returnflag, p_brand, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_returnflag, p_brand, n, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS row_rank, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, p_brand) AS place, (SELECT max(n) FROM c) AS peak FROM c""",
    "address_rollup": _ROLLUP,
    "rollup_summary": f"SELECT count(*) AS addresses, CAST(sum(n) AS BIGINT) AS n, round_even(sum(usd), 2) AS usd, min(first_day) AS first_day, max(last_day) AS last_day FROM ({_ROLLUP})",
    "search_ilike_escape": r"SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%D G%' OR p_brand ILIKE '%#1_%' OR p_name ILIKE '%d\_g%' ESCAPE '\'",
    "given_filters": "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT'",
    "page_n": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100",
    "page_totals": "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM orders",
    "triage_tiers": """WITH t AS (SELECT event_id, CASE WHEN NOT value < 50 THEN 0 WHEN ts >= TIMESTAMP '2024-01-24' THEN 1 ELSE 2 END AS tier,
CASE WHEN value < 50 THEN 0 WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 9 END AS strength FROM events)
SELECT tier, strength, count(*) AS n, max(event_id) AS newest FROM t GROUP BY 1, 2""",
    "activity_counters": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1",
    "filter_menu": "SELECT DISTINCT source, lang FROM documents",
    "last_update": "SELECT max(o_orderkey) AS last_id, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders",
    "top_countries_per_group": """WITH c AS (SELECT p_brand, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, s_nationkey, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, s_nationkey) AS place FROM c QUALIFY place <= 5""",
    "tools_by_category": "SELECT p_brand, CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS BIGINT) AS total, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type",
    "pipeline_rollup": """SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events WHERE value > 100) AS large,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS years,
(SELECT count(*) FROM documents WHERE length(text) > 1000) AS long_texts, (SELECT count(DISTINCT source) FROM documents) AS sources""",
    "map_counts": f"SELECT n_name, n, round(ln(1 + n), 6) AS shade FROM ({_COUNTRIES})",
    "funnel_counters": """SELECT count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (event_type = 'signup') AS finished, count(DISTINCT user_id) FILTER (event_type = 'error') AS refused,
greatest(0, count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (event_type = 'signup')) AS pending FROM events""",
}
