"""Joins, aggregates, windows, sets and event time over the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.operators.joins import as_of_join, interval_join
from kgloom.sources.tables import table


def _t(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def _net():
    """Price after discount, as a decimal, so that sums don't depend on their order."""
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def r_pricing_summary(spark, folder):
    (l,) = _t(spark, folder, "lineitem")
    net = _net()
    rows = l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    two = lambda c: F.round(c, 2)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(two(F.sum("l_quantity").cast("double")).alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), F.sum(net).cast("double").alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def r_revenue_by_nation(spark, folder):
    c, o, l, s, n, r = _t(spark, folder, "customer", "orders", "lineitem", "supplier", "nation", "region")
    rows = c.join(o, c.c_custkey == o.o_custkey).join(l, l.l_orderkey == o.o_orderkey).join(s, (s.s_suppkey == l.l_suppkey) & (s.s_nationkey == c.c_nationkey)).join(n, n.n_nationkey == s.s_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.sum(_net()).cast("double").alias("revenue"))


def r_top_orders(spark, folder):
    c, o, l = _t(spark, folder, "customer", "orders", "lineitem")
    sums = l.groupBy("l_orderkey").agg(F.sum(_net()).cast("double").alias("revenue"))
    got = o.join(sums, o.o_orderkey == sums.l_orderkey).join(c, c.c_custkey == o.o_custkey)
    return got.orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "c_custkey", "revenue")


def r_rollup(spark, folder):
    (l,) = _t(spark, folder, "lineitem")
    return l.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def r_cube(spark, folder):
    o, c = _t(spark, folder, "orders", "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.cube("c_nationkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def r_grouping_sets(spark, folder):
    table(spark, folder, "events").createOrReplaceTempView("kgloom_events")
    return spark.sql("SELECT event_type, year(ts) AS y, count(*) AS n FROM kgloom_events GROUP BY GROUPING SETS ((event_type), (year(ts)), ())")


def r_semi_join(spark, folder):
    c, o = _t(spark, folder, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


def r_anti_join(spark, folder):
    c, o = _t(spark, folder, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def r_full_join(spark, folder):
    c, s = _t(spark, folder, "customer", "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full")


def r_as_of_join(spark, folder):
    """Every purchase with the user's last view before it."""
    (e,) = _t(spark, folder, "events")
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]  # the first two kinds
    left = e.where(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == kinds[1]).select("user_id", "ts", F.col("event_id").alias("before_id"))
    return as_of_join(left, right, ["user_id"], "ts", ["before_id"], tie="event_id").select("event_id", "user_id", "before_id")


def r_interval_join(spark, folder):
    """Parts whose price falls in a band of orders of magnitude, by a join on ranges."""
    (p,) = _t(spark, folder, "part")
    bands = spark.createDataFrame([(i, 900.0 + 100 * i, 1000.0 + 150 * i) for i in range(12)], "band int, low double, high double")
    return interval_join(p.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 100.0).groupBy("band").agg(F.count(F.lit(1)).alias("parts"))


def r_running_total(spark, folder):
    (o,) = _t(spark, folder, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


def r_moving_average(spark, folder):
    (e,) = _t(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return e.select("event_id", F.round(F.avg("value").over(w), 6).alias("average"))


def r_ranks(spark, folder):
    (c,) = _t(spark, folder, "customer")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.select("c_custkey", F.rank().over(w).alias("rank"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent"))


def r_union_distinct(spark, folder):
    c, s = _t(spark, folder, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).unionByName(s.select(F.col("s_nationkey").alias("nation"))).distinct()


def r_intersect(spark, folder):
    o, c = _t(spark, folder, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.select(F.col("c_custkey").alias("k")))


def r_except(spark, folder):
    p, l = _t(spark, folder, "part", "lineitem")
    return p.select(F.col("p_partkey").alias("k")).exceptAll(l.select(F.col("l_partkey").alias("k")).distinct())


def r_decimal_sum(spark, folder):
    (l,) = _t(spark, folder, "lineitem")
    return l.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("string").alias("total"))


def r_distinct_users(spark, folder):
    (e,) = _t(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))


def r_approx_users(spark, folder):
    """Whether the sketch's distinct count is within 10 % of the exact one."""
    (e,) = _t(spark, folder, "events")
    got = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"))
    return got.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close"))


def r_percentiles(spark, folder):
    (e,) = _t(spark, folder, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


def r_pivot(spark, folder):
    o, _ = _t(spark, folder, "orders", "customer")
    return o.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def r_json_props(spark, folder):
    (e,) = _t(spark, folder, "events")
    keys = F.expr("json_object_keys(props)")
    return e.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def o_tumbling(spark, folder):
    (e,) = _t(spark, folder, "events")
    got = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def o_sliding(spark, folder):
    (e,) = _t(spark, folder, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def o_sessions(spark, folder):
    (e,) = _t(spark, folder, "events")
    got = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "n")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("r_", "o_"))}

_TS = "TIMESTAMP"
SQL = {
    "r_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "r_revenue_by_nation": "SELECT r_name, n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
    "r_top_orders": "SELECT o_orderkey, c_custkey, revenue FROM orders JOIN (SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "r_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "r_cube": "SELECT c_nationkey, o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_nationkey, o_orderstatus)",
    "r_grouping_sets": "SELECT event_type, year(ts)::INT AS y, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (year(ts)), ())",
    "r_semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "r_anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "r_full_join": "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) USING (nation)",
    "r_as_of_join": """WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), l AS (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM k)), r AS (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM k))
SELECT event_id, user_id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS before_id FROM l""",
    "r_interval_join": "SELECT band::INT AS band, count(*) AS parts FROM part JOIN (SELECT i AS band, 900.0 + 100 * i AS low, 1000.0 + 150 * i AS high FROM range(12) t(i)) ON p_retailprice >= low AND p_retailprice < high GROUP BY 1",
    "r_running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "r_moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS average FROM events",
    "r_ranks": "SELECT c_custkey, rank() OVER w::INT AS rank, ntile(4) OVER w::INT AS quarter, round(percent_rank() OVER w, 6) AS percent FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)".replace("rank() OVER w::INT", "(rank() OVER w)::INT").replace("ntile(4) OVER w::INT", "(ntile(4) OVER w)::INT"),
    "r_union_distinct": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "r_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer",
    "r_except": "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem",
    "r_decimal_sum": "SELECT l_suppkey, sum(l_extendedprice::DECIMAL(14,2))::VARCHAR AS total FROM lineitem GROUP BY 1",
    "r_distinct_users": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1",
    "r_approx_users": "SELECT DISTINCT event_type, true AS close FROM events",
    "r_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "r_pivot": "SELECT year(o_orderdate)::INT AS year, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1",
    "r_json_props": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "o_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "o_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (i) HOUR AS start FROM events, range(2) t(i)) GROUP BY 1",
    "o_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
