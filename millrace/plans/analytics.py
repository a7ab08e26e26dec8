"""Relational, window and time queries of the engine over the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


def customer_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation over three equi-joins; small dimensions are left to the optimiser to broadcast."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.cube("year", "o_orderstatus").agg(F.count("*").alias("orders"), F.grouping_id().alias("level"))


def semi_anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an open order and none that is part-shipped."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    has = c.join(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return has.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with both suppliers and customers, less those of region 0."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return s.intersect(c).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("nation")))


def ranking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer with rank, previous price and running total: one shuffle, one sort."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("position"), F.lag("o_totalprice").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(w).cast("long").alias("quarter")
    )


def range_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user within the hour before each event, by a range frame."""
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-3600, 0)
    rows = table(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")).cast("long") / 1_000_000)
    return rows.withColumn("sec", F.floor("sec")).select("event_id", F.count("*").over(w).alias("recent"))


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's latest view before it: one union, one window, no pairwise join."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within ten minutes after a click of the same user, by a join on ten-minute ranges."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    width = 600_000_000
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("us").alias("from"))
    clicks = clicks.withColumn("range", F.explode(F.array(F.floor(F.col("from") / width), F.floor(F.col("from") / width) + 1)))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "us").withColumn("range", F.floor(F.col("us") / width))
    return clicks.join(errors, ["user_id", "range"]).where((F.col("us") >= F.col("from")) & (F.col("us") <= F.col("from") + width)).select("click_id", "error_id")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("present"))


def map_and_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits and specifications of the registry in long form, counted by key."""
    e = table(spark, sf_dir, "equipment")
    limits = e.select(F.explode(F.map_keys("oem_thresholds")).alias("key"), F.lit("limit").alias("kind"))
    specs = e.select(F.explode(F.map_keys("specifications")).alias("key"), F.lit("specification").alias("kind"))
    return limits.unionByName(specs).groupBy("kind", "key").agg(F.count("*").alias("machines"))


def distinct_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts within five per cent, and the error they have."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about"), F.count_distinct("l_orderkey").alias("exact"))
    return rows.select("l_returnflag", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_linestatus").agg(F.round(F.stddev("l_quantity"), 6).alias("deviation"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.skewness("l_discount"), 4).alias("skew"))


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand: a report's top three."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("p_brand", "p_partkey", "rank")


def recursive_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer chained to the next one, up to three links, with days between.

    The links are looked up ahead in one window: Spark's recursion stops with an error beyond
    a million rows (spark.sql.cteRecursionRowLimit) and joins all orders again at each link.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ahead = [F.struct(F.lit(n).alias("links"), F.lead("o_orderkey", n).over(w).alias("next"), F.datediff(F.lead("o_orderdate", n).over(w), "o_orderdate").cast("long").alias("days")) for n in (1, 2, 3)]
    chain = table(spark, sf_dir, "orders").select(F.array(*ahead).alias("ahead")).select(F.inline("ahead")).where("next IS NOT NULL")
    return chain.groupBy("links").agg(F.count("*").alias("chains"), F.sum("days").alias("days"))


QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, customer_revenue, rollup_counts, semi_anti_customers, set_operations, ranking_windows, range_frames, tumbling_window, sliding_window, session_windows, asof_latest, interval_join,
        json_extract, map_and_array, distinct_aggregates, approximate_aggregates, statistics, topk_per_group, recursive_chain,
    )
}
SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""",
    "customer_revenue": "SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "rollup_counts": """
        SELECT CAST(year AS INTEGER) AS year, o_orderstatus, count(*) AS orders, CAST(grouping(year, o_orderstatus) AS BIGINT) AS level
        FROM (SELECT year(o_orderdate) AS year, o_orderstatus FROM orders) GROUP BY CUBE (year, o_orderstatus)""",
    "semi_anti_customers": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "set_operations": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "ranking_windows": """
        SELECT o_orderkey, row_number() OVER w AS position, lag(o_totalprice) OVER w AS previous,
          round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, ntile(4) OVER w AS quarter
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "range_frames": """
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events""",
    "tumbling_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_window": """
        SELECT start, count(*) AS events FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
    "session_windows": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, session""",
    "asof_latest": """
        WITH e AS (SELECT * FROM events WHERE event_type IN ('purchase', 'view')),
        s AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM e)
        SELECT event_id, view_id FROM s WHERE event_type = 'purchase'""",
    "interval_join": """
        SELECT c.event_id AS click_id, e.event_id AS error_id FROM events c JOIN events e ON e.user_id = c.user_id AND e.ts BETWEEN c.ts AND c.ts + INTERVAL 10 MINUTE
        WHERE c.event_type = 'click' AND e.event_type = 'error'""",
    "json_extract": """
        SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(k) AS present FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""",
    "map_and_array": """
        SELECT 'limit' AS kind, key, count(*) AS machines FROM (SELECT unnest(map_keys(oem_thresholds)) AS key FROM equipment) GROUP BY 1, 2
        UNION ALL SELECT 'specification', key, count(*) FROM (SELECT unnest(map_keys(specifications)) AS key FROM equipment) GROUP BY 1, 2""",
    "distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "approximate_aggregates": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS close FROM lineitem GROUP BY 1",
    "statistics": """
        SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS deviation, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
          round((avg(l_discount * l_discount * l_discount) - 3 * avg(l_discount) * avg(l_discount * l_discount) + 2 * pow(avg(l_discount), 3)) / pow(var_pop(l_discount), 1.5::DOUBLE), 4) AS skew FROM lineitem GROUP BY 1""",
    "topk_per_group": "WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT * FROM k WHERE rank <= 3",
    "recursive_chain": """
        WITH o AS (SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER w AS n1, lead(o_orderkey, 2) OVER w AS n2, lead(o_orderkey, 3) OVER w AS n3,
          date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS d1, date_diff('day', o_orderdate, lead(o_orderdate, 2) OVER w) AS d2, date_diff('day', o_orderdate, lead(o_orderdate, 3) OVER w) AS d3
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        c AS (SELECT 1 AS links, d1 AS days FROM o WHERE n1 IS NOT NULL UNION ALL SELECT 2, d2 FROM o WHERE n2 IS NOT NULL UNION ALL SELECT 3, d3 FROM o WHERE n3 IS NOT NULL)
        SELECT links, count(*) AS chains, CAST(sum(days) AS BIGINT) AS days FROM c GROUP BY links""",
}
