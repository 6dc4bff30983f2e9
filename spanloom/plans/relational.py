"""Relational queries over the star schema: joins, aggregates, windows, sets and sorts that the other operators rest on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def local_revenue(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def customers_with_large_orders(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_name, count(c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND c_custkey IS NOT NULL GROUP BY n_name")
def nation_outer_counts(t):
    n, c, s = t("nation"), t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c")), t("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    j = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("n_name", (F.coalesce("c", F.lit(0)) * F.greatest(F.lit(1), F.coalesce("s", F.lit(0)))).alias("customers"), F.when(F.col("c") > 0, F.coalesce("s", F.lit(0))).otherwise(0).alias("suppliers"))


@query("SELECT o_orderpriority, o_orderstatus, grouping_id(o_orderpriority, o_orderstatus) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def order_cube(t):
    return t("orders").cube("o_orderpriority", "o_orderstatus").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_orders(t):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").withColumn("r", r).where("r <= 2").select("o_custkey", "o_orderkey", "r")


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def shared_nations(t):
    return t("supplier").select(F.col("s_nationkey").alias("k")).intersect(t("customer").select("c_nationkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def largest_orders(t):
    """A top-k report."""
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_value(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("running"))
