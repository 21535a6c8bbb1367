"""Relational queries on the star schema: joins, grouping sets, ranking, pivots."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravia.catalog import register
from terravia.fixtures import table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_revenue()), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


_JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _joined(spark, d) -> DataFrame:
    """Sizes decide the join strategies: none is hinted."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))


@register("revenue_by_nation", f"SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM {_JOINED} GROUP BY r_name, n_name")
def revenue_by_nation(spark, d):
    return _joined(spark, d).groupBy("r_name", "n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@register("revenue_rollup", f"SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {_JOINED} GROUP BY ROLLUP (r_name, c_mktsegment)")
def revenue_rollup(spark, d):
    return _joined(spark, d).rollup("r_name", "c_mktsegment").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@register("priority_cube", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def priority_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@register("top_orders_per_customer", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders_per_customer(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@register("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("suppliers_with_returns", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def suppliers_with_returns(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@register("event_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def event_pivot(spark, d):
    counted = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)))
    return counted.fillna(0)


@register("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))
