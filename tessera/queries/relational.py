"""Relational queries over the star tables: what Spark gives natively."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.queries.registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    """Sums by flag and status; the filter reaches the scan."""
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (n_name, o_orderpriority)""")
def orders_cube(t):
    """Orders by nation and priority, with all totals."""
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.cube("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def customers_rollup(t):
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def customers_without_orders(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def returned_suppliers(t):
    return t.supplier.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("""SELECT p_partkey FROM part WHERE p_size > 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40""")
def part_intersect(t):
    return t.part.where("p_size > 20").select("p_partkey").intersect(t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")))


@query("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def part_except(t):
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("""SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def large_orders(t):
    """Orders half as large again as their customer's mean."""
    mean = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    return t.orders.withColumn("mean", mean).where(F.col("o_totalprice") > 1.5 * F.col("mean")).select("o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) SELECT * FROM r WHERE rank <= 3""")
def top_customers(t):
    """The three largest balances of each nation."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("""SELECT e.event_id, max_by(p.event_id, p.event_id) AS purchase FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id WHERE e.event_type = 'error' GROUP BY e.event_id""")
def asof_purchase(t):
    """The last purchase before each error of a user: an as-of join as one window, without a range join."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return t.events.withColumn("purchase", last).where("event_type = 'error' AND purchase IS NOT NULL").select("event_id", "purchase")
