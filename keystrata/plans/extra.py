"""Relational extensions on the star schema, beyond the store's own commands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.plans.base import query
from keystrata.session import table

_cents = lambda c: F.col(c).cast("decimal(15,2)")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(15,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS sum_base, sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(5,2)))::DOUBLE AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def ext_q1(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    rev = _cents("l_extendedprice") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_cents("l_quantity")).cast("double").alias("sum_qty"), F.sum(_cents("l_extendedprice")).cast("double").alias("sum_base"), F.sum(rev).cast("double").alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(5,2)))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def ext_q5(spark, sf):
    t = lambda n: table(spark, sf, n)
    here = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sup = t("supplier").join(here, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    sold = t("customer").select("c_custkey", "c_nationkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    j = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(sold, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return j.groupBy("n_name").agg(F.sum(_cents("l_extendedprice") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)"))).cast("double").alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) + 0 AS INTEGER) AS all_status, CAST(grouping(o_orderpriority) + 0 AS INTEGER) AS all_priority FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, sf):
    g = table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority")
    return g.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("all_status"), F.grouping("o_orderpriority").cast("int").alias("all_priority"))


@query("SELECT c_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def ext_topk(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "place")


@query("""SELECT user_id, count(*) AS n, min(ts) AS begin_ts, max(ts) AS end_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ext_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    return e.withColumn("s", F.sum("new").over(w)).groupBy("user_id", "s").agg(F.count("*").alias("n"), F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts")).drop("s")
