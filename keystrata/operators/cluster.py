"""Slots, nodes and routing as tables: slots (slot, primary, replicas, state), nodes (node_id, addresses, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.slots import SLOTS
from keystrata.operators import prefix


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with `rank`, their place by node_id from 0. A cluster's nodes are few; this is one small task."""
    return nodes.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("rank"))


def assign(spark: SparkSession, nodes: DataFrame, replication: int = 1) -> DataFrame:
    """(slot, primary, replicas): equal runs of slots in the order of the node ids; replicas are the nodes that follow.

    Without nodes there are no rows. A factor above the number of nodes gives each slot all other nodes.
    """
    ids = nodes.agg(F.array_sort(F.collect_set("node_id")).alias("ids")).where(F.size("ids") > 0)
    n = F.size("ids")
    at = F.least((F.col("slot") / F.ceil(F.lit(SLOTS) / n)).cast("int"), n - 1)
    copies = F.least(F.lit(replication), n) - 1
    follow = F.when(copies > 0, F.transform(F.sequence(F.lit(1), copies), lambda i: F.element_at("ids", (F.col("at") + i) % F.size("ids") + 1)))
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).crossJoin(F.broadcast(ids)).withColumn("at", at).select(
        "slot", F.element_at("ids", F.col("at") + 1).alias("primary"), F.coalesce(follow, F.array().cast("array<int>")).alias("replicas"))


def ranges(slots: DataFrame, by: str = "primary") -> DataFrame:
    """(by, first, last): contiguous runs of slots of one owner (gaps and islands)."""
    island = F.col("slot") - F.row_number().over(Window.partitionBy(by).orderBy("slot"))
    return slots.withColumn("island", island).groupBy(by, "island").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).drop("island")


def rebalance(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slot, old, new): the slots that change owner when they are dealt out over the active nodes; replicas of 1."""
    new = assign(slots.sparkSession, nodes.where("status = 'active'"))
    return slots.select("slot", F.col("primary").alias("old")).join(new.select("slot", F.col("primary").alias("new")), "slot").where(~F.col("old").eqNullSafe(F.col("new")))


def route(keyed: DataFrame, slot: Column, slots: DataFrame, nodes: DataFrame, here: int) -> DataFrame:
    """`keyed` with slot, `moved`: null where node `here` owns the slot, else `MOVED <slot> <address>`; slots and nodes are small."""
    owner = slots.join(nodes.select(F.col("node_id").alias("primary"), "redis_addr"), "primary", "left").select("slot", "primary", "redis_addr")
    j = keyed.withColumn("slot", slot).join(F.broadcast(owner), "slot", "left")
    moved = F.when(F.col("primary").isNull(), "CLUSTERDOWN Hash slot not served").when(F.col("primary") != here, F.concat_ws(" ", F.lit("MOVED"), F.col("slot").cast("string"), "redis_addr"))
    return j.withColumn("moved", moved).drop("primary", "redis_addr")


def cluster_info(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """CLUSTER INFO: (name, value): slots by the status of their primary, nodes known, and the cluster's state."""
    j = slots.join(F.broadcast(nodes.select(F.col("node_id").alias("primary"), F.lower("status").alias("status"))), "primary", "left")
    n = j.agg(F.count("*").alias("cluster_slots_assigned"), F.count_if(F.col("status") == "active").alias("cluster_slots_ok"),
        F.count_if(F.col("status") == "suspect").alias("cluster_slots_pfail"), F.count_if(F.col("status") == "dead").alias("cluster_slots_fail"))
    n = n.crossJoin(nodes.agg(F.count("*").alias("cluster_known_nodes")))
    n = n.withColumn("cluster_state", F.when((F.col("cluster_slots_assigned") == SLOTS) & (F.col("cluster_slots_fail") == 0), "ok").otherwise("fail"))
    return n.select(*[F.col(c).cast("string").alias(c) for c in n.columns]).unpivot([], n.columns, "name", "value")


def cluster_slots(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """CLUSTER SLOTS: (first, last, primary, redis_addr) by range."""
    return ranges(slots).join(F.broadcast(nodes.select(F.col("node_id").alias("primary"), "redis_addr")), "primary", "left").select("first", "last", "primary", "redis_addr")


def cluster_nodes(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """CLUSTER NODES: each node with its status, number of slots and ranges as text, as in `0-5461 5470`."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    own = ranges(slots).groupBy("primary").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), " ").alias("ranges"),
        F.sum(F.col("last") - F.col("first") + 1).alias("slots"))
    return nodes.join(own, nodes["node_id"] == own["primary"], "left").select("node_id", "redis_addr", "status", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("ranges", F.lit("")).alias("ranges"))


def health(beats: DataFrame, node: str, order: str, missed: Column, suspect: int = 3, dead: int = 6) -> DataFrame:
    """`beats` with `misses` (consecutive misses up to the row) and `health`: active, suspect or dead; any answer makes it active."""
    n = prefix.running_since(beats, [node], order, ~missed, F.when(missed, F.lit(1).cast("long")), "misses", "answers").drop("answers")
    return n.withColumn("health", F.when(F.col("misses") >= dead, "dead").when(F.col("misses") >= suspect, "suspect").otherwise("active"))


def replica_lag(counters: DataFrame) -> DataFrame:
    """Replicas (node_id, sent, acked, failed) with `lag` (never negative) and `diverged`; nulls count as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counters.select("node_id", F.greatest(z("sent") - z("acked"), F.lit(0)).cast("long").alias("lag"), (z("failed") > 0).alias("diverged"))
