"""Queries p2 and p4: incremental reading of the log, and its present state through delete vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.keys import key_hex
from keystrata.operators.changefeed import VectorTable, changes
from keystrata.operators.incremental import IncrementalState, binary_hash, read_by_runs, row_hash
from keystrata.session import table, work_dir

#: The history of runs is replayed in so many successive runs of the operator, and the log applied in so many batches.
WAVES = 3


def committed_runs(runs: DataFrame) -> DataFrame:
    """run_id, shard, upto of successful attempts."""
    return runs.where(F.lower("status") == "committed").select("run_id", "shard", F.col("read_upto").alias("upto"))


def p2_found(spark: SparkSession, sf: str, waves: int = WAVES) -> DataFrame:
    runs = committed_runs(table(spark, sf, "ingest_runs"))
    state = IncrementalState(spark, work_dir(spark, "p2"), history=True)
    log = changes(table(spark, sf, "kv_log")).select("entry_id", "db", "key", "generation", "shard", "arrived_at")
    us = F.unix_micros(F.col("upto").cast("timestamp"))
    cuts = runs.agg(F.percentile_approx(us, [i / waves for i in range(1, waves)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    moment = lambda t: F.timestamp_micros(F.lit(t)).cast("timestamp_ntz")
    for lo, hi in zip(edges, edges[1:]):
        wave, rows = runs.where("shard IS NOT NULL AND upto IS NOT NULL"), log
        if hi is not None:
            wave, rows = wave.where(us <= hi), rows.where(F.col("arrived_at") <= moment(hi))
        if lo is not None:
            # where each shard was read up to before; what arrived by then is not looked at again
            before = wave.where(us <= lo).groupBy("shard").agg(F.max("upto").alias("upto"))
            shards = wave.select("shard").distinct().join(before, "shard", "left").agg(F.count_if(F.col("upto").isNull()), F.min("upto")).first()
            wave = wave.where(us > lo).unionByName(before.select(F.lit(None).cast(wave.schema["run_id"].dataType).alias("run_id"), "shard", "upto"))
            rows = rows.where(F.col("arrived_at") > F.lit(shards[1])) if not shards[0] and shards[1] is not None else rows
        seen = read_by_runs(rows, F.col("shard"), F.col("arrived_at"), wave).where("run_id IS NOT NULL")
        state.run(
            seen, row_hash(F.col("db"), F.hex("key")), row_hash(F.col("generation")), [F.col("upto"), F.col("entry_id")], payload=["entry_id", "run_id"], note={"upto": hi})
    return state.rows().select("run_id", "entry_id")


def p4_found(spark: SparkSession, sf: str, batches: int = WAVES) -> DataFrame:
    log = changes(table(spark, sf, "kv_log")).select("entry_id", "db", "key", "generation", "kind")
    held = VectorTable(spark, work_dir(spark, "p4"))
    lo, hi = table(spark, sf, "kv_log").agg(F.min("entry_id"), F.max("entry_id")).first()
    if lo is not None:
        step = (hi - lo) // batches + 1
        for b in range(batches):
            held.apply(log.where((F.col("entry_id") >= lo + b * step) & (F.col("entry_id") < lo + (b + 1) * step)))
    return held.read().select("db", key_hex(F.col("key")).alias("key_hex"), "generation")


_CHANGES = """
  SELECT *, CASE WHEN op IS NOT NULL THEN upper(trim(op)) WHEN entry_type = 1 THEN 'PUT' WHEN entry_type = 2 THEN 'DELETE' END AS kind
  FROM kv_log WHERE key IS NOT NULL AND generation IS NOT NULL"""

QUERIES = {"p2_found": p2_found, "p4_found": p4_found}
SQL = {
    "p2_found": f"""WITH c AS (SELECT * FROM ({_CHANGES}) WHERE kind IN ('PUT', 'DELETE')),
      r AS (SELECT shard, read_upto, min(run_id) AS run_id FROM ingest_runs WHERE lower(status) = 'committed' AND read_upto IS NOT NULL GROUP BY ALL),
      x AS (SELECT c.entry_id, c.db, c.key, c.generation, r.run_id, r.read_upto FROM c ASOF JOIN r ON c.shard = r.shard AND c.arrived_at <= r.read_upto)
      SELECT run_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY db, key, generation ORDER BY read_upto, entry_id) AS n FROM x) WHERE n = 1""",
    "p4_found": f"""SELECT db, lower(hex(key)) AS key_hex, generation FROM (
      SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY generation DESC) AS n FROM ({_CHANGES}) WHERE kind IN ('PUT', 'DELETE'))
      WHERE n = 1 AND kind = 'PUT'""",
}
