"""Live state of a log: newest generation of each key, without deleted and expired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.changefeed import changes

KEEP = ("value", "ttl_secs", "ts")


def as_time(as_of: str) -> Column:
    """A fixed moment as TIMESTAMP_NTZ."""
    return F.lit(as_of).cast("timestamp_ntz")


def expires_at(ts: Column, ttl_secs: Column) -> Column:
    """When a row expires; null for never: no TTL, TTL 0 or below, or no write time to count from."""
    return F.when(ttl_secs > 0, ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl_secs))


def not_expired(as_of: Column) -> Column:
    """Rows with `expires_at` that a client still sees: at its very second a key is gone."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_of)


def lww(log: DataFrame, order: str = "generation", tie: str | None = "entry_id", keep: tuple[str, ...] = KEEP) -> DataFrame:
    """One row for each (db, key): db, key, generation, kind, `keep`; the row of the highest generation, deletes included.

    `log` must have `kind` (see `changes`). Repeated rows of a change are settled by the lowest `tie`. Order of arrival, shards
    and late rows don't matter; the fold is one partial aggregate and one shuffle by key.
    """
    rank = F.struct(F.col(order), *([-F.col(tie)] if tie else []))
    last = log.groupBy("db", "key").agg(F.max_by(F.struct(F.col(order).alias("generation"), "kind", *keep), rank).alias("r"))
    return last.select("db", "key", "r.*")


def live(log: DataFrame, as_of: Column | None = None, **how) -> DataFrame:
    """`lww` without deleted rows and, at `as_of`, without expired ones; with `expires_at`."""
    s = lww(log, **how).where("kind = 'PUT'").drop("kind").withColumn("expires_at", expires_at(F.col("ts"), F.col("ttl_secs")))
    return s if as_of is None else s.where(not_expired(as_of))


def recover(snapshot: DataFrame, log: DataFrame, **how) -> DataFrame:
    """State of a snapshot (rows with `kind`) and the log written since: the newest generation wins, wherever it stands."""
    return live(snapshot.unionByName(log, allowMissingColumns=True), **how)


def flush(log: DataFrame, marks: DataFrame) -> DataFrame:
    """The log rows that outlive a flush. `marks` (db, upto_generation): rows of that db up to the mark are gone; a null db is all."""
    every = marks.where("db IS NULL").agg(F.max("upto_generation").alias("all_upto"))
    own = marks.where("db IS NOT NULL").groupBy("db").agg(F.max("upto_generation").alias("upto"))
    joined = log.join(F.broadcast(own) if own.count() <= 100_000 else own, "db", "left").crossJoin(F.broadcast(every))
    return joined.where(F.col("generation") > F.greatest(F.coalesce("upto", F.lit(-1)), F.coalesce("all_upto", F.lit(-1)))).drop("upto", "all_upto")


def trim(log: DataFrame, durable: DataFrame) -> DataFrame:
    """Log rows not yet in a snapshot: generation above `durable` (db, durable_generation) of their db; all rows of a db without one."""
    j = log.join(durable, "db", "left")
    return j.where(F.col("durable_generation").isNull() | (F.col("generation") > F.col("durable_generation"))).drop("durable_generation")


def index_stats(log: DataFrame) -> DataFrame:
    """(db, live, tombstones): keys whose newest change is a PUT or a DELETE."""
    return lww(log, keep=()).groupBy("db").agg(F.count_if(F.col("kind") == "PUT").alias("live"), F.count_if(F.col("kind") == "DELETE").alias("tombstones"))


__all__ = ["KEEP", "as_time", "changes", "expires_at", "flush", "index_stats", "live", "lww", "not_expired", "recover", "trim"]
