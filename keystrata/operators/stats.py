"""Counters, latency histograms and INFO."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.numbers import human_bytes
from keystrata.operators.reads import entry_size

BUCKETS = 24


def latency_bucket(us: Column) -> Column:
    """Power-of-two bucket of a latency in whole microseconds, 0 to 23."""
    v = F.greatest(F.floor(us), F.lit(1))
    return F.least(F.floor(F.log2(v + F.lit(0.0))), F.lit(BUCKETS - 1)).cast("int")


def histogram(df: DataFrame, us: Column, by: list[str]) -> DataFrame:
    """(by, bucket, n); null latencies are left out."""
    return df.where(us.isNotNull()).groupBy(*by, latency_bucket(us).alias("bucket")).agg(F.count("*").alias("n"))


def percentile_bounds(hist: DataFrame, by: list[str], names: dict[str, float]) -> DataFrame:
    """(by, *names): for each share the upper bound of the bucket in which the count reaches ceil(n * share). All come from one running sum
    over the at most 24 rows of each `by`.
    """
    w = Window.partitionBy(*by)
    run = hist.withColumn("run", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    bound = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.min(F.when(F.col("run") >= F.ceil(F.col("all") * p), F.col("bucket"))) + 1)
    return run.groupBy(*by).agg(*[bound(p).alias(name) for name, p in names.items()])


def percentile_bound(hist: DataFrame, by: list[str], p: float, name: str) -> DataFrame:
    """`percentile_bounds` of one share."""
    return percentile_bounds(hist, by, {name: p})


def hit_ratio(df: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """(by, hits, misses, ratio): ratio 0 without any lookup."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def wal_stats(entries: DataFrame, shard: str, size: Column) -> DataFrame:
    """Bytes of the log by shard, with the total, largest and smallest of all shards beside them."""
    each = entries.groupBy(shard).agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))
    total = each.agg(F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("max_bytes"), F.min("bytes").alias("min_bytes"))
    return each.crossJoin(F.broadcast(total))


def info(sections: dict[str, DataFrame]) -> DataFrame:
    """INFO: (section, name, value) from one-row tables, every column a name."""
    out = None
    for section, df in sections.items():
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "name", "value")
        text = text.select(F.lit(section).alias("section"), "name", "value")
        out = text if out is None else out.unionByName(text)
    return out


def server(mode: str, spark) -> DataFrame:
    """The Server section: version and mode."""
    return spark.createDataFrame([("7.0.0", mode)], "redis_version string, redis_mode string")


def replication(lags: DataFrame) -> DataFrame:
    """The Replication section as (section, name, value) from (node_id, sent, acked, failed, lag, diverged), one row for each replica."""
    names = ["sent", "acked", "failed", "lag", "diverged"]
    text = lags.select("node_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("string").alias(c) for c in names]).unpivot(["node_id"], names, "what", "value")
    each = text.select(F.lit("replication").alias("section"), F.concat_ws("_", F.lit("replica"), F.col("node_id").cast("string"), "what").alias("name"), "value")
    total = lags.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("repl_entries_sent"), F.coalesce(F.sum("failed"), F.lit(0)).alias("repl_errors")).withColumn("role", F.lit("master"))
    return each.unionByName(info({"replication": total}))


def latencystats(df: DataFrame, op: Column, us: Column) -> DataFrame:
    """The Latencystats section as (section, name, value): percentiles (bounds of their buckets), the largest latency and the number of each operation."""
    rows = df.select(op.alias("op"), us.alias("us")).where("op IS NOT NULL")
    bounds = percentile_bounds(histogram(rows, F.col("us"), ["op"]), ["op"], {"p50": 0.5, "p99": 0.99, "p999": 0.999})
    both = rows.groupBy("op").agg(F.count("us").alias("n"), F.coalesce(F.max("us"), F.lit(0)).alias("max")).join(bounds, "op", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    line = F.format_string("p50=%d,p99=%d,p999=%d,max=%d", zero("p50"), zero("p99"), zero("p999"), F.greatest(zero("max"), F.lit(0)))
    both = both.select("op", F.array(F.struct(F.concat(F.lit("latency_percentiles_usec_"), "op").alias("name"), line.alias("value")), F.struct(F.concat("op", F.lit("_ops")).alias("name"), F.col("n").cast("string").alias("value"))).alias("x"))
    return both.select(F.lit("latencystats").alias("section"), F.inline("x"))


def memory(state: DataFrame) -> DataFrame:
    """used_memory and used_memory_human of a state: bytes of keys and values."""
    size = F.sum(entry_size(state)).cast("long")
    return state.agg(F.coalesce(size, F.lit(0)).cast("long").alias("used_memory")).withColumn("used_memory_human", human_bytes(F.col("used_memory")))
