"""Eviction, fragmentation and log files: bulk jobs over the state and the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from keystrata.operators import prefix
from keystrata.operators.reads import entry_size
from keystrata.session import materialize, ship

POLICIES = ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-random", "volatile-random", "volatile-ttl")


def eviction_order(policy: str, seed: int = 0) -> tuple[Column | None, list[Column]]:
    """The rows a policy may take (None for all) and the order in which it takes them."""
    volatile = F.col("expires_at").isNotNull()
    order = {
        "allkeys-lru": (None, [F.col("generation")]),
        "volatile-lru": (volatile, [F.col("generation")]),
        "allkeys-random": (None, [F.xxhash64("key", F.lit(seed))]),
        "volatile-random": (volatile, [F.xxhash64("key", F.lit(seed))]),
        "volatile-ttl": (volatile, [F.col("expires_at"), F.col("generation")]),
    }
    return order[policy]


def _narrowed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """One step of finding a db's cut: its range of leads, divided by 1,024, and of these the part that the cut lies in.

    `cut` (db, lo, hi, need): the `need` first rows of those with lo <= lead <= hi. Out: the same for the part, its leads as they occur.
    """
    inside = rows.join(F.broadcast(cut), "db").where((F.col("lead") >= F.col("lo")) & (F.col("lead") <= F.col("hi")))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("lead") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1023)).otherwise(F.lit(0))
    sizes = inside.groupBy("db", "need", part.alias("part")).agg(F.count("*").alias("n"), F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("db").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before)
    # a db that may not give as many as it should gives all: its last part, whole
    last = F.lead("part").over(Window.partitionBy("db").orderBy("part")).isNull()
    at = (F.col("before") < F.col("need")) & ((F.col("before") + F.col("n") >= F.col("need")) | F.col("last"))
    return sizes.withColumn("last", last).where(at).select("db", "lo", "hi", (F.col("need") - F.col("before")).alias("need"))


def evict(state: DataFrame, policy: str, max_keys: int | None = None, seed: int = 0, *, max_bytes: int | None = None, size: Column | None = None) -> DataFrame:
    """Rows of `state` that are evicted so that each db keeps at most `max_keys` and `max_bytes`; fewer if the policy may not take more.

    An exact set-based form: the excess of each db, taken in the policy's order (ties by key). LRU is by last write, as keys
    carry no read time. `size` gives a row's bytes (by default those of key and value); the first rows are taken whose bytes reach the excess. The state is folded
    once and written; the cut of each db is found in two steps over its range of the order, so only a millionth of a range is ranked by one task (with
    `max_bytes`: a running sum over the leads, and the rows of one lead are ranked). Databases are few, so
    what is kept for each of them is broadcast. Rows with a null db are in none and stay.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "noeviction" or (max_keys is None and max_bytes is None):
        return state.where("false")
    may, order = eviction_order(policy, seed)
    lead = order[0].cast("timestamp").cast("double") if policy == "volatile-ttl" else order[0].cast("double")
    size = F.lit(0) if max_bytes is None else entry_size(state) if size is None else size
    held = materialize(state.select("*", lead.alias("lead"), F.coalesce(may, F.lit(False)).alias("may") if may is not None else F.lit(True).alias("may"), size.cast("long").alias("size")), "evict")
    names = state.columns
    of = F.when(F.col("may"), F.col("lead"))
    over = held.groupBy("db").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes"), F.min(of).alias("lo"), F.max(of).alias("hi"))
    rows = held.where("may")
    if max_bytes is None:
        cut = over.select("db", "lo", "hi", (F.col("keys") - max_keys).alias("need")).where("need > 0 AND lo IS NOT NULL")
        cut = materialize(_narrowed(rows, _narrowed(rows, cut)), "evict-cut")
        asked = rows.join(F.broadcast(cut), "db").where(F.col("lead") <= F.col("hi"))
        whole = asked.where(F.col("lead") < F.col("lo"))
        ranked = asked.where(F.col("lead") >= F.col("lo")).withColumn("rn", F.row_number().over(Window.partitionBy("db").orderBy(*order, "key")))
        return whole.select(*names).unionByName(ranked.where(F.col("rn") <= F.col("need")).select(*names))
    more_keys = F.lit(0) if max_keys is None else F.col("keys") - max_keys
    excess = over.select("db", more_keys.alias("more_keys"), (F.col("bytes") - max_bytes).alias("more_bytes")).where("more_keys > 0 OR more_bytes > 0")
    asked = rows.join(F.broadcast(excess), "db")
    leads = asked.groupBy("db", "lead", "more_keys", "more_bytes").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    for c, name in (("n", "k0"), ("bytes", "b0")):
        leads = prefix.running_sum(leads, ["db"], "lead", F.col(c), name, before=True)
    leads = leads.where("k0 < more_keys OR b0 < more_bytes").select("db", "lead", "k0", "b0", F.expr("k0 + n <= more_keys OR b0 + bytes <= more_bytes").alias("whole"))
    asked = asked.join(leads, ["db", "lead"])
    w = Window.partitionBy("db", "lead").orderBy(*order, "key")
    part = asked.where("NOT whole").withColumn("rn", F.row_number().over(w)).withColumn("begun", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return asked.where("whole").select(*names).unionByName(part.where("k0 + rn <= more_keys OR b0 + begun < more_bytes").select(*names))


def over_capacity(log: DataFrame, max_keys: int | None, tie: str | None = "entry_id", *, max_bytes: int | None = None) -> DataFrame:
    """noeviction with a cap: the PUTs of `log` (kind, db, key, generation) as (db, key, generation, oom), where `oom` is whether the
    db holds `max_keys` keys at that moment and this one isn't among them.

    PUTs and DELETEs of a db go in the order of the generations: a refused PUT leaves nothing, so a later one of its key is asked
    again; a DELETE frees the slot. The same generation of a key again is the same change; of such rows the one with the lowest
    `tie` counts. An expired key keeps its slot until it is deleted. With `max_bytes`, and value_bytes in the log (see `reads.with_sizes`), a PUT is also refused if the bytes of keys
    and values would be more, and then leaves the old value. A db is one task's stream, with at most `max_keys` keys as its
    state: what is refused hangs on all that was admitted before.
    """
    ship(log.sparkSession)
    rows = log.where(F.col("kind").isin("PUT", "DELETE")).select("db", "key", "generation", (F.col("kind") == "PUT").alias("put"), (F.octet_length("key") + (F.lit(0) if max_bytes is None else F.col("value_bytes"))).cast("long").alias("size"), *([tie] if tie else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held, total, begun = None, None, {}, 0, False
        for b in batches:
            taken, oom = [], []
            for i, (db, key, generation, put, size) in enumerate(zip(*(b[c].to_pylist() for c in ("db", "key", "generation", "put", "size")))):
                if not begun or db != at:
                    at, last, held, total, begun = db, None, {}, 0, True
                if (generation, key) == last:
                    continue
                last = (generation, key)
                if not put:
                    total -= held.pop(key, 0)
                    continue
                more = size - held.get(key, 0)
                refused = (max_keys is not None and key not in held and len(held) >= max_keys) or (max_bytes is not None and total + more > max_bytes)
                if not refused:
                    held[key] = size
                    total += more
                taken.append(i)
                oom.append(refused)
            own = b.select(["db", "key", "generation"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(oom, pa.bool_())], names=["db", "key", "generation", "oom"])

    out = StructType([*rows.select("db", "key", "generation").schema.fields, StructField("oom", BooleanType())])
    return rows.repartition("db").sortWithinPartitions("db", "generation", "key", *([tie] if tie else [])).mapInArrow(run, out)


def utilization(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Live share of the records of each `by`: 1.0 where there are none; nulls of live_records count as 0."""
    live, total = F.sum(F.coalesce("live_records", F.lit(0))), F.sum(F.coalesce("total_records", F.lit(0)))
    return blocks.groupBy(*by).agg(live.cast("long").alias("live"), total.cast("long").alias("total")).withColumn(
        "utilization", F.when(F.col("total") > 0, F.col("live") / F.col("total")).otherwise(F.lit(1.0)))


def fragmented(blocks: DataFrame, by: list[str], below: float = 0.5, at_least: int = 10, at_most: int = 100) -> DataFrame:
    """Compaction candidates: blocks with a utilization under `below`, the emptiest first, at most `at_most` of a run (a
    documented limit of the job: the next run takes the rest); none if there are fewer than `at_least`.
    """
    found = utilization(blocks, by).where(F.col("utilization") < below)
    top = found.orderBy("utilization", *by).limit(at_most)
    n = found.agg(F.count("*").alias("found"))
    return top.crossJoin(F.broadcast(n)).where(F.col("found") >= at_least).drop("found")


def unlinkable(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Files of which no block holds a live record: (by, blocks). Nulls of live_records count as live: such a file is kept."""
    each = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.max(F.coalesce("live_records", F.lit(1))).alias("most"))
    return each.where("most <= 0").drop("most")


def candidates(state: DataFrame, shard: Column, per_shard: int = 1, seed: int = 0) -> DataFrame:
    """Eviction candidates by sampling: of each db and shard the `per_shard` keys first in the order of a seeded hash (ties by key).

    Only keys go through the partial aggregate; `per_shard` bounds what a shard holds.
    """
    drawn = state.select("db", shard.alias("shard"), F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), "key", "generation").alias("c"))
    if per_shard == 1:
        return drawn.groupBy("db", "shard").agg(F.min("c").alias("c")).select("db", "shard", "c.key", "c.generation")
    w = Window.partitionBy("db", "shard").orderBy("c")
    return drawn.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_shard).select("db", "shard", "c.key", "c.generation")


def compact(log: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of `log` that are the present image of their key: what a rewrite keeps, generations unchanged."""
    return log.join(state.select("db", "key", "generation"), ["db", "key", "generation"], "left_semi").dropDuplicates(["db", "key", "generation"])


def log_files(entries: DataFrame, by: str, order: str, size: Column, max_bytes: int) -> DataFrame:
    """Log rotation: `entries` with `file_no`, a new one for every `max_bytes` of a shard's log in its order."""
    begun = prefix.running_sum(entries, [by], order, size, "begun", before=True)
    return begun.withColumn("file_no", F.floor(F.col("begun") / max_bytes).cast("long")).drop("begun")


def retention(files: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """Files to delete: all but the newest `keep` of each `by`."""
    return files.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("rn") > keep).drop("rn")
