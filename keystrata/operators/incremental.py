"""Processing only new or changed records: a versioned state of key and content hashes.

A run hashes its rows, joins them with the state, keeps those that are new or changed, and writes them together with their hashes
as one segment. Only the manifest that names the segment makes it part of the state, so a run that fails leaves
nothing behind, and a run that is repeated finds the same rows new again: none is skipped, none comes out twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import bloom
from keystrata.operators.versions import Versions
from keystrata.session import materialize


def row_hash(*columns: Column) -> Column:
    """16 bytes from the values of columns; nulls, empty values and shifted borders give different ones."""
    each = [F.coalesce(F.concat(F.lit("="), F.hex(c.cast("string").cast("binary"))), F.lit("~")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", F.lit("."), *each)))


def binary_hash(*columns: Column) -> Column:
    """As `row_hash`, for binary columns, whose bytes need not be UTF-8."""
    return row_hash(*(F.hex(c) for c in columns))


class IncrementalState:
    """State of the rows seen so far, below `path`.

    `history=True` remembers every content a key has had, so that an old content delivered again is not a change; without it a
    row is a change if its content differs from the key's last one.
    """

    def __init__(self, spark: SparkSession, path: str, *, history: bool = False):
        self.spark, self.path, self.history = spark, path.rstrip("/"), history
        self.versions = Versions(spark, f"{self.path}/state")

    def segments(self) -> list[str]:
        return self.versions.load().get("segments", [])

    def rows(self) -> DataFrame | None:
        """All rows that successful runs have taken, with key_hash, content_hash and run_no; None before the first."""
        s = self.segments()
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in s]) if s else None

    def _known(self, held: DataFrame, batch: DataFrame | None) -> DataFrame:
        """Hashes of the state: all, or of the keys of a batch."""
        held = held.select("key_hash", "content_hash", *([] if self.history else ["run_no"]))
        held = held if batch is None else bloom.touched(held, batch, ["key_hash"])
        return held if self.history else held.groupBy("key_hash").agg(F.max_by("content_hash", "run_no").alias("content_hash"))

    def select_new(self, rows: DataFrame, key: Column, content: Column, order: Sequence[Column], payload: Sequence[str] | None = None) -> DataFrame:
        """Of `rows` those that are new or changed, with key_hash and content_hash and the columns `payload` (all by default).

        `key` and `content` are hashes (`row_hash`). Of rows alike in both (without history: of rows with the same key) one is
        taken: with history the first in `order`, else the last, which is the key's content then. Ties in `order` are
        settled by the columns taken, so a repeated run chooses alike. Null hashes are not allowed; `row_hash` gives none. Where the state is large,
        what is left of `rows` after this choice is written to the shared folder, and only the state's hashes of those keys are joined with it.
        """
        names = payload or rows.columns
        hashed = rows.select(key.alias("key_hash"), content.alias("content_hash"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*names).alias("row")).alias("at"))
        if self.history:
            one = hashed.groupBy("key_hash", "content_hash").agg(F.min("at").alias("at"))
        else:
            last = hashed.groupBy("key_hash").agg(F.max(F.struct("at", "content_hash")).alias("last"))
            one = last.select("key_hash", "last.content_hash", "last.at")
        one = one.select("key_hash", "content_hash", "at.row.*")
        held = self.rows()
        if held is None:
            return one
        if bloom.large(held):
            one = materialize(one, "batch")
            return one.join(self._known(held, one), ["key_hash", "content_hash"], "left_anti")
        return one.join(self._known(held, None), ["key_hash", "content_hash"], "left_anti")

    def run(self, rows: DataFrame, key: Column, content: Column, order: Sequence[Column], *, payload: Sequence[str] | None = None, note: dict | None = None, before_commit=None) -> DataFrame:
        """Take what is new in `rows`, commit it as the next version and return it (from the written segment).

        `payload` names the columns of `rows` that are kept, all by default. `note` is kept in the manifest. `before_commit` is called between writing and committing; if it raises, the state is as
        before. The columns key_hash, content_hash and run_no of `rows`, if any, are left out.
        """
        manifest, number = self.versions.load(), self.versions.number() + 1
        names = [c for c in payload or rows.columns if c not in ("key_hash", "content_hash", "run_no")]
        fresh = self.select_new(rows, key, content, order, names).withColumn("run_no", F.lit(number).cast("long"))
        segment = f"segment-{number:09d}-{uuid.uuid4().hex[:8]}"
        fresh.write.parquet(f"{self.path}/{segment}")
        if before_commit:
            before_commit()
        self.versions.commit(number, manifest | {"segments": [*manifest.get("segments", []), segment], "note": note or {}})
        return self.spark.read.parquet(f"{self.path}/{segment}")


    def compact(self) -> int:
        """Write all segments as one, which costs a scan and no shuffle; the rows and their run numbers stay as they are. Returns the version."""
        manifest, number = self.versions.load(), self.versions.number() + 1
        if len(self.segments()) < 2:
            return number - 1
        segment = f"segment-{number:09d}-{uuid.uuid4().hex[:8]}"
        self.rows().write.parquet(f"{self.path}/{segment}")
        self.versions.commit(number, manifest | {"segments": [segment]})
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete segments that the last `keep` versions don't name: of failed runs, and those that were compacted."""
        return self.versions.remove(self.path, keep)


def read_by_runs(rows: DataFrame, shard: Column, at: Column, runs: DataFrame, *, broadcast_rows: int = 500_000) -> DataFrame:
    """`rows` with `run_id` and `upto`: the run of their shard with the smallest `upto` not before `at`; others drop out.

    `runs` has run_id, shard and upto (TIMESTAMP_NTZ); nulls in shard or upto read nothing; of runs with the same shard and
    `upto` the smallest run_id counts. An as-of join: the span between two reads is cut into equal slots of time, rows and spans
    meet in their slot, so a row meets few spans whatever the number of runs. The spans are broadcast if at most
    `broadcast_rows`; beyond that the join is shuffled by shard and slot.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    clean = runs.where("shard IS NOT NULL AND upto IS NOT NULL").groupBy("shard", "upto").agg(F.min("run_id").alias("run_id"))
    clean = clean.select(F.col("shard").alias("of_shard"), "upto", "run_id", us(F.col("upto")).alias("hi"))
    low, high, n, shards = clean.agg(F.min("hi"), F.max("hi"), F.count("*"), F.count_distinct("of_shard")).first()
    if not n:
        return rows.withColumn("run_id", F.lit(None).cast(runs.schema["run_id"].dataType)).withColumn("upto", F.lit(None).cast("timestamp_ntz")).where("false")
    width = max(1, (high - low) * shards // n + 1)
    slot = lambda c: F.floor((F.least(F.greatest(c, F.lit(low)), F.lit(high)) - F.lit(low)) / F.lit(width))
    from pyspark.sql import Window

    spans = clean.withColumn("lo", F.lag("hi").over(Window.partitionBy("of_shard").orderBy("hi")))
    spans = spans.withColumn("slot", F.explode(F.sequence(F.coalesce(slot(F.col("lo")), F.lit(0)), slot(F.col("hi")))))
    if n + shards * (n // max(1, shards) + 2) <= broadcast_rows:
        spans = F.broadcast(spans)
    keyed = rows.withColumn("at_us", us(at)).where(F.col("at_us") <= high).withColumn("shard_key", shard).withColumn("at_slot", slot(F.col("at_us")))
    hit = keyed.join(spans, (F.col("shard_key") == F.col("of_shard")) & (F.col("at_slot") == F.col("slot"))
        & (F.col("at_us") <= F.col("hi")) & (F.col("lo").isNull() | (F.col("at_us") > F.col("lo"))))
    return hit.drop("at_us", "at_slot", "shard_key", "of_shard", "slot", "lo", "hi")
