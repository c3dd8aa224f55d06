"""Filling containers of fixed capacity with items by the sum-of-squares rule.

Each item goes where the sum, over all gaps, of the squared number of open containers with that gap becomes smallest: into an
open container with room, or into a new one if that is better (`open_new="rule"`; in a tie an open one is taken). With
`open_new="last"` a new container is opened only if no open one has room. Items come from the longest to the shortest, or in the order of
their ids. A gap is counted in units of `unit` bytes, rounded down, so a placement never overfills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.session import ship

BROADCAST_GROUPS = 200_000


class SumOfSquares:
    """Open containers by gap. `place` answers with the container's number; new ones are counted up from 0."""

    NONE = 1 << 30

    def __init__(self, units: int, rule: bool = True):
        self.units, self.rule = units, rule
        self.count = np.zeros(units + 1, dtype=np.int32)
        self.empty = np.full(units + 1, self.NONE, dtype=np.int32)  # NONE for a gap that no open container has, else 0
        self.open: dict[int, list] = {}
        self.opened = 0
        self.widest = 0  # no open container has a larger gap

    def add(self, gap: int, bin_id) -> None:
        if gap > 0:
            self.count[gap] += 1
            self.empty[gap] = 0
            self.open.setdefault(gap, []).append(bin_id)
            self.widest = max(self.widest, gap)

    def new(self, n: int = 1) -> int:
        self.opened += n
        return self.opened - n

    def place(self, size: int):
        """The container for an item of 0 < `size` <= units."""
        return self.place_alike(size, 1)[0]

    def place_alike(self, size: int, n: int) -> list:
        """The containers for `n` items of one size, one after another.

        `change[i]` is half of what the sum grows by if a gap of i + size becomes one of i, less 1, which all have in common; a gap
        closed for good adds one less, so it is first in a tie. Placing an item changes two counts and so at most three of these
        numbers.
        """
        count, empty, none, rest = self.count, self.empty, self.NONE, self.units - size
        if self.widest and not count[self.widest]:
            held = np.flatnonzero(count[: self.widest])
            self.widest = int(held[-1]) if len(held) else 0
        m = max(self.widest, rest) - size + 1  # gaps from `size` to the widest that is or can come
        change = count[:m] - count[size : size + m] + empty[size : size + m] if m > 0 else np.full(1, none)
        out = []
        for _ in range(n):
            i = int(change.argmin())
            least = int(change[i])
            if least >= none // 2 or (self.rule and 2 * least + 2 - (i == 0) > (2 * int(count[rest]) + 1 if rest else 0)):
                bin_id, to, touched = self.new(), rest, (rest, rest - size)
            else:
                gap = i + size
                bin_id, to, touched = self.open[gap].pop(), i, (i, gap, i - size)
                count[gap] -= 1
                if not count[gap]:
                    empty[gap] = none
            self.add(to, bin_id)
            for j in touched:
                if 0 <= j < m:
                    change[j] = count[j] - count[j + size] + empty[j + size]
            out.append(bin_id)
        return out


def _packer(capacity: int, unit: int, rule: bool):
    names = ["grp", "id", "part", "bytes", "blocks", "bin", "is_new"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ss, held = None, None, []  # `held`: names of the containers that were there before, by -1 - number
        for b in batches:
            if not b.num_rows:
                continue
            shard, kind, size, full = b["shard"].to_numpy(), b["kind"].to_numpy(), b["size"].to_numpy(), b["full"].to_numpy(zero_copy_only=False)
            code = pc.dictionary_encode(b["grp"], null_encoding="encode").indices.to_numpy()
            need = -(-size // unit)
            edge = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]) | (full[1:] != full[:-1]) | (need[1:] != need[:-1])
            edges = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
            to, blocks = np.zeros(b.num_rows, dtype=np.int64), np.ones(b.num_rows, dtype=np.int64)
            old: dict[int, str] = {}
            for lo, hi in zip(edges, edges[1:]):
                here = (b["grp"][lo].as_py(), int(shard[lo]))
                if here != at or ss is None:
                    at, ss, held = here, SumOfSquares(capacity // unit, rule), []
                n = int(need[lo])
                if kind[lo] == 0:
                    for i, name in zip(range(lo, hi), b["bin"].slice(lo, hi - lo).to_pylist()):
                        held.append(name)
                        ss.add((capacity - int(size[i])) // unit, -len(held))
                elif full[lo]:
                    for i in range(lo, hi):
                        blocks[i] = size[i] // capacity
                        to[i] = ss.new(int(blocks[i]))
                elif n > ss.units:  # alone in its container, as the last unit isn't whole
                    to[lo:hi] = ss.new(hi - lo) + np.arange(hi - lo)
                elif n:
                    got = ss.place_alike(n, hi - lo)
                    to[lo:hi] = got
                    old.update((lo + i, held[-1 - g]) for i, g in enumerate(got) if g < 0)
            item = kind == 1
            fresh = item & (to >= 0) & (size > 0)
            name = pc.binary_join_element_wise(pa.scalar("new"), pa.array(shard).cast(pa.string()), pa.array(to).cast(pa.string()), "/")
            name = pc.if_else(pa.array(fresh), name, pa.scalar(None, pa.string()))
            if old:
                places = np.zeros(b.num_rows, dtype=bool)
                places[[*old]] = True
                name = pc.replace_with_mask(name, pa.array(places), pa.array([old[i] for i in sorted(old)], pa.string()))
            t = pa.RecordBatch.from_arrays([b["grp"], b["id"], b["part"], b["size"], pa.array(blocks), name, pa.array(fresh)], names=names)
            yield t.filter(pa.array(item))

    return run


def pack(
    items: DataFrame, id_col: str, group: Column, length: Column, capacity: int, *, unit: int = 1, open_bins: DataFrame | None = None, shard_items: int = 50_000,
    open_new: str = "rule", falling: bool = True,
) -> DataFrame:
    """(grp, id, part, bytes, blocks, bin, is_new): where every item of a length that is not null or negative goes.

    `part` is `whole`; an item longer than `capacity` has a row `full` for the containers it fills alone (`blocks` of them,
    counted up from `bin`) and a row `rest` for what remains, if anything does. An item of length 0 has no container. `open_bins`
    (grp, bin STRING, used) are open from the start; rows with null, negative or too large `used` are left out, of repeated
    ones the largest `used` counts. Every row is placed, repeated ids too. A null group is a group. `open_new` and `falling`
    choose the form of the rule (see above). The gaps are told apart by capacity // unit counters, which each new size runs
    through, so `unit` should leave some ten thousand of them at most.

    A group is packed in shards of about `shard_items` items, drawn by the hash of the id, so no group is one task; a shard
    leaves about one container less full. Memory is a shard's open containers, rows are read in order.
    """
    if open_new not in ("rule", "last"):
        raise ValueError(f"open_new is rule or last, not {open_new}")
    spark = items.sparkSession
    ship(spark)
    rows = items.select(group.alias("grp"), F.col(id_col).alias("id"), length.cast("long").alias("size")).where("size >= 0")
    shards = rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(shard_items)).alias("shards"))
    small = shards.count() <= BROADCAST_GROUPS
    side = F.broadcast(shards) if small else shards
    side = side.withColumnRenamed("grp", "of_grp")

    def sharded(df: DataFrame, by: Column, how: str) -> DataFrame:
        joined = df.join(side, F.col("grp").eqNullSafe(F.col("of_grp")), how)
        return joined.withColumn("shard", F.pmod(F.xxhash64(by), F.col("shards")).cast("int")).drop("of_grp", "shards")

    over = F.col("size") > capacity
    whole = F.struct(F.lit("whole").alias("part"), F.col("size").alias("size"))
    full = F.struct(F.lit("full").alias("part"), (F.col("size") - F.col("size") % capacity).alias("size"))
    rest = F.struct(F.lit("rest").alias("part"), (F.col("size") % capacity).alias("size"))
    pieces = F.when(over & (F.col("size") % capacity > 0), F.array(full, rest)).when(over, F.array(full)).otherwise(F.array(whole))
    placed = sharded(rows, F.col("id"), "inner").select("grp", "shard", "id", F.explode(pieces).alias("p")).select(
        "grp", "shard", F.lit(1).alias("kind"), "p.size", "id", "p.part", F.lit(None).cast("string").alias("bin"))
    if open_bins is not None:
        free = open_bins.where((F.col("used") >= 0) & (F.col("used") < capacity))
        free = free.groupBy("grp", "bin").agg(F.max("used").cast("long").alias("size"))
        free = sharded(free, F.col("bin"), "inner").select(
            "grp", "shard", F.lit(0).alias("kind"), "size", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("part"), "bin")
        placed = placed.unionByName(free)
    placed = placed.withColumn("full", F.coalesce(F.col("part") == "full", F.lit(False)))
    by = [F.col("size").desc(), "id", "bin"] if falling else ["id", F.col("size").desc(), "bin"]
    ordered = placed.repartition("grp", "shard").sortWithinPartitions("grp", "shard", "kind", F.col("full").desc(), *by)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"grp {types['grp']}, id {types['id']}, part string, bytes long, blocks long, bin string, is_new boolean"
    return ordered.mapInArrow(_packer(capacity, unit, open_new == "rule"), schema)


def packing_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(grp, items, new_bins, filled_bins, bytes, fill, bound): how full a group's new containers are; `fill` is null without any.

    No packing of what lies in the new containers needs fewer than `bound`: their bytes over the capacity, rounded up, or one for each item
    longer than half of it.
    """
    new = F.col("is_new")
    bins = packed.groupBy("grp", "bin", "is_new").agg(
        F.sum("bytes").alias("bytes"), F.max("blocks").alias("blocks"), F.sum(F.when(F.col("part") != "rest", 1).otherwise(0)).alias("items"),
        F.count_if((F.col("part") != "full") & (F.col("bytes") * 2 > capacity)).alias("halves"), F.max(F.col("part") == "full").alias("full"))
    own = lambda c: F.coalesce(F.sum(F.when(new & ~F.col("full"), F.col(c))), F.lit(0))
    out = bins.groupBy("grp").agg(
        F.sum("items").alias("items"), F.sum(F.when(new, F.col("blocks")).otherwise(0)).alias("new_bins"),
        F.count_if(~new & F.col("bin").isNotNull()).alias("filled_bins"), F.sum("bytes").alias("bytes"), F.sum(F.when(new, F.col("bytes"))).alias("new_bytes"),
        (F.sum(F.when(new & F.col("full"), F.col("blocks")).otherwise(0)) + F.greatest(F.ceil(own("bytes") / capacity), own("halves"))).cast("long").alias("bound"))
    return out.select("grp", "items", "new_bins", "filled_bins", "bytes", F.try_divide(F.col("new_bytes"), F.col("new_bins") * capacity).alias("fill"), "bound")


def packing_faults(packed: DataFrame, capacity: int, open_bins: DataFrame | None = None) -> DataFrame:
    """(grp, overfull, shared, divided): what a packing must not have, all 0 in one of `pack`: containers that hold more than the
    capacity (`open_bins` as given to `pack`), numbers of new containers that are given
    out twice, and items put into several containers though no
    longer than one (ids that are repeated in the input count as well).
    """
    held = packed.where("bin IS NOT NULL")
    full = held.where("part = 'full'").select("grp", "bin", "blocks")
    load = held.where("part <> 'full'").groupBy("grp", "bin").agg(F.sum("bytes").alias("load"))
    if open_bins is not None:
        used = open_bins.where((F.col("used") >= 0) & (F.col("used") < capacity)).groupBy(F.col("grp").alias("ogrp"), F.col("bin").alias("obin")).agg(F.max("used").alias("used"))
        load = load.join(used, F.col("grp").eqNullSafe(F.col("ogrp")) & (F.col("bin") == F.col("obin")), "left").withColumn("load", F.col("load") + F.coalesce("used", F.lit(0)))
    over = load.where(F.col("load") > capacity).groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit("overfull").alias("what"), "n")
    ends = full.unionByName(load.select("grp", "bin", F.lit(1).cast("long").alias("blocks"))).select(
        "grp", F.regexp_extract("bin", "^(new/[0-9]+/)", 1).alias("shard"), F.regexp_extract("bin", "([0-9]+)$", 1).cast("long").alias("first"), "blocks").where("shard <> ''")
    before = F.max(F.col("first") + F.col("blocks")).over(Window.partitionBy("grp", "shard").orderBy("first", F.desc("blocks")).rowsBetween(Window.unboundedPreceding, -1))
    both = ends.withColumn("before", before).where("first < before")
    shared = both.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit("shared").alias("what"), "n")
    split = packed.where("part = 'whole'").groupBy("grp", "id").agg(F.count("*").alias("n")).where("n > 1")
    split = split.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit("divided").alias("what"), "n")
    found = over.unionByName(shared).unionByName(split)
    none = packed.select("grp").distinct().select("grp", F.lit("").alias("what"), F.lit(0).cast("long").alias("n"))
    one = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).cast("long").alias(w)
    return found.unionByName(none).groupBy("grp").agg(*[one(w) for w in ("overfull", "shared", "divided")])
