"""Most frequent items in bounded memory: a hierarchy of count-sketches over prefixes of the key's hash.

Each map task fills one sketch: exact counters for the hash's first 8 and 16 bits, and for each longer prefix (24, 32, ...
64 bits) a count-sketch with signed hashes. Sketches are sums, so they are added up cell by cell in a shuffle whose size
is tasks x sketch, whatever the rows; a task takes several splits where there are more of them than four for each core. Descending from heavy prefixes to their 256 children each recovers the 64-bit hashes
that can be heavy, and a second scan counts the keys that have them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.session import parts, ship

SLICE = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class SketchShape:
    """`depth` rows of 2**`width_bits` counters at each of six levels, and 256 + 65,536 exact counters."""

    depth: int = 5
    width_bits: int = 14

    EXACT = (8, 16)
    LEVELS = (24, 32, 40, 48, 56, 64)
    #: Rows of 2**20 counters are 250 MB for the driver and each task.
    MOST_BITS = 20

    @classmethod
    def for_share(cls, share: float, depth: int = 5) -> SketchShape:
        """Counters enough for keys of a share if no key has much more: a key's own 48 in each row."""
        if not 0 < share <= 1:
            raise ValueError(f"a share is above 0 and at most 1, not {share}")
        return cls(depth, min(cls.MOST_BITS, max(10, math.ceil(math.log2(48 / share) - 0.1))))

    @property
    def cells(self) -> int:
        return sum(1 << b for b in self.EXACT) + len(self.LEVELS) * self.depth * (1 << self.width_bits)

    def offset(self, level: int, row: int = 0) -> int:
        """First cell of a level (its number of bits) and row."""
        if level in self.EXACT:
            return 0 if level == 8 else 256
        return 256 + 65_536 + (self.LEVELS.index(level) * self.depth + row) * (1 << self.width_bits)

    def place(self, prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Counter and sign of each prefix."""
        m = _mix(prefix + np.uint64((level * 131 + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (m >> np.uint64(64 - self.width_bits)).astype(np.int64), (m & np.uint64(1)).astype(np.int64) * 2 - 1

    def add(self, cells: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        for level in self.EXACT:
            o = self.offset(level)
            cells[o : o + (1 << level)] += np.bincount((hashes >> np.uint64(64 - level)).astype(np.int64), weights=counts, minlength=1 << level).astype(np.int64)
        for level in self.LEVELS:
            prefix = hashes >> np.uint64(64 - level)
            for row in range(self.depth):
                at, sign = self.place(prefix, level, row)
                o = self.offset(level, row)
                cells[o : o + (1 << self.width_bits)] += np.bincount(at, weights=sign * counts, minlength=1 << self.width_bits).astype(np.int64)

    def estimate(self, cells: np.ndarray, prefix: np.ndarray, level: int) -> np.ndarray:
        """Counts of prefixes: the counter itself, or the median of the signed counters."""
        if level in self.EXACT:
            return cells[self.offset(level) + prefix.astype(np.int64)]
        each = []
        for row in range(self.depth):
            at, sign = self.place(prefix, level, row)
            each.append(cells[self.offset(level, row) + at] * sign)
        return np.median(np.stack(each), axis=0)

    def noise(self, cells: np.ndarray, heavy: np.ndarray) -> float:
        """Standard error of a row's estimate: the root of the second moment of all but the `heavy` counts, over the counters."""
        o, width = self.offset(64), 1 << self.width_bits
        rows = cells[o : o + self.depth * width].reshape(self.depth, width).astype(float)
        return float(np.sqrt(max(0.0, float(np.median((rows**2).sum(axis=1))) - float((heavy.astype(float) ** 2).sum())) / width))

    def total(self, cells: np.ndarray) -> int:
        return int(cells[:256].sum())

    def descend(self, cells: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Hashes whose estimate, and that of each of their prefixes, is at least `least`; and the estimates. None if more than `most`
        prefixes of a length seem to be: the counters are too few to tell.
        """
        at = np.arange(256, dtype=np.uint64)
        est = self.estimate(cells, at, 8)
        at, est = at[est >= least], est[est >= least]
        for level in (16, *self.LEVELS):
            at = ((at[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None, :]).ravel()
            est = self.estimate(cells, at, level)
            at, est = at[est >= least], est[est >= least]
            if len(at) > most:
                return None
        return at, est


def _build(shape: SketchShape, flush: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(shape.cells, dtype=np.int64)
        held: list[np.ndarray] = []
        n = 0

        def add() -> None:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            shape.add(cells, u, c)

        for b in batches:
            held.append(b["h"].to_numpy().astype(np.uint64))
            n += b.num_rows
            if n >= flush:
                add()
                held, n = [], 0
        if n:
            add()
        yield from _slices(range(0, shape.cells, SLICE), lambda o: cells[o : o + SLICE])

    return run


def _slices(starts, of) -> Iterator[pa.RecordBatch]:
    rows = [(o // SLICE, of(o)) for o in starts]
    rows = [(k, v) for k, v in rows if v.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["slice", "raw"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b["slice"].to_pylist(), b["raw"].to_pylist()):
            v = np.frombuffer(raw, dtype=np.int64)
            sums[k] = sums[k] + v if k in sums else v.copy()
    yield from _slices([k * SLICE for k in sums], lambda o: sums[o // SLICE])


def sketch(df: DataFrame, key: Column, shape: SketchShape = SketchShape()) -> np.ndarray:
    """The summed cells over all rows whose key is not null. The driver gets `shape.cells` counters, about 4.5 MB by default.

    At most four sketches for each core are filled, whatever the number of splits, and each slice of 4,096 counters is summed by itself.
    """
    spark = df.sparkSession
    ship(spark)
    hashed = df.select(key.alias("k")).where("k IS NOT NULL").select(F.xxhash64("k").alias("h"))
    sketches = hashed.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(_build(shape), "slice int, raw binary")
    reducers = min(-(-shape.cells // SLICE), parts(spark))
    merged = sketches.repartitionById(reducers, F.col("slice")).mapInArrow(_merge, "slice int, raw binary")
    cells = np.zeros(shape.cells, dtype=np.int64)
    for k, raw in merged.collect():
        v = np.frombuffer(raw, dtype=np.int64)
        cells[k * SLICE : k * SLICE + len(v)] = v
    return cells


def heavy_hitters(df: DataFrame, key: Column, share: float, *, slack: float = 0.5, shape: SketchShape | None = None) -> DataFrame:
    """(key, approx_count, n, total): every key that at least `share` of the rows with a key have, n being exact.

    Candidates are taken from `slack * share` upwards, so that the sketch's error costs no key; there
    are at most about 1 / (slack * share) of them, which bounds what is broadcast. `shape` follows from the share if it isn't given. The
    error is measured on the sketch: where four standard errors are more than `slack * share` leaves room for, a wider sketch is filled by another scan; if
    that would be wider than SketchShape.MOST_BITS, the share is too small for these keys, which is an error. Null keys are no rows; an empty table
    gives no rows; keys with equal counts all come out. Two keys with one 64-bit hash are told apart by the second scan.
    """
    spark = df.sparkSession
    shape = shape or SketchShape.for_share(share)
    while True:
        cells = sketch(df, key, shape)
        total = shape.total(cells)
        least = max(1.0, slack * share * total)
        got = shape.descend(cells, least, 4 * math.ceil(total / least) + 256)
        over = 4.0 if got is None else 4 * shape.noise(cells, got[1]) / least
        if over <= 1:
            hashes, est = got
            break
        bits = shape.width_bits + math.ceil(2 * math.log2(over))
        if bits > shape.MOST_BITS:
            raise ValueError(f"keys of a share of {share} can't be told from the others by 2**{shape.MOST_BITS} counters")
        shape = SketchShape(shape.depth, bits)
    found = spark.createDataFrame([(int(h), int(e)) for h, e in zip(hashes.astype(np.int64), est)], "h long, approx_count long")
    rows = df.select(key.alias("key")).where("key IS NOT NULL").withColumn("h", F.xxhash64("key"))
    counted = rows.join(F.broadcast(found), "h").groupBy("key", "approx_count").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= F.lit(share) * F.lit(total)).select("key", "approx_count", "n", F.lit(total).cast("long").alias("total"))
