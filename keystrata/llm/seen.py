"""Has this key been seen before? Hash-partitioned blocked Bloom filters, queried and then filled in order.

The stream of (id, key) rows goes through three steps.

1. Each map task takes its rows in chunks and settles repeats inside a chunk by the bytes of the key. Only the first row
   of a key in a chunk goes on; a hot key thus leaves each chunk once, whatever its share of the rows.
2. First rows are hash-partitioned by key into buckets. A bucket reads its rows in the order of the ids and holds one
   Bloom filter of 512-bit blocks (one bit in each of eight words): query, then insert. "Not there" is certain, and the
   answer for that row.
3. "There" may be wrong, so those rows alone are compared, by the key's bytes, with the rows that were not there. Of these only the ones with
   the hash of a row in question take part.

Memory of a task is its bucket's filter and one Arrow batch, never the keys. Filters can be kept and handed to the next
call (`keep_to`, `state`), which then also knows the keys of the calls before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.session import materialize, parts, ship

WORDS = 8
#: Odd multipliers, one for each word of a block.
SALTS = np.array([0x9E3779B97F4A7C15 + 2 * 0x1F123BB5159A55E5 * i & (1 << 64) - 1 | 1 for i in range(1, WORDS + 1)], dtype=np.uint64)
FIRST, MAYBE, REPEAT, PROBE_ABSENT, PROBE_HIT = 0, 1, 2, 3, 4
#: Bounds of what step 3 broadcasts: distinct hashes, and bytes of keys.
HASHES, BYTES = 500_000, 16 << 20
OUT = "bucket int, id long, key binary, verdict byte, blob binary"


def false_positive_rate(bits_per_key: float) -> float:
    """Expected rate of wrong "seen" answers of a full filter; the load of a block is Poisson distributed."""
    load, total, p = 64 * WORDS / bits_per_key, 0.0, 0.0
    for i in range(int(load * 6 + 60)):
        p = math.exp(-load + i * math.log(load) - math.lgamma(i + 1))
        total += p * (1 - (1 - 1 / 64) ** i) ** WORDS
    return total


def bits_for(fp_rate: float) -> float:
    """Bits a key that keep the expected rate at or below `fp_rate`."""
    low, high = 1.0, 400.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if false_positive_rate(mid) <= fp_rate else (mid, high)
    return high


class BlockedBloom:
    """A filter of 512-bit blocks over 64-bit hashes."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.words = np.zeros(max(1, blocks) * WORDS, dtype=np.uint64) if words is None else words
        self.blocks = len(self.words) // WORDS

    @classmethod
    def sized(cls, keys: int, fp_rate: float) -> BlockedBloom:
        return cls(math.ceil(keys * bits_for(fp_rate) / (64 * WORDS)))

    def _where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = h.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        block = (((x >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)).astype(np.int64)
        bit = (((x & np.uint64(0xFFFFFFFF))[:, None] * SALTS[None, :]) >> np.uint64(58)) & np.uint64(63)
        return block[:, None] * WORDS + np.arange(WORDS), np.uint64(1) << bit

    def query(self, h: np.ndarray) -> np.ndarray:
        at, mask = self._where(h)
        return ((self.words[at] & mask) == mask).all(axis=1)

    def insert(self, h: np.ndarray) -> None:
        at, mask = self._where(h)
        np.bitwise_or.at(self.words, at.ravel(), mask.ravel())

    def query_then_insert(self, h: np.ndarray) -> np.ndarray:
        """Answers for distinct keys taken together: each is asked before any of them is added."""
        hit = self.query(h)
        self.insert(h[~hit])
        return hit

    def to_bytes(self) -> bytes:
        return self.words.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BlockedBloom:
        return cls(0, np.frombuffer(raw, dtype=np.uint64).copy())


def _firsts(keys: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Mask of the rows that have the smallest id of their key among these; several where that id is repeated."""
    codes = pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False)
    least = np.full(int(codes.max()) + 1 if len(codes) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, codes, ids)
    return ids == least[codes]


def _blank(keys: pa.Array, keep: np.ndarray) -> pa.Array:
    """The keys, null where they aren't kept."""
    return keys.take(pa.array(np.arange(len(keep)), mask=~keep))


def _local(buckets: int, chunk_rows: int):
    """Step 1. In: id, key, h. Out: the bucket, id and key of first rows; bucket -1 and no key for repeats."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, h = t["id"].to_numpy(), t["h"].to_numpy()
        keys = t["key"].combine_chunks() if isinstance(t["key"], pa.ChunkedArray) else t["key"]
        first = _firsts(keys, ids)
        bucket = np.where(first, (h.astype(np.uint64) % np.uint64(buckets)).astype(np.int64), -1)
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(ids), _blank(keys, first)], names=["bucket", "id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= chunk_rows:
                yield settle(held)
                held, n = [], 0
        if held:
            yield settle(held)

    return run


def _filter(keys_per_bucket: int, fp_rate: float, emit_state: bool, ask_rows: int):
    """Step 2, over rows sorted by (bucket, id): a bucket's kept filter comes first, its id being null; probes come last."""

    def state_row(bucket: int, bloom: BlockedBloom) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
            pa.array([None], pa.int8()), pa.array([bloom.to_bytes()], pa.binary())], names=["bucket", "id", "key", "verdict", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bloom = None, None
        for b in batches:
            buckets = b["bucket"].to_numpy()
            edges = sorted({0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), *range(0, len(buckets), ask_rows), len(buckets)})
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part, k = b.slice(lo, hi - lo), int(buckets[lo])
                if k != at:
                    if emit_state and bloom is not None:
                        yield state_row(at, bloom)
                    at, bloom = k, BlockedBloom.sized(keys_per_bucket, fp_rate)
                n_state = part["id"].null_count
                for raw in part["blob"].slice(0, n_state).to_pylist():  # the bucket's first row
                    bloom = BlockedBloom.from_bytes(raw)
                part = part.slice(n_state)
                if not part.num_rows:
                    continue
                h, probe = part["h"].to_numpy(), part["probe"].to_numpy(zero_copy_only=False)
                first = _firsts(part["key"], part["id"].to_numpy()) & ~probe
                verdict = np.full(part.num_rows, REPEAT, dtype=np.int8)
                verdict[first] = np.where(bloom.query_then_insert(h[first]), MAYBE, FIRST)
                if probe.any():
                    verdict[probe] = np.where(bloom.query(h[probe]), PROBE_HIT, PROBE_ABSENT)
                keep = verdict < REPEAT
                yield pa.RecordBatch.from_arrays([
                    part["bucket"], part["id"], _blank(part["key"], keep),
                    pa.array(verdict), pa.nulls(part.num_rows, pa.binary())], names=["bucket", "id", "key", "verdict", "blob"])
        if emit_state and bloom is not None:
            yield state_row(at, bloom)

    return run


def bloom_verdicts(
    df: DataFrame, id_col: str, key: Column, *, fp_rate: float = 0.001, expected_keys: int | None = None, filter_mb: int = 16,
    chunk_rows: int = 100_000, ask_rows: int = 4_096, probes: int = 0, state: DataFrame | None = None, keep_state: bool = False, buckets: int | None = None,
) -> DataFrame:
    """Steps 1 and 2: one row (bucket, id, key, verdict, blob) for each row with a key, and one for each kept filter.

    `expected_keys` bounds the distinct keys (default: the rows of `df`, from the file footers where it is a plain scan) and
    with `fp_rate` sizes the filters; `filter_mb` bounds a single one, so the number of buckets grows with the keys.
    `ask_rows` are asked of a filter together and then inserted; repeats among them are told by the key's bytes, as in a chunk.
    With `state` (bucket, buckets, blob; see `kept_filters`), the filters go on from there, with the buckets and sizes they were made
    with; `expected_keys` of the first call should thus count the keys of all. `probes` adds so many keys that
    cannot occur (33 bytes from a hash), asked after everything else. Rows whose key or id is null have none and give no row;
    an empty table gives none either. An empty key is a key like any other. Rows with equal ids are not earlier than one another.
    """
    spark = df.sparkSession
    ship(spark)
    if state is not None:
        buckets = _buckets_of(state, buckets)
    expected = expected_keys if expected_keys is not None else df.count()
    buckets = buckets or max(parts(spark), math.ceil(expected * bits_for(fp_rate) / 8 / (filter_mb << 20)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), key.cast("binary").alias("key")).where("key IS NOT NULL AND id IS NOT NULL")
    settled = rows.select("id", "key", F.xxhash64("key").alias("h")).mapInArrow(_local(buckets, chunk_rows), "bucket int, id long, key binary")
    settled = materialize(settled, "seen-firsts")
    firsts = settled.where("bucket >= 0")
    if probes:
        absent = spark.range(probes).select(
            (F.lit((1 << 62)) + F.col("id")).alias("id"),
            F.concat(F.lit(b"\xff"), F.unhex(F.sha2(F.concat(F.lit("absent key "), F.col("id").cast("string")), 256))).alias("key"))
        h = F.xxhash64("key")
        # the same residue as in step 1: the hash taken as unsigned
        unsigned = F.when(h >= 0, h % buckets).otherwise(((h % buckets) + (2**64 % buckets) + buckets) % buckets)
        firsts = firsts.withColumn("probe", F.lit(False)).unionByName(absent.select(unsigned.cast("int").alias("bucket"), "id", "key", F.lit(True).alias("probe")))
    if state is not None:
        firsts = firsts.unionByName(state.select("bucket", "blob"), allowMissingColumns=True)
    placed = firsts.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "id").withColumn("h", F.xxhash64("key"))
    placed = placed.withColumn("probe", F.coalesce("probe", F.lit(False)) if probes else F.lit(False)).withColumn("blob", F.col("blob") if state is not None else F.lit(None).cast("binary"))
    asked = placed.mapInArrow(_filter(math.ceil(1.1 * expected / buckets) + 64, fp_rate, keep_state, ask_rows), OUT)
    nothing = lambda t: F.lit(None).cast(t)
    return asked.unionByName(settled.where("bucket < 0").select(
        "bucket", "id", nothing("binary").alias("key"), F.lit(REPEAT).cast("byte").alias("verdict"), nothing("binary").alias("blob")))


def _buckets_of(state: DataFrame, buckets: int | None) -> int | None:
    """The number of buckets that kept filters were made with; it must be `buckets` if that is given."""
    if "buckets" not in state.columns:
        return buckets
    low, high = state.agg(F.min("buckets"), F.max("buckets")).first()
    if low != high or buckets not in (None, high):
        raise ValueError(f"the filters were made with {low} to {high} buckets, not {buckets}")
    return high


def kept_filters(verdicts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, buckets, blob) of `bloom_verdicts(..., keep_state=True)`: what the next call takes as `state`."""
    return verdicts.where("blob IS NOT NULL").select("bucket", F.lit(buckets).cast("int").alias("buckets"), "blob")


def _exact(verdicts: DataFrame) -> DataFrame:
    """Step 3. In: FIRST and MAYBE rows. Out: id, key, verdict, truly (the key has a row with a smaller id).

    FIRST rows are the filter's word. A MAYBE row whose key has a FIRST row comes after that; the few others are compared with one
    another, as the key's first row may be among them. Up to HASHES distinct keys in question, their hashes and the FIRST rows that share them
    are broadcast (at most BYTES of keys); beyond that the joins are by shuffle, of the rows that weren't settled in a chunk.
    """
    first = verdicts.where(F.col("verdict") == FIRST).select("id", "key", "verdict")
    maybe = verdicts.where(F.col("verdict") == MAYBE).select("id", "key", "verdict")
    known = first
    asked = maybe.select(F.xxhash64("key").alias("h")).distinct()
    n = asked.limit(HASHES + 1).count()
    if n <= HASHES:
        known = first.withColumn("h", F.xxhash64("key")).join(F.broadcast(asked), "h", "left_semi")
    known = known.groupBy("key").agg(F.min("id").alias("least"))
    if n <= HASHES and (known.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) <= BYTES:
        known = F.broadcast(known)
    found = maybe.join(known, "key", "left")
    rest = found.where("least IS NULL").select("id", "key", "verdict", (F.col("id") > F.min("id").over(Window.partitionBy("key"))).alias("truly"))
    return first.withColumn("truly", F.lit(False)).unionByName(
        found.where("least IS NOT NULL").select("id", "key", "verdict", (F.col("id") > F.col("least")).alias("truly"))).unionByName(rest)


def seen_before(df: DataFrame, id_col: str, key: Column, *, state: DataFrame | None = None, keep_to: str | None = None, known: DataFrame | None = None, buckets: int | None = None, **how) -> DataFrame:
    """(id, seen, sure) for each row that has a key: whether a row with a smaller id, or one of an earlier call, has the same key.

    Without `state` every answer is exact. `keep_to` is a folder to write the filters to; the next call reads them as `state` and then
    also knows the keys of the calls before: of a key that no earlier row of this call has, a "not there" is certain, and a "there" is wrong with the
    filters' rate, so `sure` is false. If the earlier keys were stored as well, give them as `known` (key) and these few rows are looked up there, and all is
    exact again. See `bloom_verdicts` for the other parameters, null keys and empty tables.
    """
    spark = df.sparkSession
    if buckets is None and state is None:
        expected = how["expected_keys"] = how["expected_keys"] if how.get("expected_keys") is not None else df.count()
        buckets = max(parts(spark), math.ceil(expected * bits_for(how.get("fp_rate", 0.001)) / 8 / (how.get("filter_mb", 16) << 20)))
    v = materialize(bloom_verdicts(df, id_col, key, state=state, keep_state=keep_to is not None, buckets=buckets, **how), "seen")
    if keep_to is not None:
        kept_filters(v, buckets or _buckets_of(state, None)).write.mode("overwrite").parquet(keep_to)
    checked = _exact(v)
    out = v.where(F.col("verdict") == REPEAT).select("id", F.lit(True).alias("seen"), F.lit(True).alias("sure"))
    if state is None:
        return out.unionByName(checked.select("id", F.col("truly").alias("seen"), F.lit(True).alias("sure")))
    open_ = (F.col("verdict") == MAYBE) & ~F.col("truly")
    settled = checked.where(~open_).select("id", F.col("truly").alias("seen"), F.lit(True).alias("sure"))
    earlier = checked.where(open_)
    if known is None:
        earlier = earlier.select("id", F.lit(True).alias("seen"), F.lit(False).alias("sure"))
    else:
        held = known.select(F.col(known.columns[0]).cast("binary").alias("key")).join(earlier.select("key"), "key", "left_semi").distinct().withColumn("held", F.lit(True))
        earlier = earlier.join(held, "key", "left").select("id", F.col("held").isNotNull().alias("seen"), F.lit(True).alias("sure"))
    return out.unionByName(settled).unionByName(earlier)


def seen_errors(df: DataFrame, id_col: str, key: Column, *, probes: int = 20_000, fp_rate: float = 0.001, **how) -> DataFrame:
    """The filters' share of wrong answers: (kind, asked, wrong, rate, target).

    `stream`: the first rows of the data's own keys; wrong where the filter called one seen. `absent`: keys known to be
    absent, asked of the full filters. An empty table gives asked 0 and rate null for `stream`.
    """
    v = materialize(bloom_verdicts(df, id_col, key, probes=probes, fp_rate=fp_rate, **how), "seen-errors")
    own = _exact(v).where(~F.col("truly")).agg(F.count("*").alias("asked"), F.count_if(F.col("verdict") == MAYBE).alias("wrong"))
    absent = v.where(F.col("verdict") >= PROBE_ABSENT).agg(F.count("*").alias("asked"), F.count_if(F.col("verdict") == PROBE_HIT).alias("wrong"))
    return own.withColumn("kind", F.lit("stream")).unionByName(absent.withColumn("kind", F.lit("absent"))).select(
        "kind", "asked", "wrong", F.try_divide("wrong", "asked").alias("rate"), F.lit(float(fp_rate)).alias("target"))
