"""Bloom filters as tables of bitmaps, built and asked in the JVM: a prefilter for lookups and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark's bitmap functions count them.
CHUNK = 32_768
BITS = 1 << 25
HASHES = 4


def _places(key: Sequence[Column], bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, key: Sequence[str], bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(chunk, bits): a filter of `bits` bits over the rows of `keys`, at most bits / 32,768 rows of 4 KB, whatever the number of keys.

    Each task sets its bits before the shuffle. Null parts of a key are values like others. With n keys a wrong "there" has
    about the rate (1 - exp(-hashes * n / bits)) ** hashes; a filter that is too full is slow, never wrong.
    """
    each = keys.select(F.explode(F.array(*_places([F.col(c) for c in key], bits, hashes))).alias("p"))
    return each.groupBy(F.floor(F.col("p") / CHUNK).cast("int").alias("chunk")).agg(F.expr(f"bitmap_construct_agg(p % {CHUNK})").alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the keys of both; they must have the same number of bits and hashes."""
    return a.unionByName(b).groupBy("chunk").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def fill_ratio(filter_: DataFrame, bits: int = BITS) -> DataFrame:
    """(set_bits, fill): bits that are set, and their share; 0 of an empty filter."""
    return filter_.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("set_bits")).withColumn("fill", F.col("set_bits") / bits)


def passing(rows: DataFrame, key: Sequence[str], filter_: DataFrame, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others. The filter goes to every task as one value, as it is of fixed size (4 MB by default)."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(-(-bits // CHUNK) - 1)), lambda i: F.element_at("m", i))
    whole = filter_.agg(F.map_from_entries(F.collect_list(F.struct("chunk", "bits"))).alias("m")).select(chunks.alias("chunks")).scalar()
    test = F.lit(True)
    for p in _places([F.col(c) for c in key], bits, hashes):
        at = (p % CHUNK).cast("int")
        byte = F.ascii(F.decode(F.substring(F.get(whole, F.floor(p / CHUNK).cast("int")), F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
        test = test & (F.call_function("getbit", F.coalesce(byte, F.lit(0)).cast("long"), at % 8) == 1)
    return rows.where(test)


#: Keys that are broadcast themselves rather than as a filter.
FEW = 200_000
#: Rows of a table from which on it pays to look for the touched ones before a join.
LARGE = 5_000_000


def large(held: DataFrame) -> bool:
    """Whether a stored table has more than LARGE rows; they are counted from the files' footers."""
    return held.count() > LARGE


def touched(held: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of `held` whose key is among `keys`, and perhaps a few others: what a join with `keys` needs of a large table.

    `held` is scanned but not shuffled, whatever its size: up to FEW keys are broadcast, more go as a filter of fixed size. `keys` should be cheap to read, as it is
    read twice.
    """
    one = keys.select(*key)
    if one.limit(FEW + 1).count() <= FEW:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        return held.join(F.broadcast(one.toDF(*[f"_{c}" for c in key])), same, "left_semi")
    return passing(held, key, build(one, key))
