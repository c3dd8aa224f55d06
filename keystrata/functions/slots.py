"""Hash slots: CRC16 of the hash tag or key, modulo 16384."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 16_384


def crc_table(width: int, poly: int, reflected: bool = False) -> list[int]:
    """The 256 remainders of a bytewise CRC."""
    out = []
    for i in range(256):
        if reflected:
            c = i
            for _ in range(8):
                c = (c >> 1) ^ (poly if c & 1 else 0)
        else:
            c = i << (width - 8)
            for _ in range(8):
                c = ((c << 1) ^ (poly if c >> (width - 1) else 0)) & ((1 << width) - 1)
        out.append(c)
    return out


#: CCITT polynomial, as used by cluster key slots.
CRC16 = crc_table(16, 0x1021)
#: Castagnoli polynomial, reflected.
CRC32C = crc_table(32, 0x82F63B78, reflected=True)


def crc16(data: Column) -> Column:
    """CRC16 (CCITT, start 0) of a binary or string column, in the JVM; null of null, 0 of empty."""
    text = F.decode(data.cast("binary"), "ISO-8859-1")
    table = F.array(*[F.lit(x) for x in CRC16])
    step = lambda c, i: F.shiftleft(c.bitwiseAND(F.lit(255)), 8).bitwiseXOR(
        F.element_at(table, F.shiftright(c, 8).bitwiseXOR(F.ascii(F.substring(text, i, F.lit(1)))) + 1))
    length = F.octet_length(data.cast("binary"))
    return F.when(data.isNotNull(), F.aggregate(F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>")), F.lit(0), step))


def hash_tag(key: Column) -> Column:
    """The part of a key that is hashed: between the first `{` and the next `}` if that isn't empty, else all of it. Binary."""
    text = F.decode(key.cast("binary"), "ISO-8859-1")
    tag = F.regexp_extract(text, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", F.encode(tag, "ISO-8859-1")).otherwise(key.cast("binary"))


def key_slot(key: Column) -> Column:
    """Slot of a key, 0 to 16383."""
    return crc16(hash_tag(key)) % SLOTS


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC32C of binary values, all values of a batch advanced together; null of null."""
    table = np.array(CRC32C, dtype=np.uint32)
    raw = data.map(lambda b: b"" if b is None else bytes(b))
    n = raw.map(len).to_numpy()
    crc = np.full(len(raw), 0xFFFFFFFF, dtype=np.uint32)
    buf = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    for i in range(int(n.max()) if len(n) else 0):
        live = n > i
        crc[live] = (crc[live] >> np.uint32(8)) ^ table[(crc[live] ^ buf[start[live] + i]) & np.uint32(0xFF)]
    out = pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64), dtype="Int64")
    out[data.isna().to_numpy()] = pd.NA
    return out
