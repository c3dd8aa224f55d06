"""Keys as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_key(key: Column, key_len: Column) -> Column:
    """The first `key_len` bytes of `key`, all of it where `key_len` is null; null for a null or empty result.

    A negative `key_len` counts as 0, one beyond the end as the whole key.
    """
    cut = F.when(key_len.isNull(), key).otherwise(F.substring(key, F.lit(1), F.greatest(key_len, F.lit(0))))
    return F.when(F.octet_length(cut) > 0, cut)


def key_hex(key: Column) -> Column:
    """Lower-case hex of a binary key."""
    return F.lower(F.hex(key))
