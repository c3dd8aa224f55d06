"""Numbers kept as text, and sizes for people."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_int(text: Column) -> Column:
    """BIGINT of an optionally signed row of digits; null for anything else, blanks and overflow included."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def parse_float(text: Column) -> Column:
    """DOUBLE of a finite decimal number with an optional exponent; null for anything else."""
    ok = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    v = text.try_cast("double")
    return F.when(ok & (F.abs(v) < float("inf")), v)


def plain_float(x: float) -> str:
    """Shortest text that reads back as x, without exponent and without a trailing `.0`."""
    if x != x or x in (float("inf"), float("-inf")):
        return {True: "NaN"}.get(x != x, "inf" if x > 0 else "-inf")
    s = format(Decimal(repr(float(x))), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


@F.pandas_udf(T.StringType())
def float_text(x: pd.Series) -> pd.Series:
    """`plain_float` of a column; null of null."""
    return x.map(lambda v: None if v is None or pd.isna(v) else plain_float(v))


def human_size(n: int) -> str:
    """`human_bytes` of one number."""
    if n < 1024:
        return f"{n}B"
    power = min(5, max(p for p in range(1, 6) if n >= 1024**p))
    return f"{n / 1024**power:.2f}{'KMGTP'[power - 1]}"


def human_bytes(n: Column) -> Column:
    """`512B`, `1.50K`, `2.00M` and so on to P: units of 1024, two decimals."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for power, unit in enumerate("KMGTP", 1):
        size = F.format_string(f"%.2f{unit}", n / float(1024**power))
        out = out.when(n.isNotNull() if unit == "P" else n < 1024 ** (power + 1), size)
    return out
