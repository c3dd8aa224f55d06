"""Read-modify-write commands as ordered folds per key.

An epoch of a key begins with each reset (SET, DEL). Within an epoch a running sum gives INCR and DECR, a running
concatenation APPEND. The window forms need valid numbers; `exact_fold` also reproduces errors and overflow, which leave the value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators import prefix
from keystrata.session import ship

I64 = (-(2**63), 2**63 - 1)


def epochs(ops: DataFrame, key: list[str], order: str, resets: Column) -> DataFrame:
    """`ops` with `epoch`: the resets of the key up to and with the row."""
    return prefix.running_sum(ops, key, order, F.when(resets, F.lit(1).cast("long")), "epoch")


def running_sum(ops: DataFrame, key: list[str], order: str, resets: Column, start: Column, delta: Column) -> DataFrame:
    """INCR family on valid numbers: `ops` with `epoch` and `result`, the value after the row; both by one slotting.

    `start` is the value a reset sets (0 for a delete), `delta` what any other row adds (0 for reads). A key starts from 0.
    """
    return prefix.running_since(ops, key, order, resets, F.when(resets, start).otherwise(delta), "result", "epoch")


def appended(ops: DataFrame, key: list[str], order: str, resets: Column, value: Column) -> DataFrame:
    """APPEND: key columns, epoch, `value` (the parts joined in order) and `length` in bytes, one row for each epoch.

    Null parts add nothing. An epoch's parts are gathered in one task, as the value they make is a single field anyway.
    """
    e = epochs(ops, key, order, resets)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
    out = e.groupBy(*key, "epoch").agg(F.array_join(parts, "").alias("value"))
    return out.withColumn("length", F.octet_length("value"))


def last_before(ops: DataFrame, key: list[str], order: str, of: Column, when: Column) -> DataFrame:
    """As-of lookup: `ops` with `before`, the value of `of` in the key's last earlier row where `when` holds; null if there is none."""
    return prefix.last_value(ops, key, order, of, when, "before")


def exact_fold(ops: DataFrame) -> DataFrame:
    """Rows (key, seq, cmd, arg) in, (key, seq, reply, error, value) out: SET, DEL, GET, INCRBY, INCRBYFLOAT and APPEND, exactly.

    An argument or value that is no number of the kind, or a result out of range, gives an error and leaves the value; the same
    holds for a null argument of a command that needs one. `seq` orders a key's rows; equal ones are taken in any order. A hot
    key is one task's stream, in the order of its rows, never held as a whole: the fold is sequential by definition.
    """
    from keystrata.functions.numbers import plain_float
    from keystrata.operators.interpreter import strict_float, strict_int

    ship(ops.sparkSession)

    def step(value: bytes | None, cmd: str, arg: bytes | None) -> tuple[bytes | None, bytes | None, str | None]:
        if cmd == "GET":
            return value, value, None
        if cmd == "DEL":
            return None, b"0" if value is None else b"1", None
        if arg is None:
            return value, None, "ERR wrong number of arguments"
        if cmd == "SET":
            return arg, b"OK", None
        if cmd == "APPEND":
            new = (value or b"") + arg
            return new, str(len(new)).encode(), None
        if cmd == "INCRBY":
            held, by = strict_int(value or b"0"), strict_int(arg)
            if held is None or by is None:
                return value, None, "ERR value is not an integer or out of range"
            if not I64[0] <= held + by <= I64[1]:
                return value, None, "ERR increment or decrement would overflow"
            new = str(held + by).encode()
            return new, new, None
        if cmd == "INCRBYFLOAT":
            held, by = strict_float(value or b"0"), strict_float(arg)
            if held is None or by is None:
                return value, None, "ERR value is not a valid float"
            if held + by in (float("inf"), float("-inf")):
                return value, None, "ERR increment would produce NaN or Infinity"
            new = plain_float(held + by).encode()
            return new, new, None
        return value, None, f"ERR Unknown command '{cmd}'"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, begun = None, None, False
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for key, seq, cmd, arg in zip(*(b[c].to_pylist() for c in ("key", "seq", "cmd", "arg"))):
                if not begun or key != at:
                    at, value, begun = key, None, True
                value, reply, error = step(value, (cmd or "").upper(), arg)
                for col, v in zip(out, (key, seq, reply, error, value)):
                    col.append(v)
            types = (pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["key", "seq", "reply", "error", "value"])

    rows = ops.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), "cmd", F.col("arg").cast("binary").alias("arg"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key binary, seq long, reply binary, error string, value binary")
