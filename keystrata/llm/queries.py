"""The pN_ queries of this subpackage, with the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.keys import effective_key, key_hex
from keystrata.session import table

TOKENIZERS = os.environ.get("KEYSTRATA_TOKENIZERS", "/opt/tokenizers")
HEAVY_SHARE = 0.003


def _key():
    return effective_key(F.col("key"), F.col("key_len"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.seen import seen_before

    return seen_before(table(spark, sf, "peer_messages"), "msg_id", _key()).where("seen").select(F.col("id").alias("msg_id"))


def p1_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.seen import seen_errors

    return seen_errors(table(spark, sf, "peer_messages"), "msg_id", _key())


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_counts(spark, sf).select("key_hex")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.heavy import heavy_hitters

    return heavy_hitters(table(spark, sf, "peer_messages"), _key(), HEAVY_SHARE).select(key_hex(F.col("key")).alias("key_hex"), "n")


BLOCK_BYTES = 1_048_560
RECORD_UNIT = 128


def record_bytes():
    """Stored length of a record: 32 + key + value, rounded up to a multiple of 128; null where a part is null or negative."""
    ok = (F.col("key_len") >= 0) & (F.col("value_len") >= 0)
    return F.when(ok, F.ceil((F.lit(32) + F.col("key_len") + F.col("value_len")) / RECORD_UNIT) * RECORD_UNIT)


def _room(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wblock_meta").select(
        F.col("db").alias("grp"), F.concat_ws("/", "file_id", "wblock_id").alias("bin"), F.col("bytes_used").alias("used"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.packing import pack

    blocks = _room(spark, sf)
    return pack(table(spark, sf, "record_headers"), "record_id", F.col("db"), record_bytes(), BLOCK_BYTES, unit=RECORD_UNIT, open_bins=blocks)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).where("part = 'full'").select(F.col("id").alias("record_id"))


def p5_fill(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.packing import packing_fill

    return packing_fill(_packed(spark, sf), BLOCK_BYTES).withColumnRenamed("grp", "db")


def p5_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must keep: all records and bytes of each db are placed, nothing is overfull, shared or divided, and the new blocks are
    at most a fifth, and two for each shard of 50,000 records, more than the least number that any packing needs.
    """
    from keystrata.llm.packing import packing_faults, packing_fill
    from keystrata.session import materialize

    packed = materialize(_packed(spark, sf), "p5")
    fill = packing_fill(packed, BLOCK_BYTES).withColumn("loose", F.col("new_bins") > 1.2 * F.col("bound") + 2 * F.ceil(F.col("items") / 50_000))
    faults = packing_faults(packed, BLOCK_BYTES, _room(spark, sf)).withColumnRenamed("grp", "g")
    return fill.join(faults, F.col("grp").eqNullSafe(F.col("g"))).select(F.col("grp").alias("db"), "items", "bytes", "overfull", "shared", "divided", "loose")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.tokens import encode_corpus

    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.leaks import leaks

    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p7_removal_spans(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.leaks import removal_spans

    return removal_spans(_leaks(spark, sf)).withColumnRenamed("id", "doc_id")


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    from keystrata.llm.subjects import subject_counts

    return subject_counts(
        table(spark, sf, "documents"), "doc_id", "text", ["thread_id", "source"], table(spark, sf, "subject_labels"), "doc_id", "subject",
        table(spark, sf, "subject_areas"), "subject")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select(F.col("id").alias("doc_id"), "subject").distinct()


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


_MESSAGE_KEYS = """
  SELECT msg_id, k FROM (
    SELECT msg_id, CASE WHEN key_len IS NULL THEN key
      ELSE unhex(substr(hex(key), 1, 2 * greatest(key_len, 0)::BIGINT)) END AS k FROM peer_messages)
  WHERE octet_length(k) > 0"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_error_rate, p3_found, p3_counts, p5_found, p5_fill, p5_limits, p6_ids, p7_found, p7_removal_spans, p8_found, p8_composition)
}
SQL: dict[str, str] = {
    "p5_limits": """SELECT db, count(*) AS items, CAST(sum((32 + key_len + value_len + 127) // 128 * 128) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS overfull,
      CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS divided, FALSE AS loose FROM record_headers WHERE key_len >= 0 AND value_len >= 0 GROUP BY db""",
    "p5_found": "SELECT record_id FROM record_headers WHERE key_len >= 0 AND value_len >= 0 AND (32 + key_len + value_len + 127) // 128 * 128 > 1048560",
    "p1_found": f"WITH m AS ({_MESSAGE_KEYS}) SELECT msg_id FROM (SELECT msg_id, min(msg_id) OVER (PARTITION BY k) AS f FROM m) WHERE msg_id > f",
    "p3_found": f"WITH m AS ({_MESSAGE_KEYS}) SELECT lower(hex(k)) AS key_hex FROM m GROUP BY k HAVING count(*) >= 0.003 * (SELECT count(*) FROM m)",
    "p3_counts": f"WITH m AS ({_MESSAGE_KEYS}) SELECT lower(hex(k)) AS key_hex, count(*) AS n FROM m GROUP BY k HAVING count(*) >= 0.003 * (SELECT count(*) FROM m)",
}
