"""What the queries share: moments, log and state of the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.keys import effective_key
from keystrata.operators.reads import look_up, with_sizes
from keystrata.operators.state import KEEP, as_time, changes, live
from keystrata.session import table

AS_OF = "2025-04-01 00:00:00"
SNAPSHOT_AT = "2025-03-25 00:00:00"
GET_OPS, PUT_OPS, DELETE_OPS, REPLICATE_OPS = (49,), (50, 65), (51, 66), (65, 66)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of kv_log that carry a change."""
    return changes(table(spark, sf, "kv_log"))


def state(spark: SparkSession, sf: str, as_of: str | None = AS_OF, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """The live state with the columns `keep` of the log; ttl_secs and ts are always read, as they say when a row expires."""
    rows = log(spark, sf)
    rows = with_sizes(rows) if "value_bytes" in keep else rows
    return live(rows, as_time(as_of) if as_of else None, keep=tuple(dict.fromkeys((*keep, "ttl_secs", "ts"))))


def found(spark: SparkSession, sf: str, asked: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`asked` (db, key) with the live state's generation (null for a miss), `keep` and expires_at; only the asked keys are folded."""
    return look_up(asked, log(spark, sf), as_time(AS_OF), keep)


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """(msg_id, from_node, db, key): forwarded GETs; peer messages name no database, they mean database 0."""
    m = table(spark, sf, "peer_messages").where(F.col("op").isin(*GET_OPS))
    return m.select("msg_id", "from_node", F.lit(0).alias("db"), effective_key(F.col("key"), F.col("key_len")).alias("key")).where("key IS NOT NULL")


CHANGES = """SELECT * FROM (SELECT *, CASE WHEN op IS NOT NULL THEN upper(trim(op)) WHEN entry_type = 1 THEN 'PUT' WHEN entry_type = 2 THEN 'DELETE' END AS kind
  FROM kv_log WHERE key IS NOT NULL AND generation IS NOT NULL) WHERE kind IN ('PUT', 'DELETE')"""
LWW = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY generation DESC, entry_id) AS rn FROM ({CHANGES})) WHERE rn = 1"
STATE = f"SELECT *, CASE WHEN ttl_secs > 0 THEN ts + to_seconds(ttl_secs) END AS expires_at FROM ({LWW}) WHERE kind = 'PUT'"
LIVE = f"SELECT * FROM ({STATE}) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}'"
LOOKUPS = """SELECT * FROM (SELECT msg_id, from_node, 0 AS db, CASE WHEN key_len IS NULL THEN key ELSE unhex(substr(hex(key), 1, 2 * greatest(key_len, 0)::BIGINT)) END AS key
  FROM peer_messages WHERE op = 49) WHERE octet_length(key) > 0"""
#: A key as text, one character a byte, for keys of which all bytes are ASCII.
ASCII_KEY = "regexp_full_match(hex(key), '([0-7][0-9A-F])*')"


def crc16_sql(text: str) -> str:
    """CRC16 of an ASCII text expression, by the table."""
    from keystrata.functions.slots import CRC16

    t = "[" + ",".join(map(str, CRC16)) + "]"
    return f"list_reduce(list_prepend(0, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1)))), lambda c, b: xor((c & 255) << 8, {t}[(xor(c >> 8, b)) + 1]))"
