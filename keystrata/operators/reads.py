"""Point and batch reads over a state (db, key, value, ttl_secs, ts, generation, expires_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.glob import glob_match, key_match
from keystrata.operators import bloom
from keystrata.operators.state import KEEP, live

SMALL_KEYS = 200_000


def small(df: DataFrame, most: int) -> bool:
    """Whether `df` has at most `most` rows; no more than that are counted."""
    return df.limit(most + 1).count() <= most


def probe(asked: DataFrame, state: DataFrame) -> DataFrame:
    """`asked` (db, key and any other columns but the state's) with the state's columns, null for misses; keeps every asked row.

    One equi-join for any number of keys; the asked keys are broadcast when they are at most SMALL_KEYS. Where `state` is yet to be folded
    from a log, `look_up` costs less.
    """
    cols = [c for c in state.columns if c not in ("db", "key")]
    keys = asked.select("db", "key").distinct()
    hit = state.join(F.broadcast(keys), ["db", "key"], "left_semi") if small(keys, SMALL_KEYS) else state
    return asked.join(hit.select("db", "key", *cols), ["db", "key"], "left")


def asked_rows(log: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `log` whose db and key are asked for. A fold is by key, so this may go before it, and only these rows are shuffled.

    Up to SMALL_KEYS keys are broadcast. Beyond that a Bloom filter of the keys (4 MB) is, and the rows that pass are joined by shuffle.
    """
    keys = asked.select("db", "key").distinct()
    if small(keys, SMALL_KEYS):
        return log.join(F.broadcast(keys), ["db", "key"], "left_semi")
    f = bloom.build(keys, ["db", "key"])
    return bloom.passing(log, ["db", "key"], f).join(keys, ["db", "key"], "left_semi")


def look_up(asked: DataFrame, log: DataFrame, as_of: Column | None, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """`probe` of the live state of `log` (with `kind`), folded from the rows of the asked keys alone: `asked` with generation, `keep` and expires_at."""
    held = live(asked_rows(log, asked), as_of, keep=tuple(dict.fromkeys((*keep, "ttl_secs", "ts"))))
    return asked.join(held.select("db", "key", "generation", *keep, *[c for c in ("expires_at",) if c not in keep]), ["db", "key"], "left")


def get(asked: DataFrame, state: DataFrame) -> DataFrame:
    """GET / MGET: asked rows with `value`, null for misses. Order and repeats are the caller's columns (a position)."""
    return probe(asked, state.select("db", "key", "value"))


def exists(asked: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """EXISTS: `n`, the asked keys that live, repeats counted, for each group `by` of asked rows; groups without a hit have 0."""
    hits = probe(asked, state.select("db", "key", F.lit(1).alias("hit")))
    return hits.groupBy(*by).agg(F.count("hit").alias("n"))


def types(rows: DataFrame, lives: Column) -> DataFrame:
    """TYPE and OBJECT ENCODING of rows, by whether their key lives: `type` is string or none, `encoding` raw or null."""
    return rows.select("*", F.when(lives, "string").otherwise("none").alias("type"), F.when(lives, "raw").alias("encoding"))


def type_of(asked: DataFrame, state: DataFrame) -> DataFrame:
    """`types` of asked keys."""
    hits = probe(asked, state.select("db", "key", F.lit(1).alias("hit")))
    return types(hits, F.coalesce(F.col("hit") == 1, F.lit(False))).drop("hit")


def text_key(key: Column) -> Column:
    """A binary key as text of the same length, one character a byte; for globs and ordering by bytes."""
    return F.decode(key, "ISO-8859-1")


def keys(state: DataFrame, pattern: str) -> DataFrame:
    """KEYS: (db, key) of live keys that match; unordered. What the pattern begins with is a range of keys, which a scan can use."""
    return state.where(key_match(F.col("key"), pattern)).select("db", "key")


def scan(state: DataFrame, db: int, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    """SCAN: one page of (key, next_cursor) in the order of the keys' bytes; next_cursor is 0 on the last page.

    The page is the feature: `count` keys after the first `cursor` matching ones. A cursor past the end gives no rows. A page far
    from the start costs all pages before it; `scan_after` does not.
    """
    s = state.where(F.col("db") == db)
    if pattern is not None:
        s = s.where(key_match(F.col("key"), pattern))
    page = s.select("key").orderBy("key").offset(cursor).limit(count + 1)
    from pyspark.sql import Window

    w = Window.orderBy("key")
    n = F.count("*").over(Window.partitionBy())
    return page.select("key", F.row_number().over(w).alias("at"), F.when(n > count, cursor + count).otherwise(0).cast("long").alias("next_cursor")).where(F.col("at") <= count).drop("at")


def scan_after(state: DataFrame, db: int, after: bytes | None = None, count: int = 10, pattern: str | None = None) -> DataFrame:
    """SCAN by key: one page of (key, next_after), the `count` matching keys that follow `after` in the order of their bytes (the first ones for None).

    next_after, the page's last key, is where the next page begins; null on the last page. The cursor is a filter on the key that reaches the scan, so any page
    costs the same: each task keeps count + 1 keys.
    """
    s = state.where(F.col("db") == db)
    if after is not None:
        s = s.where(F.col("key") > F.lit(after))
    if pattern is not None:
        s = s.where(key_match(F.col("key"), pattern))
    page = s.select("key").orderBy("key").limit(count + 1).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    page = page.select(F.slice("keys", 1, count).alias("page"), (F.size("keys") > count).alias("more"))
    return page.select(F.explode("page").alias("key"), F.when(F.col("more"), F.element_at("page", -1)).alias("next_after"))


def random_key(state: DataFrame, seed: int | None = None) -> DataFrame:
    """RANDOMKEY: one (db, key) of each db, drawn by a seeded hash; no row for an empty db."""
    return state.groupBy("db").agg(F.min_by("key", F.xxhash64("key", F.lit(seed or 0))).alias("key"))


def with_sizes(log: DataFrame) -> DataFrame:
    """`log` with value_bytes, for folds that need the length of values only."""
    return log.withColumn("value_bytes", F.coalesce(F.octet_length("value"), F.lit(0)))


def entry_size(state: DataFrame) -> Column:
    """Bytes of key and value."""
    return F.octet_length("key") + (F.col("value_bytes") if "value_bytes" in state.columns else F.coalesce(F.octet_length("value"), F.lit(0)))


def dbsize(state: DataFrame) -> DataFrame:
    """DBSIZE and data bytes: (db, keys, data_bytes). A state that was folded with `value_bytes` (see `with_sizes`) needs no values."""
    size = entry_size(state)
    return state.groupBy("db").agg(F.count("*").alias("keys"), F.sum(size).cast("long").alias("data_bytes"))


def ttl(expires: Column, found: Column, as_of: Column, unit_us: int) -> Column:
    """TTL (unit 1,000,000) and PTTL (1,000): -2 missing, -1 no expiry, else whole units left, rounded down."""
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    return F.when(~found, F.lit(-2)).when(expires.isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(F.floor(left / unit_us)).cast("long")


def pexpire(ms: Column) -> Column:
    """The lifetime in whole seconds that PEXPIRE gives a key that lives; null where nothing is left and the key is deleted."""
    secs = F.floor(ms / 1000).cast("long")
    return F.when(secs > 0, secs)


def strlen(value: Column) -> Column:
    """STRLEN: bytes, 0 for a missing key."""
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int | Column, end: int | Column) -> Column:
    """GETRANGE: bytes from start to end, both included, negative ones counted from the end, clamped; empty if start > end or missing."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    v = F.coalesce(value.cast("binary"), F.lit(b""))
    n = F.octet_length(v)
    s = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    e = F.least(F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(end), n - 1)
    return F.when((n == 0) | (s > e), F.lit(b"")).otherwise(F.substring(v, s + 1, e - s + 1))


def setrange(value: Column, offset: int, patch: bytes) -> Column:
    """SETRANGE: value with `patch` from byte `offset` on, zero-padded up to it, also for an empty patch."""
    v = F.coalesce(value.cast("binary"), F.lit(b""))
    n = F.octet_length(v)
    head = F.substring(v, F.lit(1), F.lit(offset))
    pad = F.when(n < offset, F.unhex(F.repeat(F.lit("00"), F.lit(offset) - n))).otherwise(F.lit(b""))
    tail = F.when(n > offset + len(patch), F.substring(v, F.lit(offset + len(patch) + 1), n - offset - len(patch))).otherwise(F.lit(b""))
    return F.concat(head, pad, F.lit(patch), tail)
