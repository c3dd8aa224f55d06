"""Queries on the log and the state: recovery, reads, keys, lifetimes, sizes, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions.glob import key_match
from keystrata.functions.keys import key_hex
from keystrata.operators import bloom, maintenance, reads, stats
from keystrata.operators import state as st
from keystrata.plans.base import AS_OF, CHANGES, LIVE, LOOKUPS, LWW, SNAPSHOT_AT, STATE, found, log, lookups, query, state
from keystrata.session import table

_hex = lambda c: F.lower(F.hex(c))
_now = lambda: st.as_time(AS_OF)
SIZE_SQL = "24 + coalesce(octet_length(key), 0) + coalesce(octet_length(value), 0)"


def _entry_bytes():
    return F.lit(24) + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation, lower(hex(value)) AS value_hex, ttl_secs, expires_at FROM ({LIVE})")
def kv_lww_state(spark, sf):
    return state(spark, sf).select("db", key_hex(F.col("key")).alias("key_hex"), "generation", _hex("value").alias("value_hex"), "ttl_secs", "expires_at")


@query(f"SELECT db, count(*) FILTER (kind = 'PUT') AS live, count(*) FILTER (kind = 'DELETE') AS tombstones FROM ({LWW}) GROUP BY db")
def kv_index_stats(spark, sf):
    return st.index_stats(log(spark, sf))


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation FROM ({STATE})")
def kv_recover(spark, sf):
    rows = log(spark, sf).select("entry_id", "db", "key", "generation", "kind", *st.KEEP, "arrived_at")
    cut = F.lit(SNAPSHOT_AT).cast("timestamp_ntz")
    snapshot = st.lww(rows.where(F.col("arrived_at") < cut)).withColumn("entry_id", F.lit(0).cast("long"))
    since = rows.where(~(F.col("arrived_at") < cut) | F.col("arrived_at").isNull()).drop("arrived_at")
    return st.recover(snapshot, since).select("db", key_hex(F.col("key")).alias("key_hex"), "generation")


@query(f"""WITH c AS ({CHANGES}), d AS (SELECT db, max(generation) AS g FROM c WHERE arrived_at < TIMESTAMP '{SNAPSHOT_AT}' GROUP BY db)
  SELECT entry_id FROM c LEFT JOIN d USING (db) WHERE g IS NULL OR generation > g""")
def kv_wal_trim(spark, sf):
    rows = log(spark, sf).select("entry_id", "db", "generation", "arrived_at")
    durable = rows.where(F.col("arrived_at") < F.lit(SNAPSHOT_AT).cast("timestamp_ntz")).groupBy("db").agg(F.max("generation").alias("durable_generation"))
    return st.trim(rows, durable).select("entry_id")


_FILES = f"""SELECT shard, CAST(floor(coalesce(sum({SIZE_SQL}) OVER (PARTITION BY shard ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16384) AS BIGINT) AS file_no,
  {SIZE_SQL} AS bytes, generation FROM kv_log"""


def _files(spark, sf):
    rows = table(spark, sf, "kv_log").select("shard", "entry_id", "generation", _entry_bytes().alias("bytes"))
    return maintenance.log_files(rows, "shard", "entry_id", F.col("bytes"), 16_384)


@query(f"SELECT shard, file_no, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes, max(generation) AS max_generation FROM ({_FILES}) GROUP BY shard, file_no")
def kv_wal_rotate(spark, sf):
    return _files(spark, sf).groupBy("shard", "file_no").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.max("generation").alias("max_generation"))


@query(f"SELECT shard, file_no FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY file_no DESC) AS rn FROM (SELECT DISTINCT shard, file_no FROM ({_FILES}))) WHERE rn > 4")
def kv_wal_retention(spark, sf):
    return maintenance.retention(_files(spark, sf).select("shard", "file_no").distinct(), "shard", "file_no", 4)


@query(f"""WITH e AS (SELECT shard, count(*) AS entries, CAST(sum({SIZE_SQL}) AS BIGINT) AS bytes FROM kv_log GROUP BY shard)
  SELECT *, CAST((SELECT sum(bytes) FROM e) AS BIGINT) AS total_bytes, (SELECT max(bytes) FROM e) AS max_bytes, (SELECT min(bytes) FROM e) AS min_bytes FROM e""")
def kv_wal_stats(spark, sf):
    return stats.wal_stats(table(spark, sf, "kv_log"), "shard", _entry_bytes())


@query(f"""WITH c AS (SELECT * FROM ({CHANGES}) WHERE generation > CASE db WHEN 0 THEN 500 ELSE 100 END)
  SELECT db, count(*) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY generation DESC) AS rn FROM c) WHERE rn = 1 AND kind = 'PUT' GROUP BY db""")
def kv_flushdb(spark, sf):
    marks = spark.createDataFrame([(0, 500), (None, 100)], "db int, upto_generation long")
    return st.live(st.flush(log(spark, sf), marks)).groupBy("db").agg(F.count("*").alias("keys"))


@query(f"SELECT l.msg_id, lower(hex(l.key)) AS key_hex, lower(hex(s.value)) AS value_hex FROM ({LOOKUPS}) l LEFT JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key")
def kv_get(spark, sf):
    return found(spark, sf, lookups(spark, sf), ("value",)).select("msg_id", key_hex(F.col("key")).alias("key_hex"), _hex("value").alias("value_hex"))


@query("""SELECT CAST(p.pos AS INTEGER) AS pos, CAST(p.k AS BIGINT) AS key, o.o_totalprice AS value FROM (SELECT unnest(range(7)) AS pos, unnest([7, 3, 999999999, 7, 33, 1, 2]) AS k) p
  LEFT JOIN orders o ON o.o_orderkey = p.k""")
def kv_mget(spark, sf):
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(k).cast("long") for k in (7, 3, 999999999, 7, 33, 1, 2)])).alias("pos", "key"))
    held = table(spark, sf, "orders").select(F.lit(0).alias("db"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    return reads.get(asked.withColumn("db", F.lit(0)), held).select("pos", "key", "value")


@query(f"SELECT from_node, count(s.generation) AS n FROM ({LOOKUPS}) l LEFT JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key GROUP BY from_node")
def kv_exists(spark, sf):
    return found(spark, sf, lookups(spark, sf)).groupBy("from_node").agg(F.count("generation").alias("n"))


@query(f"""SELECT DISTINCT lower(hex(l.key)) AS key_hex, CASE WHEN s.generation IS NULL THEN 'none' ELSE 'string' END AS type, CASE WHEN s.generation IS NOT NULL THEN 'raw' END AS encoding
  FROM ({LOOKUPS}) l LEFT JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key""")
def kv_type(spark, sf):
    hits = found(spark, sf, lookups(spark, sf).select("db", "key").distinct()).select("db", "key", "generation")
    return reads.types(hits, F.col("generation").isNotNull()).select(key_hex(F.col("key")).alias("key_hex"), "type", "encoding")


@query(f"SELECT db, lower(hex(key)) AS key_hex FROM ({LIVE}) WHERE starts_with(hex(key), hex('user:'::BLOB))")
def kv_keys_prefix(spark, sf):
    return reads.keys(state(spark, sf, keep=()), "user:*").select("db", key_hex(F.col("key")).alias("key_hex"))


# u, any byte, e, r, colon, one of 1 to 4, anything; each as hex
@query(f"SELECT db, lower(hex(key)) AS key_hex FROM ({LIVE}) WHERE regexp_full_match(hex(key), '75..65723A3[1-4](..)*')")
def kv_keys_glob(spark, sf):
    return reads.keys(state(spark, sf, keep=()), "u?er:[1-4]*").select("db", key_hex(F.col("key")).alias("key_hex"))


@query(f"""WITH k AS (SELECT key FROM ({LIVE}) WHERE db = 0 AND contains(hex(key), '3A')), p AS (SELECT key FROM k ORDER BY key LIMIT 10 OFFSET 20)
  SELECT lower(hex(key)) AS key_hex, CAST(CASE WHEN (SELECT count(*) FROM k) > 30 THEN 30 ELSE 0 END AS BIGINT) AS next_cursor FROM p""")
def kv_scan_page(spark, sf):
    return reads.scan(state(spark, sf, keep=()), 0, 20, 10, "*:*").select(key_hex(F.col("key")).alias("key_hex"), "next_cursor")


@query(f"""WITH k AS (SELECT key FROM ({LIVE}) WHERE db = 0 AND contains(hex(key), '3A') AND hex(key) > hex('s'::BLOB)), p AS (SELECT lower(hex(key)) AS key_hex FROM k ORDER BY hex(key) LIMIT 15)
  SELECT key_hex, CASE WHEN (SELECT count(*) FROM k) > 15 THEN (SELECT max(key_hex) FROM p) END AS next_hex FROM p""")
def kv_scan_after(spark, sf):
    return reads.scan_after(state(spark, sf, keep=()), 0, b"s", 15, "*:*").select(key_hex(F.col("key")).alias("key_hex"), key_hex(F.col("next_after")).alias("next_hex"))


def _members(drawn, spark, sf, *by, n="n"):
    """Of drawn keys: how many, how many of them are different, and how many are no live keys."""
    held = state(spark, sf, keep=()).select(F.col("db").alias("d"), F.col("key").alias("k"))
    j = drawn.join(held, (F.col("db") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    return j.groupBy(*by).agg(F.count("*").alias(n), F.count_distinct("db", "key").alias("keys"), F.count_if(F.col("k").isNull()).alias("strangers"))


@query(f"SELECT db, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS keys, CAST(0 AS BIGINT) AS strangers FROM ({LIVE}) GROUP BY db")
def kv_randomkey(spark, sf):
    """One live key of each database; which one hangs on the seed."""
    return _members(reads.random_key(state(spark, sf, keep=()), 7), spark, sf, "db")


@query("SELECT * FROM (VALUES ('maxmemory', '0'), ('maxmemory-policy', 'noeviction')) AS t(name, value)")
def kv_config_get(spark, sf):
    from keystrata.functions.glob import glob_match

    pairs = {"maxmemory": "0", "maxmemory-policy": "noeviction", "databases": "16", "save": "", "appendonly": "yes", "timeout": "0"}
    return spark.createDataFrame(list(pairs.items()), "name string, value string").where(glob_match(F.col("name"), "maxm*"))


@query(f"SELECT db, count(*) AS keys, CAST(sum(octet_length(key) + coalesce(octet_length(value), 0)) AS BIGINT) AS data_bytes FROM ({LIVE}) GROUP BY db")
def kv_dbsize(spark, sf):
    return reads.dbsize(state(spark, sf, keep=("value_bytes",)))


@query("SELECT doc_id, CAST(coalesce(strlen(text), 0) AS INTEGER) AS n FROM documents")
def kv_strlen(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reads.strlen(F.col("text")).alias("n"))


@query("SELECT p_partkey, substr(p_name, 1, 5) AS head, right(p_name, 5) AS tail, '' AS none FROM part")
def kv_getrange(spark, sf):
    v = F.col("p_name").cast("binary")
    return table(spark, sf, "part").select("p_partkey", reads.getrange(v, 0, 4).cast("string").alias("head"), reads.getrange(v, -5, -1).cast("string").alias("tail"), reads.getrange(v, 7, 3).cast("string").alias("none"))


@query("""WITH p AS (SELECT p_partkey, hex(coalesce(p_name, '')::BLOB) AS h FROM part)
  SELECT p_partkey, decode(unhex(rpad(substr(h, 1, 6), 6, '0') || '5859' || substr(h, 11))) AS over_, rpad(substr(h, 1, 80), 80, '0') || '7A' || substr(h, 83) AS padded_hex FROM p""")
def kv_setrange(spark, sf):
    v = F.col("p_name").cast("binary")
    return table(spark, sf, "part").select("p_partkey", reads.setrange(v, 3, b"XY").cast("string").alias("over_"), F.hex(reads.setrange(v, 40, b"z")).alias("padded_hex"))





def _ttl(spark, sf, unit):
    hit = found(spark, sf, lookups(spark, sf).select("db", "key").distinct())
    return hit.select(key_hex(F.col("key")).alias("key_hex"), reads.ttl(F.col("expires_at"), F.col("generation").isNotNull(), _now(), unit).alias("ttl"))


_TTL_FROM = f"FROM (SELECT DISTINCT db, key FROM ({LOOKUPS})) l LEFT JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key"
_LEFT = f"(epoch_us(s.expires_at) - epoch_us(TIMESTAMP '{AS_OF}'))"


@query(f"SELECT lower(hex(l.key)) AS key_hex, CAST(CASE WHEN s.generation IS NULL THEN -2 WHEN s.expires_at IS NULL THEN -1 ELSE {_LEFT} // 1000000 END AS BIGINT) AS ttl {_TTL_FROM}")
def kv_ttl_cmd(spark, sf):
    return _ttl(spark, sf, 1_000_000)


@query(f"SELECT lower(hex(l.key)) AS key_hex, CAST(CASE WHEN s.generation IS NULL THEN -2 WHEN s.expires_at IS NULL THEN -1 ELSE {_LEFT} // 1000 END AS BIGINT) AS ttl {_TTL_FROM}")
def kv_pttl_cmd(spark, sf):
    return _ttl(spark, sf, 1000)


@query(f"SELECT db, count(*) AS expired FROM ({STATE}) WHERE expires_at <= TIMESTAMP '{AS_OF}' GROUP BY db")
def kv_expiry_sweep(spark, sf):
    return state(spark, sf, None, ()).where(F.col("expires_at") <= _now()).groupBy("db").agg(F.count("*").alias("expired"))


@query(f"""SELECT db, lower(hex(key)) AS key_hex, CAST(300 AS BIGINT) AS expire_ttl, TIMESTAMP '{AS_OF}' + INTERVAL 300 SECOND AS expire_at,
  CAST(CASE WHEN ttl_secs > 0 THEN 1 ELSE 0 END AS INTEGER) AS persist_reply, nullif(generation % 4000 // 1000, 0) AS pexpire_ttl FROM ({LIVE})""")
def kv_expire_persist(spark, sf):
    """EXPIRE 300, PEXPIRE (generation % 4000) and PERSIST on every live key at AS_OF: new lifetimes, null where PEXPIRE deletes, and PERSIST's reply."""
    s = state(spark, sf, keep=())
    return s.select("db", key_hex(F.col("key")).alias("key_hex"), F.lit(300).cast("long").alias("expire_ttl"), st.expires_at(_now(), F.lit(300)).alias("expire_at"),
        F.when(F.col("ttl_secs") > 0, 1).otherwise(0).alias("persist_reply"), reads.pexpire(F.col("generation") % 4000).alias("pexpire_ttl"))


@query(f"""SELECT db, lower(hex(key)) AS key_hex, CAST(CASE WHEN t > TIMESTAMP '{AS_OF}' THEN (epoch_us(t) - epoch_us(TIMESTAMP '{AS_OF}')) // 1000000 END AS BIGINT) AS ttl,
  t <= TIMESTAMP '{AS_OF}' AS deleted FROM (SELECT *, ts + INTERVAL 7 DAY AS t FROM ({LIVE}) WHERE ts IS NOT NULL)""")
def kv_expireat(spark, sf):
    """EXPIREAT seven days after each key's write, run at AS_OF: a moment that has passed deletes."""
    s = state(spark, sf, keep=()).where("ts IS NOT NULL").withColumn("t", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    left = F.floor((F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(_now().cast("timestamp"))) / 1_000_000).cast("long")
    return s.select("db", key_hex(F.col("key")).alias("key_hex"), F.when(F.col("t") > _now(), left).alias("ttl"), (F.col("t") <= _now()).alias("deleted"))


@query(f"""WITH s AS ({LIVE}), p AS (SELECT * FROM s WHERE starts_with(hex(key), hex('user:'::BLOB)))
  SELECT db, hex('moved/'::BLOB) || hex(key) AS key_hex, 'PUT' AS kind, ttl_secs FROM p UNION ALL SELECT db, hex(key), 'DELETE', NULL FROM p""")
def kv_rename(spark, sf):
    """RENAME user:* to moved/user:*: the rows that go to the log. Value and lifetime move, the old key is deleted."""
    p = state(spark, sf, keep=()).where(key_match(F.col("key"), "user:*"))
    new = p.select("db", F.hex(F.concat(F.lit(b"moved/"), "key")).alias("key_hex"), F.lit("PUT").alias("kind"), "ttl_secs")
    return new.unionByName(p.select("db", F.hex("key").alias("key_hex"), F.lit("DELETE").alias("kind"), F.lit(None).cast("long").alias("ttl_secs")))


@query(f"""WITH s AS ({LIVE}) SELECT 5 AS db, lower(hex(a.key)) AS key_hex, lower(hex(a.value)) AS value_hex, CAST(CASE WHEN b.key IS NULL THEN 1 ELSE 0 END AS INTEGER) AS reply
  FROM s a LEFT JOIN s b ON b.db = 5 AND b.key = a.key WHERE a.db = 0""")
def kv_copy(spark, sf):
    """COPY every key of database 0 to database 5 without REPLACE: 1 where the target is free, RENAMENX's test too."""
    s = state(spark, sf)
    src, taken = s.where("db = 0").select("key", "value"), s.where("db = 5").select("key", F.lit(1).alias("taken"))
    return src.join(taken, "key", "left").select(F.lit(5).alias("db"), key_hex(F.col("key")).alias("key_hex"), _hex("value").alias("value_hex"), F.when(F.col("taken").isNull(), 1).otherwise(0).alias("reply"))


@query("SELECT CAST(pos AS INTEGER) AS pos, key, value FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS f, unnest([o_orderstatus, o_orderpriority]) AS value, unnest([0, 1]) AS pos, f || ':' || o_orderkey AS key FROM orders)")
def kv_mset(spark, sf):
    """MSET of two keys for each order: pairs in argument order."""
    pairs = F.arrays_zip(F.array(F.lit("status"), F.lit("priority")).alias("f"), F.array("o_orderstatus", "o_orderpriority").alias("v"))
    o = table(spark, sf, "orders").select("o_orderkey", F.posexplode(pairs).alias("pos", "p"))
    return o.select("pos", F.concat_ws(":", F.col("p.f"), F.col("o_orderkey").cast("string")).alias("key"), F.col("p.v").alias("value"))


@query(f"SELECT db, count(*) AS requested, count(generation) AS deleted FROM (SELECT DISTINCT l.db, l.key, s.generation FROM ({LOOKUPS}) l LEFT JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key) GROUP BY db")
def kv_del(spark, sf):
    """DEL of all looked-up keys: how many are deleted; the second DEL of a key gives 0, as GETDEL gives null."""
    hit = found(spark, sf, lookups(spark, sf).select("db", "key").distinct())
    return hit.groupBy("db").agg(F.count("*").alias("requested"), F.count("generation").alias("deleted"))


def _evicted(policy, key="lower(hex(key))"):
    order = {"allkeys-lru": "generation", "volatile-lru": "generation", "volatile-ttl": "expires_at, generation"}[policy]
    may = "TRUE" if policy.startswith("allkeys") else "expires_at IS NOT NULL"
    return f"""WITH s AS ({LIVE}), x AS (SELECT db, count(*) - 50 AS excess FROM s GROUP BY db)
      SELECT db, {key} AS key_hex FROM (SELECT s.*, excess, row_number() OVER (PARTITION BY db ORDER BY {order}, key) AS place FROM s JOIN x USING (db) WHERE {may}) WHERE place <= excess"""


def _evict(policy):
    def f(spark, sf):
        gone = maintenance.evict(state(spark, sf, keep=()), policy, 50, 3)
        return _members(gone, spark, sf, "db", n="evicted") if "random" in policy else gone.select("db", key_hex(F.col("key")).alias("key_hex"))

    f.__name__ = "kv_evict_" + policy.replace("-", "_")
    return f


def _evicted_at_random(policy):
    may = "count(*)" if policy.startswith("allkeys") else "count(expires_at)"
    return f"""SELECT db, n AS evicted, n AS keys, CAST(0 AS BIGINT) AS strangers FROM (SELECT db, least({may}, count(*) - 50) AS n FROM ({LIVE}) GROUP BY db) WHERE n > 0"""


for _p in maintenance.POLICIES[1:]:
    query(_evicted_at_random(_p) if "random" in _p else _evicted(_p))(_evict(_p))

_BYTES = "octet_length(key) + coalesce(octet_length(value), 0)"


@query(f"""WITH s AS (SELECT *, {_BYTES} AS b FROM ({LIVE})), x AS (SELECT db, sum(b) - 9000 AS excess FROM s GROUP BY db)
  SELECT db, lower(hex(key)) AS key_hex FROM (SELECT s.*, excess, sum(b) OVER (PARTITION BY db ORDER BY expires_at, generation, key ROWS UNBOUNDED PRECEDING) - b AS begun FROM s JOIN x USING (db) WHERE expires_at IS NOT NULL) WHERE begun < excess""")
def kv_evict_bytes(spark, sf):
    """volatile-ttl down to 9,000 bytes of keys and values in each database."""
    s = state(spark, sf, keep=("value_bytes",))
    return maintenance.evict(s, "volatile-ttl", max_bytes=9_000).select("db", key_hex(F.col("key")).alias("key_hex"))


@query(f"""SELECT from_node, count(s.generation) AS hits FROM ({LOOKUPS}) l JOIN ({LIVE}) s ON l.db = s.db AND l.key = s.key GROUP BY from_node""")
def kv_bloom_prefilter(spark, sf):
    """Lookups that a Bloom filter of the live keys lets through, then looked up: no hit is lost."""
    held = state(spark, sf, keep=()).select("db", "key")
    asked = bloom.passing(lookups(spark, sf), ["db", "key"], bloom.build(held, ["db", "key"]))
    return reads.probe(asked, held.withColumn("hit", F.lit(1))).where("hit = 1").groupBy("from_node").agg(F.count("*").alias("hits"))


@query(f"WITH n AS (SELECT count(*) AS keys FROM ({LIVE})) SELECT keys, TRUE AS fill_as_expected FROM n")
def kv_bloom_fill(spark, sf):
    """The fill ratio of a filter of 2**20 bits over the live keys, against 1 - exp(-hashes * keys / bits)."""
    held, bits = state(spark, sf, keep=()).select("db", "key"), 1 << 20
    fill = bloom.fill_ratio(bloom.build(held, ["db", "key"], bits), bits).withColumn("keys", held.agg(F.count("*")).scalar())
    want = 1 - F.exp(-bloom.HASHES * F.col("keys") / bits)
    return fill.select("keys", (F.abs(F.col("fill") - want) <= 0.02 * want + 1e-5).alias("fill_as_expected"))


# A db's changes in order, folded over the keys it holds: a PUT of another key is refused at 40, a DELETE frees a place.
@query(f"""WITH c AS (SELECT db, lower(hex(key)) AS k, generation AS g, kind = 'PUT' AS put, row_number() OVER (PARTITION BY db, key, generation ORDER BY entry_id) AS n FROM ({CHANGES})),
  l AS (SELECT db, list({{'k': k, 'put': put, 'held': []::VARCHAR[], 'refused': 0::BIGINT}} ORDER BY g, k) AS steps FROM c WHERE n = 1 GROUP BY db)
  SELECT db, list_reduce(list_prepend({{'k': '', 'put': FALSE, 'held': []::VARCHAR[], 'refused': 0::BIGINT}}, steps), lambda s, x: {{'k': '', 'put': FALSE,
    'held': CASE WHEN NOT x.put THEN list_filter(s.held, lambda h: h <> x.k) WHEN list_contains(s.held, x.k) OR len(s.held) >= 40 THEN s.held ELSE list_append(s.held, x.k) END,
    'refused': s.refused + CASE WHEN x.put AND NOT list_contains(s.held, x.k) AND len(s.held) >= 40 THEN 1 ELSE 0 END}}).refused AS refused FROM l""")
def kv_capacity(spark, sf):
    rows = log(spark, sf).select("entry_id", "db", "key", "generation", "kind")
    return maintenance.over_capacity(rows, 40).groupBy("db").agg(F.count_if("oom").alias("refused"))


_UTIL = """SELECT db, file_id, wblock_id, CAST(sum(coalesce(live_records, 0)) AS BIGINT) AS live, CAST(sum(coalesce(total_records, 0)) AS BIGINT) AS total,
  CASE WHEN sum(coalesce(total_records, 0)) > 0 THEN sum(coalesce(live_records, 0)) / sum(coalesce(total_records, 0)) ELSE 1.0 END::DOUBLE AS utilization
  FROM (SELECT DISTINCT * FROM wblock_meta) GROUP BY ALL"""


@query(_UTIL)
def kv_utilization(spark, sf):
    return maintenance.utilization(table(spark, sf, "wblock_meta").distinct(), ["db", "file_id", "wblock_id"])


@query(f"""WITH f AS (SELECT * FROM ({_UTIL}) WHERE utilization < 0.5) SELECT * FROM f WHERE (SELECT count(*) FROM f) >= 10 ORDER BY utilization, db, file_id, wblock_id LIMIT 100""")
def kv_compaction_candidates(spark, sf):
    return maintenance.fragmented(table(spark, sf, "wblock_meta").distinct(), ["db", "file_id", "wblock_id"])


@query("""WITH b AS (SELECT db, file_id, CASE WHEN file_id % 2 = 0 AND live_records > 0 THEN 0 ELSE live_records END AS live_records FROM (SELECT DISTINCT * FROM wblock_meta))
  SELECT db, file_id, count(*) AS blocks FROM b GROUP BY db, file_id HAVING max(coalesce(live_records, 1)) <= 0""")
def kv_unlink_files(spark, sf):
    """Files without a live record once every second one has been emptied; one with a block of unknown count stays."""
    emptied = F.when(F.col("file_id") % 2 == 0, F.least(F.col("live_records"), F.lit(0))).otherwise(F.col("live_records"))
    emptied = F.when(F.col("live_records").isNotNull(), emptied)
    return maintenance.unlinkable(table(spark, sf, "wblock_meta").distinct().withColumn("live_records", emptied), ["db", "file_id"])


@query(f"""SELECT db, CAST(('0x' || substr(h, 1, 1)) AS INTEGER) AS shard, least(count(*), 2) AS n, least(count(*), 2) AS keys, CAST(0 AS BIGINT) AS strangers
  FROM (SELECT db, md5(key) AS h FROM ({LIVE})) GROUP BY db, CAST(('0x' || substr(h, 1, 1)) AS INTEGER)""")
def kv_eviction_sample(spark, sf):
    """Two candidates of each database and shard; which ones hangs on the seed."""
    shard = F.conv(F.substring(F.md5("key"), 1, 1), 16, 10).cast("int")
    return _members(maintenance.candidates(state(spark, sf, keep=()), shard, 2, 5), spark, sf, "db", "shard")


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation FROM ({STATE})")
def kv_compact(spark, sf):
    return maintenance.compact(log(spark, sf).select("db", "key", "generation", "value"), state(spark, sf, None, ())).select("db", key_hex(F.col("key")).alias("key_hex"), "generation")


@query(f"""SELECT shard, count(*) AS n FROM (SELECT CAST(('0x' || substr(md5(key), 1, 2)) AS INTEGER) AS shard FROM ({LIVE})) GROUP BY shard""")
def kv_export_shard(spark, sf):
    """Live keys by storage shard; 256 shards by a hash of the key."""
    return state(spark, sf, keep=()).select(F.conv(F.substring(F.md5("key"), 1, 2), 16, 10).cast("int").alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(('0x' || substr(md5(key), 1, 2)) AS INTEGER) AS shard, db, lower(hex(key)) AS key_hex, lower(hex(value)) AS value_hex FROM ({LIVE})""")
def kv_export_pairs(spark, sf):
    """Live keys and values of all storage shards; `kv_export_shard` counts them."""
    shard = F.conv(F.substring(F.md5("key"), 1, 2), 16, 10).cast("int").alias("shard")
    return state(spark, sf).select(shard, "db", key_hex(F.col("key")).alias("key_hex"), _hex("value").alias("value_hex"))


@query(f"SELECT CAST(coalesce(sum(octet_length(key) + coalesce(octet_length(value), 0)), 0) AS BIGINT) AS used_memory, CASE WHEN coalesce(sum(octet_length(key) + coalesce(octet_length(value), 0)), 0) < 1024 THEN 'x' ELSE printf('%.2fK', sum(octet_length(key) + coalesce(octet_length(value), 0)) / 1024.0) END AS used_memory_k FROM ({LIVE})")
def kv_memory(spark, sf):
    return stats.memory(state(spark, sf, keep=("value_bytes",))).select("used_memory", F.format_string("%.2fK", F.col("used_memory") / 1024.0).alias("used_memory_k"))


@query(f"""WITH k AS (SELECT db, count(*) AS keys, count(expires_at) AS expires FROM ({LIVE}) GROUP BY db),
  m AS (SELECT CAST(coalesce(sum(octet_length(key) + coalesce(octet_length(value), 0)), 0) AS BIGINT) AS b FROM ({LIVE})),
  w AS (SELECT CAST(sum({SIZE_SQL}) AS BIGINT) AS bytes, count(*) AS entries FROM kv_log)
  SELECT 'keyspace' AS section, 'db' || db AS name, 'keys=' || keys || ',expires=' || expires AS value FROM k
  UNION ALL SELECT 'memory', 'used_memory', CAST(b AS VARCHAR) FROM m UNION ALL SELECT 'wal', 'bytes', CAST(bytes AS VARCHAR) FROM w UNION ALL SELECT 'wal', 'entries', CAST(entries AS VARCHAR) FROM w""")
def kv_info(spark, sf):
    s = state(spark, sf, keep=("value_bytes",))
    space = s.groupBy("db").agg(F.count("*").alias("keys"), F.count("expires_at").alias("expires")).select(
        F.lit("keyspace").alias("section"), F.concat(F.lit("db"), F.col("db").cast("string")).alias("name"), F.format_string("keys=%d,expires=%d", "keys", "expires").alias("value"))
    wal = table(spark, sf, "kv_log").agg(F.sum(_entry_bytes()).alias("bytes"), F.count("*").alias("entries"))
    return stats.info({"memory": stats.memory(s).select("used_memory"), "wal": wal}).unionByName(space)
