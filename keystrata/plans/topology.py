"""Queries on slots, nodes and traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.functions.keys import effective_key, key_hex
from keystrata.functions.slots import hash_tag, key_slot
from keystrata.operators import cluster, stats
from keystrata.plans.base import LIVE, crc16_sql, found, lookups, query
from keystrata.session import table

_NODES = "(SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS rank, count(*) OVER () AS n FROM nodes)"
_SLOTS = f"""SELECT CAST(s.slot AS INTEGER) AS slot, p.node_id AS "primary", r.node_id AS replica FROM (SELECT unnest(range(16384)) AS slot) s
  JOIN {_NODES} p ON p.rank = least(s.slot // CAST(ceil(16384.0 / p.n) AS BIGINT), p.n - 1) JOIN {_NODES} r ON r.rank = (p.rank + 1) % p.n"""
_ACTIVE = """SELECT s.slot, p.node_id FROM (SELECT unnest(range(16384)) AS slot) s JOIN (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE status = 'active') p
  ON p.rank = least(s.slot // CAST(ceil(16384.0 / p.n) AS BIGINT), p.n - 1)"""
_RANGES = f"""SELECT "primary", CAST(min(slot) AS INTEGER) AS first, CAST(max(slot) AS INTEGER) AS last FROM (SELECT slot, "primary", slot - row_number() OVER (PARTITION BY "primary" ORDER BY slot) AS island FROM ({_SLOTS})) GROUP BY "primary", island"""


def _slots(spark, sf):
    return cluster.assign(spark, table(spark, sf, "nodes"), 2)


@query(f"SELECT c_custkey, c_name AS key, CAST({crc16_sql('c_name')} % 16384 AS INTEGER) AS slot FROM customer")
def kv_keyslot(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("key"), key_slot(F.col("c_name")).alias("slot"))


_TAGGED = "CASE WHEN c_custkey % 3 = 0 THEN '{' || c_mktsegment || '}:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'a{}' || c_custkey ELSE c_name END"


@query(f"SELECT key, tag, CAST({crc16_sql('tag')} % 16384 AS INTEGER) AS slot FROM (SELECT key, CASE WHEN regexp_extract(key, '^[^{{]*\\{{([^}}]+)\\}}', 1) <> '' THEN regexp_extract(key, '^[^{{]*\\{{([^}}]+)\\}}', 1) ELSE key END AS tag FROM (SELECT {_TAGGED} AS key FROM customer))")
def kv_hash_tag(spark, sf):
    k = F.col("c_custkey").cast("string")
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{"), "c_mktsegment", F.lit("}:"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a{}"), k)).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(key.alias("key")).select("key", hash_tag(F.col("key")).cast("string").alias("tag"), key_slot(F.col("key")).alias("slot"))


@query(f'SELECT slot, "primary", [replica] AS replicas FROM ({_SLOTS})')
def kv_slot_assign(spark, sf):
    return _slots(spark, sf)


@query(_RANGES)
def kv_slot_ranges(spark, sf):
    return cluster.ranges(_slots(spark, sf))


@query(f'SELECT "primary", count(*) AS slots FROM ({_SLOTS}) GROUP BY "primary"')
def kv_slots_per_node(spark, sf):
    return _slots(spark, sf).groupBy("primary").agg(F.count("*").alias("slots"))


@query(f"""SELECT k.key, k.slot, CASE WHEN s."primary" <> 2 THEN 'MOVED ' || k.slot || ' ' || n.redis_addr END AS moved FROM (SELECT c_name AS key, CAST({crc16_sql('c_name')} % 16384 AS INTEGER) AS slot FROM customer) k
  JOIN ({_SLOTS}) s ON s.slot = k.slot JOIN nodes n ON n.node_id = s."primary" """)
def kv_moved(spark, sf):
    keyed = table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    return cluster.route(keyed, key_slot(F.col("key")), _slots(spark, sf), table(spark, sf, "nodes"), 2)


@query(f'SELECT o.slot, o."primary" AS old, a.node_id AS new FROM ({_SLOTS}) o JOIN ({_ACTIVE}) a ON a.slot = o.slot WHERE o."primary" <> a.node_id')
def kv_rebalance(spark, sf):
    return cluster.rebalance(_slots(spark, sf), table(spark, sf, "nodes"))


@query(f"""WITH s AS (SELECT n.status FROM ({_SLOTS}) s JOIN nodes n ON n.node_id = s."primary"), a AS (SELECT count(*) AS t, count(*) FILTER (status = 'active') AS o, count(*) FILTER (status = 'suspect') AS p, count(*) FILTER (status = 'dead') AS f FROM s)
  SELECT unnest(['cluster_slots_assigned', 'cluster_slots_ok', 'cluster_slots_pfail', 'cluster_slots_fail', 'cluster_known_nodes', 'cluster_state']) AS name,
  unnest([t::VARCHAR, o::VARCHAR, p::VARCHAR, f::VARCHAR, (SELECT count(*) FROM nodes)::VARCHAR, CASE WHEN t = 16384 AND f = 0 THEN 'ok' ELSE 'fail' END]) AS value FROM a""")
def kv_cluster_info(spark, sf):
    return cluster.cluster_info(_slots(spark, sf), table(spark, sf, "nodes"))


@query(f'SELECT r.first, r.last, r."primary", n.redis_addr FROM ({_RANGES}) r JOIN nodes n ON n.node_id = r."primary"')
def kv_cluster_slots(spark, sf):
    return cluster.cluster_slots(_slots(spark, sf), table(spark, sf, "nodes"))


@query(f"""SELECT n.node_id, n.redis_addr, n.status, CAST(coalesce(sum(r.last - r.first + 1), 0) AS BIGINT) AS slots, coalesce(string_agg(r.first || '-' || r.last, ' ' ORDER BY r.first), '') AS ranges
  FROM nodes n LEFT JOIN ({_RANGES}) r ON n.node_id = r."primary" GROUP BY ALL""")
def kv_cluster_nodes(spark, sf):
    return cluster.cluster_nodes(_slots(spark, sf), table(spark, sf, "nodes"))


@query("""SELECT to_node AS node_id, CAST(greatest(count(*) - count(*) FILTER (epoch_us(recv_ts) - epoch_us(sent_ts) < 1000000), 0) AS BIGINT) AS lag, count(*) FILTER (sent_ts IS NULL) > 0 AS diverged
  FROM peer_messages WHERE op IN (65, 66) GROUP BY to_node""")
def kv_replica_lag(spark, sf):
    """Of the replicated writes to a node, those that came within a second count as acknowledged, those without a send time as failed."""
    m = table(spark, sf, "peer_messages").where(F.col("op").isin(65, 66))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = m.groupBy(F.col("to_node").alias("node_id")).agg(F.count("*").alias("sent"), F.count_if(us("recv_ts") - us("sent_ts") < 1_000_000).alias("acked"), F.count_if(F.col("sent_ts").isNull()).alias("failed"))
    return cluster.replica_lag(n)


_US = "epoch_us(recv_ts) - epoch_us(sent_ts)"
_HIST = f"SELECT op, CAST(least(floor(log2(greatest({_US}, 1)::DOUBLE)), 23) AS INTEGER) AS bucket, count(*) AS n FROM peer_messages WHERE sent_ts IS NOT NULL AND recv_ts IS NOT NULL GROUP BY ALL"


def _histogram(spark, sf):
    us = F.unix_micros(F.col("recv_ts").cast("timestamp")) - F.unix_micros(F.col("sent_ts").cast("timestamp"))
    return stats.histogram(table(spark, sf, "peer_messages").select("op", us.alias("us")), F.col("us"), ["op"])


@query(_HIST)
def kv_latency_hist(spark, sf):
    return _histogram(spark, sf)


@query(f"""WITH r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY op) AS total FROM ({_HIST}))
  SELECT op, 1::BIGINT << (min(bucket) FILTER (run >= ceil(total * 0.5)) + 1) AS p50, 1::BIGINT << (min(bucket) FILTER (run >= ceil(total * 0.99)) + 1) AS p99, 1::BIGINT << (min(bucket) FILTER (run >= ceil(total * 0.999)) + 1) AS p999 FROM r GROUP BY op""")
def kv_latency_percentiles(spark, sf):
    return stats.percentile_bounds(_histogram(spark, sf), ["op"], {"p50": 0.5, "p99": 0.99, "p999": 0.999})


@query(f"SELECT op, count(*) AS n, CAST(sum({_US}) AS BIGINT) // count(*) AS mean_us, max({_US}) AS max_us FROM peer_messages WHERE sent_ts IS NOT NULL AND recv_ts IS NOT NULL AND recv_ts >= sent_ts GROUP BY op")
def kv_latency_mean(spark, sf):
    us = F.unix_micros(F.col("recv_ts").cast("timestamp")) - F.unix_micros(F.col("sent_ts").cast("timestamp"))
    m = table(spark, sf, "peer_messages").where("sent_ts IS NOT NULL AND recv_ts IS NOT NULL AND recv_ts >= sent_ts").select("op", us.alias("us"))
    return m.groupBy("op").agg(F.count("*").alias("n"), F.expr("sum(us) div count(1)").alias("mean_us"), F.max("us").alias("max_us"))


@query(f"""SELECT from_node, count(s.generation) AS hits, count(*) - count(s.generation) AS misses, count(s.generation) / count(*)::DOUBLE AS ratio
  FROM (SELECT from_node, CASE WHEN key_len IS NULL THEN key ELSE unhex(substr(hex(key), 1, 2 * greatest(key_len, 0)::BIGINT)) END AS key FROM peer_messages WHERE op = 49) l
  LEFT JOIN ({LIVE}) s ON s.db = 0 AND s.key = l.key WHERE octet_length(l.key) > 0 GROUP BY from_node""")
def kv_hit_ratio(spark, sf):
    return stats.hit_ratio(found(spark, sf, lookups(spark, sf)), F.col("generation").isNotNull(), ["from_node"])


@query("""SELECT CASE WHEN op = 49 THEN 'gets' WHEN op IN (50, 65) THEN 'puts' WHEN op IN (51, 66) THEN 'deletes' ELSE 'other' END AS counter, count(*) AS n FROM peer_messages GROUP BY 1""")
def kv_op_counts(spark, sf):
    name = F.when(F.col("op") == 49, "gets").when(F.col("op").isin(50, 65), "puts").when(F.col("op").isin(51, 66), "deletes").otherwise("other")
    return table(spark, sf, "peer_messages").groupBy(name.alias("counter")).agg(F.count("*").alias("n"))


@query("""SELECT msg_id, lower(hex(k)) AS key_hex FROM (SELECT msg_id, CASE WHEN key_len IS NULL THEN key ELSE unhex(substr(hex(key), 1, 2 * greatest(key_len, 0)::BIGINT)) END AS k FROM peer_messages WHERE op IN (65, 66)) WHERE octet_length(k) > 0""")
def kv_replicate(spark, sf):
    """Log shipping: the replicated writes that a second sink of the log would get."""
    m = table(spark, sf, "peer_messages").where(F.col("op").isin(65, 66))
    return m.select("msg_id", key_hex(effective_key(F.col("key"), F.col("key_len"))).alias("key_hex")).where("key_hex IS NOT NULL")


_LATENCY = f"""SELECT CASE WHEN op = 49 THEN 'get' WHEN op IN (50, 65) THEN 'set' WHEN op IN (51, 66) THEN 'del' END AS kind, {_US} AS us FROM peer_messages WHERE op IN (49, 50, 65, 51, 66)"""
_BOUNDS = f"""SELECT kind, max(n) AS ops, {", ".join(f"1::BIGINT << (min(bucket) FILTER (run >= ceil(ops * {p})) + 1) AS {name}" for name, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999)))} FROM (
  SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY kind) AS ops FROM (
    SELECT kind, CAST(least(floor(log2(greatest(us, 1)::DOUBLE)), 23) AS INTEGER) AS bucket, count(*) AS n FROM ({_LATENCY}) WHERE us IS NOT NULL GROUP BY ALL)) GROUP BY kind"""
_LAGS = """SELECT to_node, count(*) AS sent, count(*) FILTER (epoch_us(recv_ts) - epoch_us(sent_ts) < 1000000) AS acked, count(*) FILTER (sent_ts IS NULL) AS failed FROM peer_messages WHERE op IN (65, 66) GROUP BY to_node"""


@query(f"""WITH r AS ({_LAGS}), l AS (SELECT kind, count(us) AS n, max(us) AS most FROM ({_LATENCY}) GROUP BY kind), b AS ({_BOUNDS})
  SELECT 'server' AS section, unnest(['redis_version', 'redis_mode']) AS name, unnest(['7.0.0', 'cluster']) AS value
  UNION ALL SELECT 'replication', unnest(['role', 'repl_entries_sent', 'repl_errors']), unnest(['master', CAST(sum(sent) AS BIGINT)::VARCHAR, CAST(sum(failed) AS BIGINT)::VARCHAR]) FROM r
  UNION ALL SELECT 'replication', 'replica_' || to_node || '_' || unnest(['sent', 'acked', 'failed', 'lag', 'diverged']), unnest([sent, acked, failed, greatest(sent - acked, 0), CASE WHEN failed > 0 THEN 1 ELSE 0 END])::VARCHAR FROM r
  UNION ALL SELECT 'latencystats', 'latency_percentiles_usec_' || kind, 'p50=' || p50 || ',p99=' || p99 || ',p999=' || p999 || ',max=' || greatest(most, 0) FROM l JOIN b USING (kind)
  UNION ALL SELECT 'latencystats', kind || '_ops', n::VARCHAR FROM l""")
def kv_info_sections(spark, sf):
    """INFO's Server, Replication and Latencystats; `kv_info` has Memory, Wal and Keyspace."""
    m = table(spark, sf, "peer_messages").select("op", "to_node", "sent_ts", "recv_ts")
    us = F.unix_micros(F.col("recv_ts").cast("timestamp")) - F.unix_micros(F.col("sent_ts").cast("timestamp"))
    counts = m.where(F.col("op").isin(65, 66)).groupBy(F.col("to_node").alias("node_id")).agg(F.count("*").alias("sent"), F.count_if(us < 1_000_000).alias("acked"), F.count_if(F.col("sent_ts").isNull()).alias("failed"))
    lags = counts.join(cluster.replica_lag(counts).withColumnRenamed("node_id", "of"), F.col("node_id") == F.col("of")).drop("of")
    kind = F.when(F.col("op") == 49, "get").when(F.col("op").isin(50, 65), "set").when(F.col("op").isin(51, 66), "del")
    return stats.info({"server": stats.server("cluster", spark)}).unionByName(stats.replication(lags)).unionByName(stats.latencystats(m, kind, us))
