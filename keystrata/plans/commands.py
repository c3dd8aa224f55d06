"""Queries on mixed commands, by the interpreter: transactions, databases, errors, moments, renames, subscriptions, cluster answers.

The commands are made from the events; each query gives replies that SQL can work out from the events alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators import cluster, interpreter
from keystrata.plans.base import crc16_sql, query
from keystrata.session import table


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string").cast("binary")


def _command(rows: DataFrame, seq: Column, cmd: str, *args, db: Column | int = 0, conn: Column | int = 0) -> DataFrame:
    """One command for each row; numbers and names as text."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(seq.cast("long").alias("seq"), lit(db).cast("int").alias("db"), lit(conn).cast("long").alias("conn_id"), F.lit(cmd).alias("cmd"),
        F.array(*[_text(a) for a in args]) if args else F.array().cast("array<binary>"), "ts").toDF("seq", "db", "conn_id", "cmd", "args", "ts")


def _all(*commands: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, commands)


def _events(spark, sf, *types) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return e.where(F.col("event_type").isin(*types)) if types else e


def _id() -> Column:
    return F.col("event_id")


def _key() -> Column:
    return F.concat(F.lit("k"), F.col("event_id").cast("string"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'click'),
  t AS (SELECT user_id, day, day(day) % 5 = 0 AS dropped, min(event_id) AS f, max(event_id) AS l, count(*) AS n, sum(v) AS s FROM e GROUP BY user_id, day),
  u AS (SELECT *, sum(CASE WHEN dropped THEN 0 ELSE s END) OVER (PARTITION BY user_id ORDER BY f) AS total FROM t)
  SELECT f * 4 AS seq, 'simple' AS kind, 'OK' AS str, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS last FROM u UNION ALL SELECT event_id * 4 + 1, 'simple', 'QUEUED', NULL, NULL FROM e
  UNION ALL SELECT l * 4 + 2, CASE WHEN dropped THEN 'simple' ELSE 'array' END, CASE WHEN dropped THEN 'OK' END, CASE WHEN NOT dropped THEN CAST(n AS INTEGER) END, CASE WHEN NOT dropped THEN CAST(CAST(total AS BIGINT) AS VARCHAR) END FROM u""")
def kv_multi_exec(spark, sf):
    """A user's clicks of a day as one transaction of INCRBYs: MULTI, the queued commands, EXEC, or DISCARD on every fifth day of a month."""
    e = _events(spark, sf, "click").withColumn("day", F.to_date("ts"))
    t = e.groupBy("user_id", "day").agg(F.min("event_id").alias("f"), F.max("event_id").alias("l"), F.min("ts").alias("ts")).withColumn("dropped", F.dayofmonth("day") % 5 == 0)
    at = {"db": F.col("user_id") % 4, "conn": F.col("user_id")}
    key = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    r = interpreter.replay(_all(
        _command(t, F.col("f") * 4, "MULTI", **at), _command(e, _id() * 4 + 1, "INCRBY", key, F.floor("value").cast("long"), **at),
        _command(t.where("NOT dropped"), F.col("l") * 4 + 2, "EXEC", **at), _command(t.where("dropped"), F.col("l") * 4 + 2, "DISCARD", **at)))
    items = F.col("kind") == "array"
    return r.select("seq", "kind", "str", F.when(items, F.size("items")).alias("n"), F.when(items, F.element_at("items", -1).cast("string")).alias("last"))


@query("""WITH e AS (SELECT event_id, user_id % 20 AS asked FROM events WHERE event_type = 'view')
  SELECT event_id * 2 AS seq, CASE WHEN asked < 16 THEN 'simple' ELSE 'error' END AS kind, CASE WHEN asked < 16 THEN 'OK' ELSE 'ERR DB index is out of range' END AS str, CAST(NULL AS BIGINT) AS n FROM e
  UNION ALL SELECT event_id * 2 + 1, 'integer', NULL, row_number() OVER (PARTITION BY CASE WHEN asked < 16 THEN asked ELSE 0 END ORDER BY event_id) FROM e""")
def kv_select(spark, sf):
    """Each view SELECTs database user_id % 20, of which 16 to 19 do not exist, and counts in the database it is in."""
    e = _events(spark, sf, "view")
    r = interpreter.replay(_all(_command(e, _id() * 2, "SELECT", F.col("user_id") % 20, conn=F.col("user_id")), _command(e, _id() * 2 + 1, "INCR", "n", conn=F.col("user_id"))))
    return r.select("seq", "kind", "str", F.col("int").alias("n"))


@query("""WITH s AS (SELECT *, count(*) FILTER (event_type IN ('signup', 'error')) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events),
  x AS (SELECT event_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS set_at, count(*) FILTER (event_type = 'click') OVER (w ORDER BY event_id) AS n FROM s WINDOW w AS (PARTITION BY user_id, epoch))
  SELECT event_id AS seq, CASE WHEN set_at % 3 < 2 THEN 'error' ELSE 'integer' END AS kind,
    CASE set_at % 3 WHEN 0 THEN 'ERR value is not an integer or out of range' WHEN 1 THEN 'ERR increment or decrement would overflow' END AS str,
    CASE WHEN set_at IS NULL THEN 10 * n WHEN set_at % 3 = 2 THEN 5 + 10 * n END AS n FROM x WHERE event_type = 'click'""")
def kv_command_errors(spark, sf):
    """signup sets text, a number near the largest or 5; error deletes; click adds 10: what is no number or would overflow is an error and leaves the value."""
    s = _events(spark, sf, "signup")
    value = F.when(_id() % 3 == 0, "x1").when(_id() % 3 == 1, "9223372036854775800").otherwise("5")
    c = _all(_command(s, _id(), "SET", F.col("user_id"), value), _command(_events(spark, sf, "error"), _id(), "DEL", F.col("user_id")),
        _command(_events(spark, sf, "click"), _id(), "INCRBY", F.col("user_id"), 10))
    r = interpreter.replay(c)
    return _events(spark, sf, "click").select(_id().alias("seq")).join(r, "seq").select("seq", "kind", "str", F.col("int").alias("n"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS how FROM events WHERE event_type = 'signup')
  SELECT event_id, CASE how WHEN 0 THEN 'ERR invalid expire time in ''set'' command' ELSE 'OK' END AS set_reply, CAST(CASE how WHEN 0 THEN -2 WHEN 1 THEN 100 WHEN 2 THEN 5 ELSE -1 END AS BIGINT) AS ttl,
    CAST(CASE how WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS moved, CAST(CASE how WHEN 0 THEN -2 WHEN 3 THEN -2 ELSE 7 END AS BIGINT) AS ttl_after FROM e""")
def kv_expire_moments(spark, sf):
    """SET with EXAT and PXAT, moments that have passed too, then PEXPIREAT: 7.5 seconds ahead, or the past, which deletes."""
    e = _events(spark, sf, "signup").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    how = _id() % 4
    c = _all(
        _command(e.where(how == 0), _id() * 8, "SET", _key(), "v", "EXAT", F.col("s") - 5), _command(e.where(how == 1), _id() * 8, "SET", _key(), "v", "EXAT", F.col("s") + 100),
        _command(e.where(how == 2), _id() * 8, "SET", _key(), "v", "PXAT", F.col("ms") + 5500), _command(e.where(how == 3), _id() * 8, "SET", _key(), "v"),
        _command(e, _id() * 8 + 1, "TTL", _key()), _command(e, _id() * 8 + 2, "PEXPIREAT", _key(), F.col("ms") + F.when(how == 3, -1).otherwise(7500)), _command(e, _id() * 8 + 3, "TTL", _key()))
    r = interpreter.replay(c).withColumn("event_id", F.floor(F.col("seq") / 8)).withColumn("at", F.col("seq") % 8)
    at = lambda k, c: F.max(F.when(F.col("at") == k, F.col(c)))
    return r.groupBy("event_id").agg(at(0, "str").alias("set_reply"), at(1, "int").alias("ttl"), at(2, "int").alias("moved"), at(3, "int").alias("ttl_after"))


@query("""SELECT event_id, CAST(event_id % 2 AS BIGINT) AS renamenx, CAST(1 AS BIGINT) AS copied, CAST(0 AS BIGINT) AS again, CAST(1 - event_id % 2 AS BIGINT) AS replaced, 'a' || event_id AS got, CAST(-1 AS BIGINT) AS ttl,
  CASE WHEN event_id % 2 = 1 THEN 'ERR no such key' ELSE 'OK' END AS renamed FROM events WHERE event_type = 'purchase'""")
def kv_rename_copy(spark, sf):
    """RENAMENX to a name that is taken by every second event, COPY with and without REPLACE, RENAME of what may be gone."""
    e = _events(spark, sf, "purchase")
    k = lambda x: F.concat(F.lit(x), _id().cast("string"))
    at = {"db": _id() % 8}
    c = _all(
        _command(e, _id() * 10, "SET", k("a"), k("a"), **at), _command(e.where(_id() % 2 == 0), _id() * 10 + 1, "SET", k("b"), k("b"), **at), _command(e, _id() * 10 + 2, "RENAMENX", k("a"), k("b"), **at),
        _command(e, _id() * 10 + 3, "COPY", k("b"), k("c"), **at), _command(e, _id() * 10 + 4, "COPY", k("a"), k("c"), **at), _command(e, _id() * 10 + 5, "COPY", k("a"), k("c"), "REPLACE", **at),
        _command(e, _id() * 10 + 6, "GET", k("c"), **at), _command(e, _id() * 10 + 7, "TTL", k("c"), **at), _command(e, _id() * 10 + 8, "RENAME", k("a"), k("z"), **at))
    r = interpreter.replay(c).withColumn("event_id", F.floor(F.col("seq") / 10)).withColumn("at", F.col("seq") % 10)
    at_ = lambda n, c: F.max(F.when(F.col("at") == n, F.col(c)))
    return r.groupBy("event_id").agg(at_(2, "int").alias("renamenx"), at_(3, "int").alias("copied"), at_(4, "int").alias("again"), at_(5, "int").alias("replaced"),
        at_(6, "bulk").cast("string").alias("got"), at_(7, "int").alias("ttl"), at_(8, "str").alias("renamed"))


@query("""WITH o AS (SELECT event_id, user_id, event_id % 5 AS ch, event_type, lead(event_id) OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS until FROM events WHERE event_type IN ('view', 'error')),
  s AS (SELECT * FROM o WHERE event_type = 'view'), p AS (SELECT event_id, event_id % 5 AS ch FROM events WHERE event_type = 'click')
  SELECT p.event_id AS seq, count(s.event_id) AS receivers FROM p LEFT JOIN s ON s.ch = p.ch AND s.event_id < p.event_id AND (s.until IS NULL OR s.until > p.event_id) GROUP BY p.event_id""")
def kv_subscribe(spark, sf):
    """view subscribes its user to a channel, error unsubscribes it, click publishes: the receivers at that moment."""
    channel = F.concat(F.lit("ch"), (_id() % 5).cast("string"))
    c = _all(*[_command(_events(spark, sf, t), _id(), cmd, channel, *more, conn=F.col("user_id")) for t, cmd, more in (("view", "SUBSCRIBE", ()), ("error", "UNSUBSCRIBE", ()), ("click", "PUBLISH", ("m",)))])
    return _events(spark, sf, "click").select(_id().alias("seq")).join(interpreter.replay(c), "seq").select("seq", F.col("int").alias("receivers"))


_RANGES = """(SELECT node_id, redis_addr, rank * CAST(ceil(16384.0 / n) AS BIGINT) AS lo, CASE WHEN rank = n - 1 THEN 16383 ELSE (rank + 1) * CAST(ceil(16384.0 / n) AS BIGINT) - 1 END AS hi
  FROM (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS rank, count(*) OVER () AS n FROM nodes))"""


@query(f"""WITH k AS (SELECT c_custkey, CAST({crc16_sql("c_name")} % 16384 AS INTEGER) AS a, CAST({crc16_sql("(c_name || 'x')")} % 16384 AS INTEGER) AS b FROM customer),
  m AS (SELECT c_custkey, a, b, CASE WHEN o.node_id <> 2 THEN 'MOVED ' || a || ' ' || o.redis_addr END AS moved FROM k JOIN {_RANGES} o ON k.a BETWEEN o.lo AND o.hi)
  SELECT c_custkey, moved AS get_reply, CASE WHEN a <> b THEN 'CROSSSLOT Keys in request don''t hash to the same slot' ELSE moved END AS mget_reply,
    coalesce(moved, CASE WHEN a <> b THEN 'CROSSSLOT Keys in request don''t hash to the same slot' END, 'OK') AS mset_reply, coalesce(moved, 'OK') AS tagged_reply FROM m""")
def kv_cluster_commands(spark, sf):
    """What node 2 answers to GET, MGET and MSET of customer names: MOVED for other nodes' slots, CROSSSLOT for keys of several slots, and MSET of keys with one hash tag."""
    nodes = table(spark, sf, "nodes")
    node = interpreter.cluster_node(cluster.assign(spark, nodes), nodes, 2)
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("timestamp_ntz").alias("ts"))
    n, x, tag = F.col("c_custkey") * 4, F.concat("c_name", F.lit("x")), lambda p: F.concat(F.lit(p + "{"), "c_name", F.lit("}"))
    r = interpreter.replay(_all(_command(c, n, "GET", F.col("c_name")), _command(c, n + 1, "MGET", F.col("c_name"), x), _command(c, n + 2, "MSET", F.col("c_name"), "v", x, "w"),
        _command(c, n + 3, "MSET", tag("a"), "v", tag("b"), "w")), node=node)
    r = r.withColumn("c_custkey", F.floor(F.col("seq") / 4)).withColumn("at", F.col("seq") % 4)
    at = lambda k: F.max(F.when(F.col("at") == k, F.col("str")))
    return r.groupBy("c_custkey").agg(at(0).alias("get_reply"), at(1).alias("mget_reply"), at(2).alias("mset_reply"), at(3).alias("tagged_reply"))


@query("""SELECT CAST(0 AS BIGINT) AS seq, lpad('2', 40, '0') AS reply UNION ALL
  SELECT 1, 'cluster_enabled:1\r\ncluster_state:ok\r\ncluster_slots_assigned:16384\r\n'""".replace("\\r\\n", "' || chr(13) || chr(10) || '"))
def kv_cluster_myid(spark, sf):
    """CLUSTER MYID of node 2, and the first three lines of its CLUSTER INFO."""
    nodes = table(spark, sf, "nodes")
    node = interpreter.cluster_node(cluster.assign(spark, nodes), nodes, 2)
    one = spark.range(1).select(F.lit(None).cast("timestamp_ntz").alias("ts"))
    r = interpreter.replay(_all(_command(one, F.lit(0), "CLUSTER", "MYID"), _command(one, F.lit(1), "CLUSTER", "INFO")), node=node)
    return r.select("seq", F.regexp_extract(F.col("bulk").cast("string"), r"^((?:[^\r]*\r\n){3}|[0-9a-f]+$)", 1).alias("reply"))
