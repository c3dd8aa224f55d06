"""Queries on ordered mutations: the event log read as commands, conditional writes, counters, appends, transactions, messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.operators import folds, interpreter, prefix, pubsub
from keystrata.plans.base import query
from keystrata.session import table

# An event is a command on the key user_id: signup SET floor(value), error DEL, click INCRBY floor(value), view GET, purchase APPEND.
_KEY = ["user_id"]


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _is(*types):
    return F.col("event_type").isin(*types)



@query("""SELECT v.event_id, v.user_id, CASE WHEN s.event_type = 'signup' THEN s.value END AS value FROM (SELECT * FROM events WHERE event_type = 'view') v
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('signup', 'error')) s ON v.user_id = s.user_id AND v.event_id > s.event_id""")
def kv_get_replay(spark, sf):
    """GET as of its place in the log: the value of the key's last SET, null after a DEL or before any."""
    e = folds.last_before(_events(spark, sf), _KEY, "event_id", F.when(_is("signup"), F.col("value")), _is("signup", "error"))
    return e.where(_is("view")).select("event_id", "user_id", F.col("before").alias("value"))


_EPOCH = "count(*) FILTER (event_type IN ('signup', 'error')) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch"


def _counter_sql(delta, start="CAST(floor(value) AS BIGINT)", cast="BIGINT"):
    return f"""SELECT event_id, user_id, CAST(sum(CASE event_type WHEN 'signup' THEN {start} WHEN 'error' THEN 0 WHEN 'click' THEN {delta} ELSE 0 END)
      OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS {cast}) AS result FROM (SELECT *, {_EPOCH} FROM events)"""


def _counter(spark, sf, delta):
    e = _events(spark, sf)
    start = F.when(_is("signup"), F.floor("value")).otherwise(F.lit(0)).cast("long")
    return folds.running_sum(e, _KEY, "event_id", _is("signup", "error"), start, F.when(_is("click"), delta).otherwise(F.lit(0)).cast("long")).select("event_id", "user_id", "result")


@query(_counter_sql("1"))
def kv_incr_fold(spark, sf):
    return _counter(spark, sf, F.lit(1))


@query(_counter_sql("CAST(floor(value) AS BIGINT)"))
def kv_incrby(spark, sf):
    return _counter(spark, sf, F.floor("value"))


@query(_counter_sql("-CAST(floor(value) AS BIGINT)"))
def kv_decrby(spark, sf):
    return _counter(spark, sf, -F.floor("value"))


@query(f"""SELECT event_id, user_id, CAST(sum(CASE event_type WHEN 'signup' THEN CAST(round(value * 100) AS BIGINT) WHEN 'click' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END)
      OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS BIGINT) / 100.0::DOUBLE AS result FROM (SELECT *, {_EPOCH} FROM events)""")
def kv_incrbyfloat(spark, sf):
    """INCRBYFLOAT on cents, so that the sum does not depend on the engine's order of additions."""
    e = _events(spark, sf)
    cents = F.round(F.col("value") * 100).cast("long")
    out = folds.running_sum(e, _KEY, "event_id", _is("signup", "error"), F.when(_is("signup"), cents).otherwise(F.lit(0)), F.when(_is("click"), cents).otherwise(F.lit(0)))
    return out.select("event_id", "user_id", (F.col("result") / 100.0).alias("result"))


@query("""SELECT user_id, epoch, string_agg(part, '' ORDER BY event_id) AS value, CAST(strlen(string_agg(part, '' ORDER BY event_id)) AS INTEGER) AS length FROM (
  SELECT *, count(*) FILTER (event_type IN ('signup', 'error')) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
    CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ';' ELSE '' END AS part FROM events) GROUP BY user_id, epoch""")
def kv_append_fold(spark, sf):
    part = F.when(_is("signup", "purchase"), F.concat(F.floor("value").cast("long").cast("string"), F.lit(";"))).otherwise(F.lit(""))
    return folds.appended(_events(spark, sf), _KEY, "event_id", _is("signup", "error"), part).select("user_id", "epoch", "value", "length")


@query(_counter_sql("CAST(floor(value) AS BIGINT)"))
def kv_exact_fold(spark, sf):
    """The counter again, by the exact ordered fold that also knows errors and overflow."""
    cmd = F.when(_is("signup"), "SET").when(_is("error"), "DEL").when(_is("click"), "INCRBY").otherwise("GET")
    arg = F.when(_is("signup", "click"), F.floor("value").cast("long").cast("string"))
    e = _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), cmd.alias("cmd"), arg.alias("arg"))
    f = folds.exact_fold(e)
    return f.select(F.col("seq").alias("event_id"), F.col("key").cast("string").cast("long").alias("user_id"), F.coalesce(F.col("value").cast("string").cast("long"), F.lit(0)).cast("long").alias("result"))


# Conditional writes: signup is SET NX (or XX), error DEL. A key exists from its first SET after the last DEL on.
_LAST = "last(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, user_id, CAST(CASE WHEN p IS NULL OR p = 'error' THEN 1 ELSE 0 END AS INTEGER) AS reply FROM (SELECT *, {_LAST} AS p FROM events WHERE event_type IN ('signup', 'error')) WHERE event_type = 'signup'")
def kv_setnx(spark, sf):
    e = _events(spark, sf).where(_is("signup", "error"))
    e = folds.last_before(e, _KEY, "event_id", F.col("event_type"), F.lit(True))
    return e.where(_is("signup")).select("event_id", "user_id", F.when(F.col("before").isNull() | (F.col("before") == "error"), 1).otherwise(0).alias("reply"))


@query(f"""SELECT event_id, user_id, CAST(CASE WHEN p IS NOT NULL AND p <> 'error' THEN 1 ELSE 0 END AS INTEGER) AS written FROM (
  SELECT *, {_LAST} AS p FROM events WHERE event_type IN ('click', 'purchase', 'error')) WHERE event_type = 'purchase'""")
def kv_set_xx(spark, sf):
    """click SET, purchase SET XX: an XX that is refused changes nothing, one that is done leaves the key there; so the last row decides
    but for refused ones, which follow a DEL or nothing and so does what follows them.
    """
    e = _events(spark, sf).where(_is("click", "purchase", "error"))
    e = prefix.last_value(e, _KEY, "event_id", F.col("event_type"), F.lit(True), "p")
    return e.where(_is("purchase")).select("event_id", "user_id", F.when(F.col("p").isNotNull() & (F.col("p") != "error"), 1).otherwise(0).alias("written"))


@query("""SELECT event_id, user_id, lag(CASE WHEN event_type = 'signup' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS old, event_type = 'signup' AS is_set
  FROM events WHERE event_type IN ('signup', 'error')""")
def kv_set_get(spark, sf):
    """SET … GET and GETDEL: the value before each SET (signup) and DEL (error)."""
    e = _events(spark, sf).where(_is("signup", "error"))
    e = folds.last_before(e, _KEY, "event_id", F.when(_is("signup"), F.col("value")), F.lit(True))
    return e.select("event_id", "user_id", F.col("before").alias("old"), _is("signup").alias("is_set"))


@query("""SELECT event_id, user_id, ttl, ts + to_seconds(ttl) AS expires_at FROM (SELECT *, CAST(coalesce(last(CASE event_type WHEN 'signup' THEN floor(value)::BIGINT WHEN 'error' THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS ttl FROM events) WHERE event_type = 'click' AND ttl > 0""")
def kv_keepttl(spark, sf):
    """click SET … KEEPTTL: the lifetime in seconds of the last signup SET EX floor(value) stays, its clock starts again."""
    own = F.when(_is("signup"), F.floor("value").cast("long")).otherwise(F.lit(0).cast("long"))
    e = prefix.last_value(_events(spark, sf), _KEY, "event_id", own, _is("signup", "error"), "ttl", before=False)
    e = e.withColumn("ttl", F.coalesce("ttl", F.lit(0).cast("long")))
    e = e.where(_is("click") & (F.col("ttl") > 0))
    from keystrata.operators.state import expires_at

    return e.select("event_id", "user_id", "ttl", expires_at(F.col("ts"), F.col("ttl")).alias("expires_at"))


@query("""SELECT event_id, CAST(greatest(floor(value * 10), 1) AS BIGINT) AS ex, CAST(greatest(CAST(floor(value * 10000) AS BIGINT) // 1000, 1) AS BIGINT) AS px,
  ts + to_seconds(CAST(greatest(floor(value * 10), 1) AS BIGINT)) AS expires_at FROM events WHERE event_type = 'signup' AND value > 0""")
def kv_setex(spark, sf):
    """SET EX, SETEX and PX, PSETEX: lifetimes in whole seconds, at least one."""
    from keystrata.operators.state import expires_at

    e = _events(spark, sf).where(_is("signup") & (F.col("value") > 0))
    ex = F.greatest(F.floor(F.col("value") * 10), F.lit(1)).cast("long")
    px = F.greatest(F.floor(F.floor(F.col("value") * 10000) / 1000), F.lit(1)).cast("long")
    return e.select("event_id", ex.alias("ex"), px.alias("px"), expires_at(F.col("ts"), ex).alias("expires_at"))




@query("""SELECT event_id, user_id, value, CAST(CASE WHEN event_id % 2 = 0 THEN 60 ELSE 0 END AS BIGINT) AS new_ttl FROM (SELECT v.event_id, v.user_id, CASE WHEN s.event_type = 'signup' THEN s.value END AS value
  FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('signup', 'error')) s ON v.user_id = s.user_id AND v.event_id > s.event_id) WHERE value IS NOT NULL""")
def kv_getex(spark, sf):
    """GETEX: the value read and the lifetime it gets; even event ids ask for EX 60, odd ones for PERSIST; missing keys write nothing."""
    g = kv_get_replay(spark, sf).where("value IS NOT NULL")
    return g.select("event_id", "user_id", "value", F.when(F.col("event_id") % 2 == 0, 60).otherwise(0).cast("long").alias("new_ttl"))


# A user's day is a transaction: WATCH at its first event, EXEC at its last; a signup or error strictly between is a conflict.
@query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS watch_id, max(event_id) AS exec_id, count(*) AS n FROM events GROUP BY ALL)
  SELECT t.user_id, t.watch_id, t.exec_id, count(c.event_id) AS conflicts, count(c.event_id) = 0 AS committed, CAST(CASE WHEN count(c.event_id) = 0 THEN any_value(t.n) END AS BIGINT) AS replies FROM t
  LEFT JOIN events c ON c.user_id = t.user_id AND c.event_id > t.watch_id AND c.event_id < t.exec_id AND c.event_type IN ('signup', 'error') GROUP BY ALL""")
def kv_watch_exec(spark, sf):
    e = _events(spark, sf).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "day")
    inside = _is("signup", "error") & (F.col("event_id") > F.min("event_id").over(w)) & (F.col("event_id") < F.max("event_id").over(w))
    t = e.withColumn("hit", inside).groupBy("user_id", "day").agg(F.min("event_id").alias("watch_id"), F.max("event_id").alias("exec_id"), F.count("*").alias("n"), F.count_if("hit").alias("conflicts"))
    return t.select("user_id", "watch_id", "exec_id", "conflicts", (F.col("conflicts") == 0).alias("committed"), F.when(F.col("conflicts") == 0, F.col("n")).alias("replies"))


@query("""SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'simple' WHEN 'error' THEN 'integer' WHEN 'click' THEN 'integer' ELSE 'bulk' END AS kind, CASE WHEN event_type = 'click' THEN result END AS counter
  FROM (""" + _counter_sql("CAST(floor(value) AS BIGINT)") + ") JOIN (SELECT event_id, event_type FROM events) USING (event_id)")
def kv_replay(spark, sf):
    """The event log as commands through the interpreter: each key is its own stream, as every command has one key."""
    cmd = F.when(_is("signup"), "SET").when(_is("error"), "DEL").when(_is("click"), "INCRBY").otherwise("GET")
    number = F.floor("value").cast("long").cast("string").cast("binary")
    args = F.when(_is("signup", "click"), F.array(F.col("user_id").cast("string").cast("binary"), number)).otherwise(F.array(F.col("user_id").cast("string").cast("binary")))
    c = _events(spark, sf).select(F.col("event_id").alias("seq"), F.lit(0).alias("db"), F.col("user_id").alias("conn_id"), cmd.alias("cmd"), args.alias("args"), "ts")
    r = interpreter.replay(c)
    typed = c.select("seq", "cmd").join(r, "seq")
    return typed.select("seq", "kind", F.when(F.col("cmd") == "INCRBY", F.col("int")).alias("counter"))


@query("""SELECT event_id, user_id, CAST(misses AS BIGINT) AS misses, CASE WHEN misses >= 2 THEN 'dead' WHEN misses >= 1 THEN 'suspect' ELSE 'active' END AS health FROM (
  SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY event_id) AS misses FROM (
    SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events))""")
def kv_health_streak(spark, sf):
    from keystrata.operators.cluster import health

    return health(_events(spark, sf), "user_id", "event_id", _is("error"), suspect=1, dead=2).select("event_id", "user_id", "misses", "health")


_EXACT = [(1, "click:1"), (2, "click:1"), (3, "view:7"), (3, "signup:9"), (3, "view:7"), (4, None)]
_PATTERNS = [(1, "click:1*"), (2, "v?ew:[0-4]*"), (5, "*:7"), (6, "[^a-p]*:2"), (7, None), (5, "*:7")]
_DELIVERED = """WITH m AS (SELECT event_id AS msg_id, event_type || ':' || user_id AS channel FROM events),
  p(subscriber, pattern, rx) AS (VALUES (1, 'click:1*', 'click:1.*'), (2, 'v?ew:[0-4]*', 'v.ew:[0-4].*'), (5, '*:7', '.*:7'), (6, '[^a-p]*:2', '[^a-p].*:2')),
  x(subscriber, channel) AS (VALUES (1, 'click:1'), (2, 'click:1'), (3, 'view:7'), (3, 'signup:9'))
  SELECT msg_id, m.channel, subscriber, 'message' AS kind, NULL::VARCHAR AS pattern FROM m JOIN x USING (channel)
  UNION ALL SELECT msg_id, channel, subscriber, 'pmessage', pattern FROM m JOIN p ON regexp_full_match(channel, rx)"""


def _messages(spark, sf):
    m = _events(spark, sf).select(F.col("event_id").alias("msg_id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("channel"))
    return m, spark.createDataFrame(_EXACT, "subscriber int, channel string"), spark.createDataFrame(_PATTERNS, "subscriber int, pattern string")


@query(_DELIVERED)
def kv_publish(spark, sf):
    return pubsub.publish(*_messages(spark, sf))


@query(f"WITH d AS ({_DELIVERED}) SELECT e.event_id AS msg_id, e.event_type || ':' || e.user_id AS channel, count(d.msg_id) AS receivers FROM events e LEFT JOIN d ON d.msg_id = e.event_id GROUP BY ALL")
def kv_publish_receivers(spark, sf):
    return pubsub.receivers(*_messages(spark, sf))
