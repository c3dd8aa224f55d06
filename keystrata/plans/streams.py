"""Queries that run a stream to its end (trigger availableNow) and give what it has written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.functions.keys import key_hex
from keystrata.operators import interpreter
from keystrata.operators.changefeed import VectorTable, changes
from keystrata.operators.state import lww
from keystrata.plans.base import CHANGES, LWW, SNAPSHOT_AT, query
from keystrata.session import materialize, table, work_dir
from keystrata.sources import files
from keystrata.streaming import upsert


def _stream(spark, sf, name, by, ordered=False):
    """A table as a stream of one file a micro-batch, four of them: by the hash of `by`, so that late and repeated rows come in other batches, or `ordered` by it."""
    rows, at = table(spark, sf, name), work_dir(spark, f"stream-{name}")
    if ordered:
        edges = rows.agg(F.percentile_approx(by, [0.25, 0.5, 0.75])).first()[0] or []
        part = sum(((F.col(by) > e).cast("int") for e in edges), F.lit(0))
    else:
        part = F.pmod(F.xxhash64(by), F.lit(4)).cast("int")
    for i in range(4):  # one after another, as a stream takes files by age
        rows.where(part == i).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation, kind FROM ({LWW})")
def kv_stream_latest(spark, sf):
    at = work_dir(spark, "stream-latest")
    rows = upsert.latest(changes(_stream(spark, sf, "kv_log", "entry_id")))
    # each batch writes the keys it has changed; a batch that is run again writes the same
    out = rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/cp").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
    _finish(out)
    return lww(spark.read.parquet(f"{at}/out"), tie=None, keep=()).select("db", key_hex(F.col("key")).alias("key_hex"), "generation", "kind")


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation FROM ({LWW}) WHERE kind = 'PUT'")
def kv_stream_apply(spark, sf):
    at = work_dir(spark, "stream-apply")
    held = VectorTable(spark, f"{at}/table")
    _finish(upsert.apply_to_table(changes(_stream(spark, sf, "kv_log", "entry_id")).select("db", "key", "generation", "kind"), held, f"{at}/cp"))
    return held.read().select("db", key_hex(F.col("key")).alias("key_hex"), "generation")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type FROM events) WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY start, event_type")
def kv_stream_windows(spark, sf):
    """Events by day; days that the watermark (one day behind the last event) has passed."""
    at = work_dir(spark, "stream-windows")
    s = _stream(spark, sf, "events", "event_id", ordered=True).withColumn("ts", F.col("ts").cast("timestamp"))
    _finish(upsert.window_counts(s, "ts", ["event_type"], "1 day", "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{at}/cp").format("parquet").option("path", f"{at}/out"))
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id, event_type || ':' || user_id AS channel FROM events WHERE event_type || ':' || user_id IN ('click:1', 'view:7') OR regexp_full_match(event_type || ':' || user_id, 's.gnup:[0-4].*')")
def kv_stream_route(spark, sf):
    at = work_dir(spark, "stream-route")
    s = _stream(spark, sf, "events", "event_id").select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("channel"))
    _finish(upsert.route_stream(s, ["click:1", "view:7"], ["s?gnup:[0-4]*"]).writeStream.option("checkpointLocation", f"{at}/cp").format("parquet").option("path", f"{at}/out"))
    return spark.read.schema("event_id long, channel string").parquet(f"{at}/out")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), l AS (SELECT user_id, max(event_id) AS g FROM events GROUP BY user_id)
  SELECT e.user_id, e.event_id AS generation, CASE WHEN event_type = 'error' THEN 'deleted' WHEN event_type = 'click' AND ts + INTERVAL 2 HOUR <= mark THEN 'expired' ELSE 'set' END AS event
  FROM l JOIN events e ON e.event_id = l.g, m""")
def kv_stream_expiry(spark, sf):
    """Each user's last event as state under event time: error deletes, click lives for two hours, the others for good. The watermark is a day behind."""
    at, conf = work_dir(spark, "stream-expiry"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    s = _stream(spark, sf, "events", "event_id", ordered=True).select(
        F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_id").alias("generation"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("kind"),
        F.col("event_type").cast("binary").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", 7200).otherwise(0).cast("long").alias("ttl_secs"))
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finish(upsert.with_expiry(s, "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{at}/cp").format("parquet").option("path", f"{at}/out"))
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    out = spark.read.schema("key binary, generation long, value binary, event string").parquet(f"{at}/out")
    last = out.groupBy("key").agg(F.max(F.struct("generation", (F.col("event") == "expired").alias("x"), "event")).alias("m"))
    return last.select(F.col("key").cast("string").cast("long").alias("user_id"), "m.generation", "m.event")


def write_wal(rows, folder: str) -> None:
    """Rows (shard, entry_id, kind, key, value, generation, ttl_secs) as binary log files below a folder that all executors see."""
    files.write_files(files.wal_images(rows), folder)


def _entries(spark, sf):
    """Changes of kv_log as entries of log shards, one for each database and shard."""
    return changes(table(spark, sf, "kv_log")).select(
        (F.col("db") * 100 + F.col("shard")).alias("shard"), "entry_id", "kind", "key", "value", "generation", "ttl_secs", "ts", "arrived_at")


def _replayed(read):
    """Log entries read back, with the database of their shard and what the fold needs."""
    return read.select(F.floor(F.col("shard") / 100).cast("int").alias("db"), F.col("entry_no").alias("entry_id"), "key", "value", "generation", F.when(F.col("entry_type") == 1, "PUT").otherwise("DELETE").alias("kind"))


@query(f"""SELECT db, lower(hex(key)) AS key_hex, generation, lower(hex(value)) AS value_hex FROM (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY generation DESC, entry_id) AS rn
  FROM ({CHANGES})) WHERE rn = 1 AND kind = 'PUT'""")
def kv_wal_replay(spark, sf):
    """kv_log written as binary log files, one for each database and shard, read back by the data source and folded."""
    logs = materialize(files.wal_images(_entries(spark, sf), 1 << 18), "wal")
    s = lww(_replayed(files.wal(logs)), keep=("value",)).where("kind = 'PUT'")
    return s.select("db", key_hex(F.col("key")).alias("key_hex"), "generation", F.lower(F.hex("value")).alias("value_hex"))


@query(f"SELECT db, lower(hex(key)) AS key_hex, generation, lower(hex(value)) AS value_hex FROM ({LWW}) WHERE kind = 'PUT'")
def kv_recover_files(spark, sf):
    """What arrived before a moment as records in the blocks of data files, deleted keys too, the rest as log files; the state from both."""
    cut = F.lit(SNAPSHOT_AT).cast("timestamp_ntz")
    old = F.coalesce(F.col("arrived_at") < cut, F.lit(False))
    log = changes(table(spark, sf, "kv_log"))
    held = lww(log.where(old), keep=("value", "ttl_secs", "ts"))
    held = held.select("db", "key", "value", "generation", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "ttl_secs", (F.col("kind") == "DELETE").alias("deleted"))
    blocks = materialize(files.block_images(held), "blocks")
    logs = materialize(files.wal_images(_entries(spark, sf).where(~old)), "wal")
    # the database is the folder of a data file
    named = blocks.select(F.regexp_replace("path", "^db-([0-9]+)/", "").alias("path"), "content", F.regexp_extract("path", "^db-([0-9]+)/", 1).alias("db"))
    named = named.select(F.concat_ws("/", F.lit("x"), F.concat_ws("@", "db", "path")).alias("path"), "content")
    back = files.records(named).select(F.regexp_extract("file", "^([0-9]+)@", 1).cast("int").alias("db"), F.lit(-1).cast("long").alias("entry_id"), "key", "value", "generation",
        F.when(F.col("deleted"), "DELETE").otherwise("PUT").alias("kind"))
    s = lww(back.unionByName(_replayed(files.wal(logs))), keep=("value",)).where("kind = 'PUT'")
    return s.select("db", key_hex(F.col("key")).alias("key_hex"), "generation", F.lower(F.hex("value")).alias("value_hex"))


@query("""SELECT seq, kind, CASE WHEN kind = 'integer' THEN result END AS n FROM (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'simple' ELSE 'integer' END AS kind,
  CASE WHEN event_type = 'click' THEN count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) ELSE 0 END AS result FROM events WHERE event_type IN ('click', 'view'))""")
def kv_resp_replay(spark, sf):
    """Clicks as INCR and views as EXISTS of a missing key, written as RESP bytes, one file for each user, parsed back and run."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "event_type")
    user = F.col("user_id").cast("string")
    click = F.col("event_type") == "click"
    said = e.select("user_id", F.col("event_id").alias("seq"), F.when(click, "INCR").otherwise("EXISTS").alias("cmd"), F.array(F.when(click, user).otherwise(F.concat(user, F.lit("-none"))).cast("binary")).alias("args"))
    read = files.resp(materialize(files.resp_images(said, "user_id"), "resp").withColumn("path", F.translate("path", "/", "_")))
    read = read.select(F.regexp_extract("file", "^conn-([0-9]+)_", 1).cast("long").alias("conn_id"), "seq", "cmd", "args")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    c = read.join(e.select(F.col("user_id").cast("long").alias("conn_id"), number.cast("long").alias("seq"), "event_id"), ["conn_id", "seq"])
    c = c.select(F.col("event_id").alias("seq"), F.lit(0).alias("db"), "conn_id", "cmd", "args", F.lit(None).cast("timestamp_ntz").alias("ts"))
    return interpreter.replay(c).select("seq", "kind", F.col("int").alias("n"))
