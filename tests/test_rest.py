import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keystrata.operators import cluster, folds, maintenance, pubsub, stats
from keystrata.plans.streams import write_wal
from keystrata.sources import binary
from keystrata.streaming import upsert

T0 = datetime(2025, 1, 1)


def nodes(spark, n, dead=()):
    return spark.createDataFrame([(i, f"n{i}:6379", f"n{i}:7379", "dead" if i in dead else "active", 1) for i in range(n)], "node_id int, redis_addr string, cluster_addr string, status string, generation long")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_every_slot_has_an_owner(spark, n):
    got = cluster.assign(spark, nodes(spark, n), 2).collect()
    assert sorted(r.slot for r in got) == list(range(16_384))
    per = [sum(r.primary == i for r in got) for i in range(n)]
    assert max(per) - min(per) <= n + 1
    assert all(r.primary not in r.replicas and len(r.replicas) == min(1, n - 1) for r in got)
    if n == 3:
        assert all(5_000 <= x <= 5_600 for x in per)


def test_topology_queries(spark):
    s, ns = cluster.assign(spark, nodes(spark, 3)), nodes(spark, 3, dead=[1])
    moved = cluster.rebalance(s, ns).collect()
    assert moved and all(r.new != 1 for r in moved)
    r = sorted((x.first, x.last, x.primary) for x in cluster.ranges(s).collect())
    assert r[0][0] == 0 and r[-1][1] == 16_383 and len(r) == 3
    info = {x.name: x.value for x in cluster.cluster_info(s, ns).collect()}
    assert info["cluster_state"] == "fail" and info["cluster_known_nodes"] == "3"
    keyed = spark.createDataFrame([("foo",), (None,)], "key string")
    got = {x.key: x.moved for x in cluster.route(keyed, F.when(F.col("key") == "foo", F.lit(12_182)), s, nodes(spark, 3), 0).collect()}
    assert got["foo"] == "MOVED 12182 n2:6379"
    assert cluster.assign(spark, nodes(spark, 0)).count() == 0
    lag = spark.createDataFrame([(1, 10, 4, 0), (2, 3, 9, 1), (3, None, None, None)], "node_id int, sent long, acked long, failed long")
    assert {x.node_id: (x.lag, x.diverged) for x in cluster.replica_lag(lag).collect()} == {1: (6, False), 2: (0, True), 3: (0, False)}


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(100.0,)] * 99 + [(50_000.0,), (None,), (0.0,)], "us double").withColumn("op", F.lit("get"))
    h = stats.histogram(df, F.col("us"), ["op"])
    bound = lambda p: stats.percentile_bound(h, ["op"], p, "b").first().b
    assert bound(0.5) <= 128 and bound(0.98) <= 128 and bound(0.999) >= 32_768
    assert stats.histogram(df.where("false"), F.col("us"), ["op"]).count() == 0
    assert stats.hit_ratio(df.where("us IS NULL"), F.lit(True), ["op"]).first().ratio == 1.0


def test_blocks(spark):
    rows = [(0, i, 1 if i < 20 else 9, 10) for i in range(40)] + [(1, 0, None, 10), (1, 1, 0, 0), (1, 2, 5, None)]
    b = spark.createDataFrame(rows, "db int, wblock_id int, live_records long, total_records long")
    u = {(r.db, r.wblock_id): r.utilization for r in maintenance.utilization(b, ["db", "wblock_id"]).collect()}
    assert u[0, 0] == 0.1 and u[1, 0] == 0.0 and u[1, 1] == 1.0 and u[1, 2] == 1.0
    assert maintenance.fragmented(b, ["db", "wblock_id"], at_most=5).count() == 5
    assert maintenance.fragmented(b.where("db = 1"), ["db", "wblock_id"]).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 30])
def test_folds_against_brute_force(spark, monkeypatch, most):
    from keystrata.operators import prefix

    monkeypatch.setattr(prefix, "ROWS", most)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["SET", "DEL", "INCR", "GET"]), rng.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, k string, cmd string, n long").repartition(4)
    held, want, text = {}, {}, {}
    for i, k, c, n in rows:
        held[k] = n if c == "SET" else 0 if c == "DEL" else held.get(k, 0) + (n if c == "INCR" else 0)
        want[i] = held[k]
    reset = F.col("cmd").isin("SET", "DEL")
    got = folds.running_sum(df, ["k"], "seq", reset, F.when(F.col("cmd") == "SET", F.col("n")).otherwise(0), F.when(F.col("cmd") == "INCR", F.col("n")).otherwise(0))
    assert {r.seq: r.result for r in got.collect()} == want
    since, last, at = {}, {}, {}
    for i, k, c, n in rows:
        at[i] = (since.get(k, 0) + 1 if c == "GET" else 0, last.get(k))
        since[k] = at[i][0]
        if c == "SET":
            last[k] = n
        elif c == "DEL":
            last[k] = None
    got = cluster.health(df, "k", "seq", F.col("cmd") == "GET")
    assert {r.seq: r.misses for r in got.collect()} == {i: m for i, (m, _) in at.items()}
    got = folds.last_before(df, ["k"], "seq", F.when(F.col("cmd") == "SET", F.col("n")), reset)
    assert {r.seq: r.before for r in got.collect()} == {i: v for i, (_, v) in at.items()}
    for i, k, c, n in rows:
        if c in ("SET", "DEL"):
            text[k] = [*text.get(k, [""]), ""] if k in text else ["", ""]
        text.setdefault(k, [""])
        if c == "INCR":
            text[k][-1] += str(n)
    got = folds.appended(df, ["k"], "seq", reset, F.when(F.col("cmd") == "INCR", F.col("n").cast("string")))
    assert {(r.k, r.epoch): r.value for r in got.collect() if r.value} == {(k, e): v for k, vs in text.items() for e, v in enumerate(vs) if v}


def test_publish(spark):
    m = spark.createDataFrame([(1, "news.a"), (2, "x"), (3, None), (4, "news.a")], "msg_id long, channel string")
    exact = spark.createDataFrame([(7, "x"), (7, "x"), (8, "news.a"), (9, None)], "subscriber int, channel string")
    pat = spark.createDataFrame([(7, "news.*"), (8, "news.?"), (9, None), (9, "[xy]")], "subscriber int, pattern string")
    got = sorted((r.msg_id, r.subscriber, r.kind) for r in pubsub.publish(m, exact, pat).collect())
    assert got == [(1, 7, "pmessage"), (1, 8, "message"), (1, 8, "pmessage"), (2, 7, "message"), (2, 9, "pmessage"), (4, 7, "pmessage"), (4, 8, "message"), (4, 8, "pmessage")]
    assert {r.msg_id: r.receivers for r in pubsub.receivers(m, exact.where("false"), pat.where("false")).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_log_files_cut_and_damaged(spark, tmp_path):
    rows = [(i % 4, i, "PUT" if i % 5 else "DELETE", f"k{i % 50}".encode(), f"v{i:05d}".encode(), i + 1, i % 3) for i in range(200)]
    write_wal(spark.createDataFrame(rows, "shard int, entry_id long, kind string, key binary, value binary, generation long, ttl_secs long"), str(tmp_path))
    spark.dataSource.register(binary.WalSource)
    read = spark.read.format("keystrata_wal").load(str(tmp_path))
    got = {(r.shard, bytes(r.key), r.generation, r.entry_type, r.value and bytes(r.value)) for r in read.collect()}
    assert got == {(s, k, g, 1 if kind == "PUT" else 2, v if kind == "PUT" else None) for s, _, kind, k, v, g, _ in rows}
    f = sorted(Path(tmp_path).rglob("wal_*.log"))[0]
    raw = f.read_bytes()
    whole = list(binary.wal_entries(raw))
    for cut in (0, 1, 5, 23, 24, 47, len(raw) // 8, len(raw) // 2, len(raw) - 1):
        kept = list(binary.wal_entries(raw[:cut]))
        assert kept == whole[: len(kept)] and len(kept) < len(whole)
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 0x40
    kept = list(binary.wal_entries(bytes(broken), verify=True))
    assert kept == whole[: len(kept)]


def test_records_in_blocks(spark, tmp_path):
    recs = [(f"k{i}".encode(), bytes([i % 256]) * (i * 37 % 700), i + 1, 1_000_000 + i, i % 5, 1 if i % 7 == 0 else 0) for i in range(300)]
    blocks, cur = [], b""
    for r in recs:
        raw = binary.record(*r)
        assert len(raw) % 128 == 0
        if len(cur) + len(raw) > 40_000:
            blocks.append(cur)
            cur = b""
        cur += raw
    blocks.append(cur)
    Path(tmp_path, "data_00000001.sst").write_bytes(bytes(binary.FILE_HEADER) + b"".join(b.ljust(binary.BLOCK, b"\0") for b in blocks))
    spark.dataSource.register(binary.RecordSource)
    got = spark.read.format("keystrata_records").option("blocksPerPartition", 2).load(str(tmp_path)).collect()
    assert {(bytes(r.key), None if r.deleted else bytes(r.value), r.generation, r.ts_us, r.ttl_secs, r.deleted) for r in got} == {(k, None if f else v, g, t, ttl, bool(f)) for k, v, g, t, ttl, f in recs}
    damaged = bytearray(blocks[0])
    damaged[33] ^= 1
    assert len(list(binary.records(bytes(damaged)))) == len(list(binary.records(blocks[0]))) - 1
    m = binary.peer_message(50, 3, 9, b"key", b"value") + binary.peer_message(80, 0, 0)
    assert list(binary.peer_messages(m + m[:7])) == [(50, 3, 9, b"key", b"value"), (80, 0, 0, b"", b"")]


def test_images_over_any_sink(spark, tmp_path):
    from keystrata.sources import files

    entries = [(i % 3 if i % 2 else 0, i, "PUT" if i % 5 else "DELETE", f"k{i}".encode(), bytes([i % 256]) * (i % 90) if i % 5 else None, i + 1, None if i % 7 == 0 else i % 3) for i in range(600)]
    df = spark.createDataFrame(entries, "shard int, entry_id long, kind string, key binary, value binary, generation long, ttl_secs long").repartition(3)
    made = files.wal_images(df, 4_000)
    assert made.count() > 8 and made.groupBy("path").count().where("count > 1").count() == 0
    made.write.parquet(str(tmp_path / "logs"))  # what an object store would hold
    got = files.wal(spark.read.parquet(str(tmp_path / "logs"))).collect()
    assert sorted((r.shard, r.generation, bytes(r.key), r.entry_type, r.value and bytes(r.value)) for r in got) == sorted((s, g, k, 1 if kind == "PUT" else 2, v or None if kind == "DELETE" else v and bytes(v)) for s, _, kind, k, v, g, _ in entries)
    assert files.write_files(made, "file://" + str(tmp_path / "posix")) == made.count()
    assert files.wal(files.images(spark, str(tmp_path / "posix"), "wal_*.log")).count() == 600
    with pytest.raises(ValueError):
        files.write_files(made, "hdfs://name/folder")
    assert files.wal_images(df.where("false")).count() == 0 and files.wal(made.where("false")).count() == 0

    state = [(i % 2, f"k{i}".encode(), None if i % 9 == 0 else bytes([i % 251]) * (i * 97 % 5_000), i, 1_000 + i, 5, i % 9 == 0) for i in range(500)] + [(1, b"long", b"x" * 3_000_000, 9_999, None, None, False), (1, b"after", b"y", 10_000, 1, 0, False)]
    blocks = files.block_images(spark.createDataFrame(state, "db int, key binary, value binary, generation long, ts_us long, ttl_secs long, deleted boolean"), blocks_per_file=2)
    assert all((len(r.content) - binary.FILE_HEADER) % binary.BLOCK == 0 for r in blocks.collect())
    got = files.records(blocks).collect()
    assert {(bytes(r.key), None if r.deleted else bytes(r.value), r.generation, r.deleted) for r in got} == {(k, None if d else v or b"", g, d) for _, k, v, g, _, _, d in state}

    commands = spark.createDataFrame([(c, i, "SET", [f"k{i}".encode(), b"\r\n"]) for c in (1, 2) for i in range(50)] + [(3, 0, None, None)], "conn_id long, seq long, cmd string, args array<binary>")
    sent = files.resp_images(commands, file_bytes=600)
    assert sent.count() > 6
    files.write_files(sent, str(tmp_path / "resp"))
    stream = files.resp(files.images(spark, str(tmp_path / "resp"), "*.resp", stream=True))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("cmd = 'SET'").count() == 100 and {bytes(r.args[0]) for r in got.where("cmd = 'SET'").collect()} == {f"k{i}".encode() for i in range(50)}
    raw = binary.peer_message(50, 3, 9, b"key", b"value") + binary.peer_message(80, 0, 0)
    peers = files.peer(spark.createDataFrame([("a", raw + raw[:5]), ("b", b""), ("c", None)], "path string, content binary")).collect()
    assert [(r.op, r.shard_id, r.ttl_secs, bytes(r.key), bytes(r.value)) for r in peers] == [(50, 3, 9, b"key", b"value"), (80, 0, 0, b"", b"")]


def test_lz4_block():
    literal = b"\x0b\x00\x00\x00" + bytes([0x31]) + b"abc" + b"\x03\x00" + bytes([0x30]) + b"xyz"
    assert binary.lz4_block(literal) == b"abc" + b"abcab" + b"xyz"
    with pytest.raises(ValueError):
        binary.lz4_block(b"\x05\x00\x00\x00" + bytes([0x10]) + b"a\x09\x00")


def test_stream_with_expiry(spark, tmp_path):
    rows = [("a", 1, "PUT", b"1", T0, 60), ("b", 1, "PUT", b"2", T0, 0), ("a", 3, "PUT", b"3", T0 + timedelta(seconds=10), 60), ("a", 2, "PUT", b"late", T0 + timedelta(seconds=11), 5), ("b", 2, "DELETE", None, T0 + timedelta(seconds=20), 0)]
    schema = "key string, generation long, kind string, value binary, ts timestamp, ttl_secs long"
    for i, part in enumerate((rows, [("z", 1, "PUT", b"z", T0 + timedelta(hours=1), 0)], [("z", 2, "PUT", b"z", T0 + timedelta(hours=2), 0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
        src = next((tmp_path / f"in{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(src, tmp_path / "in" / f"{i}.parquet")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = s.withColumn("key", F.col("key").cast("binary"))
    q = upsert.with_expiry(s, "1 minute").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("expiring").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(bytes(r.key).decode(), r.generation, r.event) for r in spark.table("expiring").collect()}
    assert {("a", 3, "set"), ("b", 2, "deleted"), ("a", 3, "expired")} <= got
    assert ("b", 2, "expired") not in got


def test_catalogue_and_missing_subpackage():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['keystrata.llm'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'kv_lww_state' in q and 'p1_found' not in q and set(s) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 60


def test_resp_files_and_reply_bytes(spark, tmp_path):
    from keystrata.operators.interpreter import replay
    from keystrata.sources.commands import RespSource, reply_bytes
    from keystrata.sources.resp import dump, load

    cmds = [[b"SET", b"k", b"v\r\n"], [b"APPEND", b"k", b"\x00w"], [b"MGET", b"k", b"x"], [b"NOPE"]]
    (tmp_path / "a.resp").write_bytes(b"".join(map(dump, cmds)) + b"*2\r\n$3\r\nGE")
    (tmp_path / "b.resp").write_bytes(dump([b"PING"]) + b"$x\r\n")
    (tmp_path / "c.resp").write_bytes(b"")
    spark.dataSource.register(RespSource)
    rows = spark.read.format("keystrata_resp").load(str(tmp_path)).collect()
    a = [r for r in rows if r.file == "a.resp"]
    assert [(r.cmd, [bytes(x) for x in r.args]) for r in a] == [(c[0].decode(), c[1:]) for c in cmds]
    assert [r.error is None for r in rows if r.file == "b.resp"] == [True, False]
    table = spark.createDataFrame([(r.seq, 0, 1, r.cmd, r.args, None) for r in a], "seq long, db int, conn_id long, cmd string, args array<binary>, ts timestamp_ntz")
    got = [load(bytes(r.raw))[0] for r in reply_bytes(replay(table)).sort("seq").collect()]
    assert got[0] == "OK" and got[1] == 5 and got[2] == [b"v\r\n\x00w", None] and "Unknown command" in got[3]


def test_files_without_live_records(spark):
    b = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (0, 2, 0), (0, 2, 3), (0, 3, None)], "db int, file_id int, live_records long")
    assert [r.file_id for r in maintenance.unlinkable(b, ["db", "file_id"]).collect()] == [1]
    s = spark.createDataFrame([(0, f"k{i}".encode(), i) for i in range(90)], "db int, key binary, generation long")
    assert maintenance.candidates(s, F.col("generation") % 3, 5).count() == 15
    assert maintenance.candidates(s, F.col("generation") % 3, 1).count() == 3
