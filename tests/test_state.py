import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import bloom, changefeed, incremental, maintenance, reads, versions
from keystrata.operators import state as st

LOG = "entry_id long, db int, key binary, op string, entry_type int, value binary, ttl_secs long, ts timestamp_ntz, generation long"
T0 = datetime(2025, 1, 1)


def random_log(rng, n=600):
    rows = []
    for i in range(n):
        g = rng.choice([rng.randint(1, 400), None] if rng.random() < 0.1 else [rng.randint(1, 400)])
        key = rng.choice([b"hot", None, b"", b"\xff\x00"] + [f"k{rng.randint(0, 60)}".encode()] * 6)
        kind = rng.choice(["PUT", "PUT", "PUT", "DELETE"]) if g is None else ["PUT", "PUT", "DELETE"][(g * 7 + hash(key) % 3) % 3]
        op, et = rng.choice([(kind, 1), (f" {kind.lower()} ", None), (None, 1 if kind == "PUT" else 2)])
        if rng.random() < 0.05:
            op, et = rng.choice([("NOOP", 0), (None, None), (None, 7), ("", 1)])
        rows.append((i, rng.choice([0, 1, None]), key, op, et, f"v{g}".encode(), rng.choice([0, 5, 50, None]), T0 + timedelta(seconds=rng.randint(0, 60)) if rng.random() > 0.1 else None, g))
    return rows + rows[::9]


def brute(rows):
    best = {}
    for i, db, key, op, et, value, ttl, ts, g in rows:
        kind = op.strip().upper() if op is not None else {1: "PUT", 2: "DELETE"}.get(et)
        if key is None or g is None or kind not in ("PUT", "DELETE"):
            continue
        if (db, key) not in best or (g, -i) > best[db, key][0]:
            best[db, key] = ((g, -i), kind, value, ttl, ts)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_against_brute_force(spark, seed):
    rows = random_log(random.Random(seed))
    df = st.changes(spark.createDataFrame(rows, LOG))
    want = brute(rows)
    got = {(r.db, bytes(r.key)): (r.generation, r.kind) for r in st.lww(df).collect()}
    assert got == {k: (v[0][0], v[1]) for k, v in want.items()}
    as_of = T0 + timedelta(seconds=40)
    alive = {k for k, (_, kind, _, ttl, ts) in want.items() if kind == "PUT" and not (ttl and ts and ts + timedelta(seconds=ttl) <= as_of)}
    assert {(r.db, bytes(r.key)) for r in st.live(df, st.as_time(str(as_of))).collect()} == alive
    cut = df.where("entry_id < 300").unionByName(df.where("entry_id >= 300").orderBy(F.rand(1)))
    snap = st.lww(cut.where("entry_id < 300")).withColumn("entry_id", F.lit(-1).cast("long"))
    assert {(r.db, bytes(r.key)) for r in st.recover(snap, cut.where("entry_id >= 300")).collect()} == {k for k, v in want.items() if v[1] == "PUT"}


def test_empty_state(spark):
    e = st.changes(spark.createDataFrame([], LOG))
    assert st.live(e).count() == 0 and st.index_stats(e).count() == 0


def test_hundred_keys_half_deleted(spark):
    rows = [(i, 0, f"k{i}".encode(), "PUT", 1, b"v", 0, T0, i + 1) for i in range(100)] + [(200 + i, 0, f"k{i}".encode(), "DELETE", 2, None, 0, T0, 200 + i) for i in range(50)]
    r = st.index_stats(st.changes(spark.createDataFrame(rows, LOG))).first()
    assert (r.live, r.tombstones) == (50, 50)


def test_flush_and_trim(spark):
    log = st.changes(spark.createDataFrame([(i, i % 2, b"k", "PUT", 1, b"", 0, T0, i) for i in range(10)], LOG))
    marks = spark.createDataFrame([(0, 6), (None, 3)], "db int, upto_generation long")
    assert sorted(r.generation for r in st.flush(log, marks).collect()) == [5, 7, 8, 9]
    assert st.flush(log, marks.where("false")).count() == 10
    assert sorted(r.generation for r in st.trim(log, spark.createDataFrame([(0, 4)], "db int, durable_generation long")).collect()) == [1, 3, 5, 6, 7, 8, 9]


def path(tmp_path, name):
    return f"file://{tmp_path}/{name}"


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("large", [5_000_000, 0])
def test_delete_vectors_against_brute_force(spark, tmp_path, seed, large, monkeypatch):
    monkeypatch.setattr(bloom, "LARGE", large)
    monkeypatch.setattr(bloom, "FEW", 200_000 if seed % 2 else 20)
    rng = random.Random(seed)
    rows = random_log(rng)
    want = {k: v[0][0] for k, v in brute(rows).items() if v[1] == "PUT"}
    table = changefeed.VectorTable(spark, path(tmp_path, "t"), T.StructType([T.StructField("value", T.BinaryType())]))
    assert table.read().count() == 0
    rng.shuffle(rows)
    for lo in range(0, len(rows), 250):
        table.apply(changefeed.changes(spark.createDataFrame(rows[lo : lo + 250], LOG)).withColumn("clash", F.lit(1)))
    state = lambda v=None: {(r.db, bytes(r.key)): r.generation for r in table.read(v).collect()}
    assert state() == want and all(bytes(r.value) == f"v{r.generation}".encode() for r in table.read().collect())
    assert table.vectors().count() > 0
    last = table.versions.number()
    table.apply(changefeed.changes(spark.createDataFrame(rows, LOG)))  # all of it again
    assert state() == want
    table.apply(spark.createDataFrame([], "db int, key binary, generation long, kind string, value binary"))
    table.compact()
    assert state() == want and table.vectors().count() == 0
    gone = table.vacuum(keep=100)
    assert gone and all(n.startswith(("won-", "batch-")) for n in gone) and table.vacuum(keep=100) == []
    table.apply(changefeed.changes(spark.createDataFrame(rows[:100], LOG)))  # late rows after a rewrite
    assert state() == want and state(last) == want
    assert any(n.startswith("data-") for n in table.vacuum()) and state() == want


def test_late_put_does_not_revive(spark, tmp_path):
    t = changefeed.VectorTable(spark, path(tmp_path, "t"))
    put = lambda g, kind: t.apply(spark.createDataFrame([(0, b"k", g, kind)], "db int, key binary, generation long, kind string"))
    put(5, "PUT"), put(9, "DELETE"), put(7, "PUT")
    assert t.read().count() == 0
    put(10, "PUT")
    assert [r.generation for r in t.read().collect()] == [10]


def test_failed_apply_leaves_the_table(spark, tmp_path):
    t = changefeed.VectorTable(spark, path(tmp_path, "t"))
    row = lambda g: spark.createDataFrame([(0, b"k", g, "PUT")], "db int, key binary, generation long, kind string")
    t.apply(row(1))

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.apply(row(2), before_commit=fail)
    assert [r.generation for r in t.read().collect()] == [1]
    t.apply(row(2))
    assert [r.generation for r in t.read().collect()] == [2]


def test_versions_conflict(spark, tmp_path):
    v = versions.Versions(spark, path(tmp_path, "v"))
    assert v.number() == 0 and v.load() == {}
    v.commit(1, {"a": 1})
    with pytest.raises(versions.VersionConflict):
        v.commit(1, {"a": 2})
    assert v.load() == {"a": 1} and v.number() == 1


@pytest.mark.parametrize("history,large,few", [(True, 5_000_000, 200_000), (False, 5_000_000, 200_000), (True, 0, 2), (False, 0, 2), (False, 0, 200_000)])
def test_runs_take_each_change_once(spark, tmp_path, history, large, few, monkeypatch):
    monkeypatch.setattr(bloom, "LARGE", large)
    monkeypatch.setattr(bloom, "FEW", few)
    rng = random.Random(5)
    state = incremental.IncrementalState(spark, path(tmp_path, "s"), history=history)
    seen, last, taken = set(), {}, []
    for n in range(4):
        rows = [(i, rng.choice([None, "", "a", "b", "c"]), rng.choice([None, "x", "y"])) for i in range(n * 100, n * 100 + 30)]
        df = spark.createDataFrame([(*r, b"clash") for r in rows], "seq long, k string, v string, key_hash binary")
        if n == 2:
            with pytest.raises(ZeroDivisionError):
                state.run(df, incremental.row_hash(F.col("k")), incremental.row_hash(F.col("v")), [F.col("seq")], before_commit=lambda: 1 / 0)
        got = sorted(r.seq for r in state.run(df, incremental.row_hash(F.col("k")), incremental.row_hash(F.col("v")), [F.col("seq")]).collect())
        want = []
        if history:
            for i, k, v in rows:
                if (k, v) not in seen:
                    seen.add((k, v))
                    want.append(i)
        else:
            newest = {k: (i, v) for i, k, v in rows}
            want = [i for k, (i, v) in newest.items() if k not in last or last[k] != v]
            last |= {k: v for k, (_, v) in newest.items()}
        assert got == sorted(want)
        taken += got
    assert sorted(r.seq for r in state.rows().collect()) == sorted(taken)
    state.compact()
    assert len(state.segments()) == 1 and sorted(r.seq for r in state.rows().collect()) == sorted(taken)
    assert len(state.vacuum()) == 5 and state.vacuum() == []  # four runs' segments and that of the failed one
    empty = spark.createDataFrame([], "seq long, k string, v string")
    assert state.run(empty, incremental.row_hash(F.col("k")), incremental.row_hash(F.col("v")), [F.col("seq")]).count() == 0


def test_reading_runs_against_brute_force(spark):
    rng = random.Random(6)
    t = lambda: T0 + timedelta(seconds=rng.randint(0, 500))
    runs = [(i, rng.choice([0, 1, 2, None]), rng.choice([t(), None])) for i in range(60)]
    runs += [(100, *runs[0][1:]), (99, *runs[0][1:])]
    rows = [(i, rng.choice([0, 1, 3, None]), rng.choice([t(), t(), None])) for i in range(400)]
    want = {}
    for i, s, at in rows:
        fit = [(u, r) for r, rs, u in runs if rs is not None and rs == s and u is not None and at is not None and u >= at]
        if fit:
            want[i] = min(fit)[1]
    r, d = spark.createDataFrame(runs, "run_id long, shard int, upto timestamp_ntz"), spark.createDataFrame(rows, "i long, s int, at timestamp_ntz")
    for most in (0, 10_000):
        got = incremental.read_by_runs(d, F.col("s"), F.col("at"), r, broadcast_rows=most)
        assert {x.i: x.run_id for x in got.collect()} == want
    assert incremental.read_by_runs(d, F.col("s"), F.col("at"), r.where("false")).count() == 0


@pytest.mark.parametrize("policy", maintenance.POLICIES)
def test_eviction(spark, policy):
    rng = random.Random(7)
    rows = [(db, f"k{i}".encode(), rng.randint(1, 300), T0 + timedelta(seconds=rng.randint(0, 40)) if rng.random() < 0.6 else None) for db in (0, 1) for i in range(300 if db else 20)]
    df = spark.createDataFrame(rows, "db int, key binary, generation long, expires_at timestamp_ntz")
    got = {(r.db, bytes(r.key)) for r in maintenance.evict(df, policy, 50).collect()}
    may = [r for r in rows if r[0] == 1 and (policy.startswith("allkeys") or (policy.startswith("volatile") and r[3]))]
    assert len(got) == (0 if policy == "noeviction" else min(250, len(may))) and all(db == 1 for db, _ in got)
    order = {"allkeys-lru": lambda r: (r[2], r[1]), "volatile-lru": lambda r: (r[2], r[1]), "volatile-ttl": lambda r: (r[3], r[2], r[1])}.get(policy)
    if order:
        assert got == {(r[0], r[1]) for r in sorted(may, key=order)[:250]}
    assert maintenance.evict(df.where("false"), policy, 5).count() == 0
    size = F.octet_length("key") * 100
    got = {(r.db, bytes(r.key)) for r in maintenance.evict(df, policy, max_bytes=60_000, size=size).collect()}
    if order:
        held, want = sum(len(r[1]) * 100 for r in rows if r[0] == 1), set()
        for r in sorted(may, key=order):
            if held > 60_000:
                want.add((r[0], r[1]))
                held -= len(r[1]) * 100
        assert got == want
        both = {(r.db, bytes(r.key)) for r in maintenance.evict(df, policy, 50, max_bytes=100_000, size=size).collect()}
        assert both == {(r[0], r[1]) for r in sorted(may, key=order)[:250]}


def test_capacity_against_brute_force(spark):
    rng = random.Random(5)
    # db 0: "c" is refused twice, and taken once a delete has freed a slot; the last row repeats a change
    rows = [(0, b"a", 1, "PUT"), (0, b"b", 2, "PUT"), (0, b"c", 3, "PUT"), (0, b"a", 4, "PUT"), (0, b"c", 5, "PUT"), (0, b"b", 6, "DELETE"), (0, b"c", 7, "PUT"), (0, b"b", 8, "PUT"), (0, b"c", 5, "PUT")]
    rows += [(1, bytes([rng.randrange(6)]), g, "PUT" if rng.random() < 0.7 else "DELETE") for g in range(400)] + [(None, b"x", 1, "PUT")]
    held, want = {}, {}
    for db, key, g, kind in sorted(set(rows), key=lambda r: (str(r[0]), r[2])):
        h = held.setdefault(db, set())
        if kind == "DELETE":
            h.discard(key)
            continue
        want[db, g] = key not in h and len(h) >= 2
        if not want[db, g]:
            h.add(key)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entry_id long, db int, key binary, generation long, kind string").repartition(5)
    got = maintenance.over_capacity(df, 2).collect()
    assert len(got) == len(want) and {(r.db, r.generation): r.oom for r in got} == want
    assert [g for (db, g), oom in want.items() if db == 0 and oom] == [3, 5, 8]


def test_capacity_in_bytes(spark):
    rows = [(0, 0, b"a", 1, "PUT", 5), (1, 0, b"b", 2, "PUT", 3), (2, 0, b"b", 3, "PUT", 4), (3, 0, b"a", 4, "PUT", 4), (4, 0, b"b", 5, "PUT", 4), (5, 0, b"a", 6, "DELETE", 0), (6, 0, b"c", 7, "PUT", 4), (7, 0, b"d", 8, "PUT", 0)]
    df = spark.createDataFrame(rows, "entry_id long, db int, key binary, generation long, kind string, value_bytes long")
    got = {r.generation: r.oom for r in maintenance.over_capacity(df, None, max_bytes=10).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 7: False, 8: True}  # 6, 10, 11, 9, 10, 5 after the delete, 10, 11


def test_bloom_filters(spark):
    keys = spark.createDataFrame([(d, f"k{i}".encode()) for d in (0, 1, None) for i in range(400)], "db int, key binary")
    f = bloom.build(keys, ["db", "key"], 1 << 16)
    assert bloom.passing(keys, ["db", "key"], f, 1 << 16).count() == 1_200
    others = spark.range(20_000).select(F.lit(0).alias("db"), F.concat(F.lit("x"), F.col("id").cast("string")).cast("binary").alias("key"), F.lit("y").alias("bits"))
    assert bloom.passing(others, ["db", "key"], f, 1 << 16).count() < 40
    assert abs(bloom.fill_ratio(f, 1 << 16).first().fill - (1 - 2.718281828 ** (-4 * 1_200 / 65_536))) < 0.002
    two = bloom.merge(bloom.build(keys.where("db = 0"), ["db", "key"], 1 << 16), bloom.build(keys.where("db = 1"), ["db", "key"], 1 << 16))
    assert bloom.passing(keys, ["db", "key"], two, 1 << 16).where("db IS NOT NULL").count() == 800
    none = bloom.build(keys.where("false"), ["db", "key"])
    assert bloom.passing(keys, ["db", "key"], none).count() == 0 and bloom.fill_ratio(none).first().fill == 0


@pytest.mark.parametrize("few", [200_000, 3])
def test_look_up_folds_the_asked_keys(spark, monkeypatch, few):
    monkeypatch.setattr(reads, "SMALL_KEYS", few)
    rows = random_log(random.Random(3))
    df = st.changes(spark.createDataFrame(rows, LOG))
    asked = spark.createDataFrame([(i, *k) for i, k in enumerate([(0, b"hot"), (0, b"k1"), (1, b"k1"), (0, b"nope"), (0, b"k2"), (0, b"hot"), (None, b"k1"), (1, None), (1, b"k7")])], "pos int, db int, key binary")
    alive = {(r.db, bytes(r.key)): (r.generation, r.value) for r in st.live(df).collect()}
    got = {r.pos: (r.generation, r.value) for r in reads.look_up(asked, df, None, ("value",)).collect()}
    assert got == {r.pos: (alive.get((r.db, bytes(r.key)), (None, None)) if r.db is not None and r.key is not None else (None, None)) for r in asked.collect()}


def test_pages_by_key(spark):
    names = [f"k{i:02d}".encode() for i in range(23)] + [b"k\xff", b"", b"\xff\xff", b"j"]
    keys = spark.createDataFrame([(0, n) for n in names] + [(1, b"k5")], "db int, key binary").repartition(3)
    for pattern, want in (("k*", [n for n in sorted(names) if n.startswith(b"k")]), (None, sorted(names)), ("k1?", [n for n in sorted(names) if n[:2] == b"k1"]), ("j", [b"j"]), ("zz*", [])):
        pages, after = [], None
        while True:
            page = reads.scan_after(keys, 0, after, 10, pattern).collect()
            pages += sorted(bytes(r.key) for r in page)
            after = page and page[0].next_after
            if not after:
                break
        assert pages == want, pattern
        if pattern:
            assert sorted(bytes(r.key) for r in reads.keys(keys.where("db = 0"), pattern).collect()) == want


def test_ranges_of_bytes(spark):
    def one(col):
        return bytes(spark.range(1).select(col).first()[0])

    v, none = F.lit(b"Hello World"), F.lit(None).cast("binary")
    cases = {(0, 4): b"Hello", (-5, -1): b"World", (0, -1): b"Hello World", (5, 2): b"", (20, 30): b"", (-100, 2): b"Hel", (3, 100): b"lo World", (0, -100): b"H"}
    for (s, e), want in cases.items():
        assert one(reads.getrange(v, s, e)) == want
    assert one(reads.getrange(none, 0, 5)) == b""
    assert one(reads.setrange(v, 6, b"Redis")) == b"Hello Redis"
    assert one(reads.setrange(none, 3, b"x")) == b"\0\0\0x"
    assert one(reads.setrange(v, 13, b"!")) == b"Hello World\0\0!"
    assert spark.range(1).select(reads.strlen(F.lit("é"))).first()[0] == 2


def test_lookups_keep_order_and_repeats(spark):
    s = spark.createDataFrame([(0, b"a", b"1", 1), (0, b"b", None, 2), (1, b"a", b"x", 3)], "db int, key binary, value binary, generation long")
    asked = spark.createDataFrame([(0, 0, b"a"), (1, 0, b"zz"), (2, 0, b"a"), (3, None, b"a"), (4, 0, None)], "pos int, db int, key binary")
    got = {r.pos: r.value for r in reads.get(asked, s).collect()}
    assert got == {0: b"1", 1: None, 2: b"1", 3: None, 4: None}
    assert reads.exists(asked, s, ["db"]).where("db = 0").first().n == 2
    pages, cursor = [], 0
    keys = spark.createDataFrame([(0, f"k{i:02d}".encode()) for i in range(23)], "db int, key binary")
    while True:
        page = reads.scan(keys, 0, cursor, 10, "k*").collect()
        pages += [bytes(r.key) for r in page]
        cursor = page[0].next_cursor
        if not cursor:
            break
    assert pages == [f"k{i:02d}".encode() for i in range(23)]


def test_exported_pairs_are_the_live_state(spark):
    from keystrata.plans import catalog

    sf = "/root/testdata/sf0.001"
    q = catalog.QUERIES
    pairs = q["kv_export_pairs"](spark, sf).collect()
    assert sorted((r.db, r.key_hex, r.value_hex or "") for r in pairs) == sorted((r.db, r.key_hex, r.value_hex or "") for r in q["kv_lww_state"](spark, sf).collect())
    assert {r.shard: r.n for r in q["kv_export_shard"](spark, sf).collect()} == {s: sum(r.shard == s for r in pairs) for s in {r.shard for r in pairs}}


def test_setrange_pads_short_values_and_keeps_long_tails(spark, tmp_path):
    from keystrata.plans import catalog

    names = ["", "a", "abc", "abcde", "abcdef", "n" * 41, "m" * 60]
    spark.createDataFrame([*enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    put = lambda v, at, x: v[:at].ljust(at, b"\0") + x + v[at + len(x) :]
    got = {r.p_partkey: (r.over_, r.padded_hex) for r in catalog.QUERIES["kv_setrange"](spark, str(tmp_path)).collect()}
    assert got == {i: (put(n.encode(), 3, b"XY").decode(), put(n.encode(), 40, b"z").hex().upper()) for i, n in enumerate(names)}
