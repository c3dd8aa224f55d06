import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm.seen import FIRST, MAYBE, BlockedBloom, _exact, bits_for, bloom_verdicts, false_positive_rate, kept_filters, seen_before, seen_errors


def brute(rows):
    first = {}
    for i, k in rows:
        if i is not None and k is not None:
            first[k] = min(first.get(k, i), i)
    return sorted((i, first[k] < i) for i, k in rows if i is not None and k is not None)


def test_filter_rate_is_near_the_expected_one():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60_000, dtype=np.int64)
    b = BlockedBloom.sized(50_000, 0.01)
    b.insert(h[:50_000])
    assert b.query(h[:50_000]).all()
    assert b.query(rng.integers(0, 2**63, 100_000, dtype=np.int64)).mean() < 0.02
    assert false_positive_rate(bits_for(0.001)) <= 0.001


@pytest.mark.parametrize("fp_rate", [0.001, 0.9])
def test_exact_at_any_rate_with_a_hot_key(spark, fp_rate):
    rng = np.random.default_rng(2)
    rows = [(int(i), b"hot" if rng.random() < 0.35 else f"k{int(rng.zipf(1.3)) % 700}".encode()) for i in rng.permutation(6_000)]
    rows += [(None, b"hot"), (7_000, None), (7_001, b""), (7_002, b""), (7_003, b"\xff\x00"), (5, b"hot")]
    df = spark.createDataFrame([(i, k, "x", 1) for i, k in rows], "msg_id long, key binary, bucket string, h int").repartition(5)
    got = seen_before(df, "msg_id", F.col("key"), fp_rate=fp_rate, chunk_rows=500, ask_rows=70)
    assert sorted((r.id, r.seen) for r in got.collect()) == brute(rows)


def test_empty_and_errors(spark):
    empty = spark.createDataFrame([], "msg_id long, key binary")
    assert seen_before(empty, "msg_id", F.col("key")).count() == 0
    assert {r.kind: r.asked for r in seen_errors(empty, "msg_id", F.col("key"), probes=50).collect()} == {"stream": 0, "absent": 50}
    df = spark.range(3_000).select(F.col("id").alias("msg_id"), F.col("id").cast("string").cast("binary").alias("key"))
    e = {r.kind: r for r in seen_errors(df, "msg_id", F.col("key"), probes=2_000, fp_rate=0.05).collect()}
    assert e["stream"].asked == 3_000 and e["absent"].asked == 2_000
    assert e["absent"].rate < 0.1 and e["stream"].rate < 0.1


def test_kept_filters_know_earlier_keys(spark):
    key = F.col("id").cast("string").cast("binary")
    old = spark.range(500).select("id", key.alias("key"))
    v = bloom_verdicts(old, "id", F.col("key"), expected_keys=1_000, buckets=4, keep_state=True)
    state = v.where("blob IS NOT NULL").select("bucket", "blob")
    new = spark.range(400, 600).select("id", key.alias("key"))
    got = {r.id: r.verdict for r in bloom_verdicts(new, "id", F.col("key"), expected_keys=1_000, buckets=4, state=state).collect()}
    assert all(got[i] == 1 for i in range(400, 500))
    assert sum(got[i] for i in range(500, 600)) <= 3


def test_the_filter_settles_first_rows_and_only_hits_are_compared(spark):
    # a: "not there" stands whatever else the table holds. b: a wrong "there" on the key's first row. c: a right one.
    rows = [(1, b"a", FIRST), (2, b"a", FIRST), (3, b"b", MAYBE), (4, b"b", MAYBE), (5, b"c", FIRST), (6, b"c", MAYBE), (7, b"d", MAYBE)]
    got = {r.id: r.truly for r in _exact(spark.createDataFrame(rows, "id long, key binary, verdict byte")).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_calls_with_kept_filters(spark, tmp_path):
    key = F.col("id").cast("string").cast("binary")
    call = lambda lo, hi, n, **how: seen_before(
        spark.range(lo, hi).select("id", key.alias("key")), "id", F.col("key"), expected_keys=2_000, keep_to=str(tmp_path / n), **how).collect()
    kept = lambda n: spark.read.parquet(str(tmp_path / n))
    assert not any(r.seen for r in call(0, 500, "a", buckets=3))
    b = call(400, 600, "b", state=kept("a"))
    assert all(r.seen and not r.sure for r in b if r.id < 500)
    assert sum(r.seen for r in b if r.id >= 500) <= 3 and all(r.sure != r.seen for r in b)
    c = {r.id: r for r in call(450, 700, "c", state=kept("b"))}
    assert all(c[i].seen for i in range(450, 600)) and sum(c[i].seen for i in range(600, 700)) <= 3
    earlier = spark.range(0, 600).select(key.alias("k"))
    d = {r.id: r for r in call(450, 700, "d", state=kept("b"), known=earlier)}
    assert all(r.sure and r.seen == (i < 600) for i, r in d.items())
    with pytest.raises(ValueError):
        call(0, 9, "e", state=kept("a"), buckets=4)


def test_hits_of_the_filter_occur_and_decide(spark, monkeypatch):
    from keystrata.llm import seen

    rng = np.random.default_rng(5)
    rows = [(i, f"k{int(rng.integers(0, 900))}".encode()) for i in range(4_000)]
    df = spark.createDataFrame(rows, "msg_id long, key binary").repartitionByRange(4, "msg_id")
    v = bloom_verdicts(df, "msg_id", F.col("key"), chunk_rows=300, ask_rows=50)
    assert v.where(F.col("verdict") == MAYBE).count() > 1_000
    assert sorted((r.id, r.seen) for r in seen_before(df, "msg_id", F.col("key"), chunk_rows=300, ask_rows=50).collect()) == brute(rows)
    monkeypatch.setattr(seen, "HASHES", 10)  # the way without broadcasts
    assert sorted((r.id, r.seen) for r in seen_before(df, "msg_id", F.col("key"), chunk_rows=300, ask_rows=50).collect()) == brute(rows)
    # a filter that forgets is seen in the answers: what it calls new is new
    first = v.where(F.col("verdict") == MAYBE).first()
    broken = v.withColumn("verdict", F.when(F.col("id") == first.id, FIRST).otherwise(F.col("verdict")).cast("byte"))
    assert {r.id: r.truly for r in _exact(broken).collect()}[first.id] is False
