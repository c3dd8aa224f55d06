import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def queries():
    import __spark_entry__ as e

    return {n: f for n, f in e.queries().items() if n.startswith(("kv_", "ext_")) and not n.startswith(("kv_stream", "kv_wal_replay", "kv_replay", "kv_exact"))}


#: Joins of a one-row table, and of channels with a bounded set of patterns.
LOOPS = {"kv_publish", "kv_publish_receivers", "kv_slot_assign", "kv_slot_ranges", "kv_slots_per_node", "kv_moved", "kv_rebalance", "kv_cluster_info", "kv_cluster_slots", "kv_cluster_nodes", "kv_flushdb", "kv_wal_stats", "kv_compaction_candidates"}


def test_no_product_joins_and_no_row_udfs(spark):
    for name, f in queries().items():
        p = plan(f(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BatchEvalPython" not in p, name
        assert "BroadcastNestedLoopJoin" not in p or name in LOOPS, name


def test_scans_read_what_they_need(spark):
    q = queries()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(q["kv_strlen"](spark, SF))
    p = plan(q["ext_q1"](spark, SF))
    assert "LessThanOrEqual(l_shipdate" in p and "l_comment" not in p and "l_orderkey" not in p
    p = plan(q["kv_op_counts"](spark, SF))
    assert "ReadSchema: struct<op:int>" in p
    p = plan(q["kv_lww_state"](spark, SF))
    assert "IsNotNull(key)" in p and "IsNotNull(generation)" in p and "arrived_at" not in p
    for name in ("kv_keys_prefix", "kv_keys_glob", "kv_exists", "kv_type", "kv_ttl_cmd", "kv_del", "kv_hit_ratio", "kv_scan_page", "kv_index_stats", "kv_expiry_sweep", "kv_rename"):
        for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan(q[name](spark, SF))):
            assert "entry_type" not in schema or not re.search(r"\bvalue:", schema), (name, schema)
    p = plan(q["kv_keys_prefix"](spark, SF))
    assert "GreaterThanOrEqual(key" in p and "LessThan(key" in p


def test_asked_keys_are_joined_before_the_fold(spark):
    for name in ("kv_get", "kv_exists", "kv_ttl_cmd"):
        p = plan(queries()[name](spark, SF))
        fold = next(i for i, line in enumerate(p.split("\n")) if "max_by" in line)
        assert any("LeftSemi" in line for line in p.split("\n")[fold:]), name


def test_counters_shuffle_the_rows_once(spark):
    for name in ("kv_incr_fold", "kv_health_streak"):
        p = plan(queries()[name](spark, SF))
        assert p.count("Exchange") == 1 and p.count("Scan parquet") == 1, name
