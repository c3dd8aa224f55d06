import pytest

from keystrata.operators.folds import exact_fold
from keystrata.operators.interpreter import Node, Store, replay, slot_of
from keystrata.sources.resp import Error, Malformed, Parser, Status, dump, load

NOW = 1_700_000_000_000_000


def run(*commands, store=None, now=NOW, conn=1):
    s = store or Store()
    out = None
    for c in commands:
        args = [x if isinstance(x, bytes) else str(x).encode() for x in (c.split() if isinstance(c, str) else c)]
        out = s.run(conn, 0, args, now)
    return out


OK = Status("OK")
CASES = [
    (["INCR k"], 1), (["SET k 10", "INCR k"], 11), (["SET k 10", "DECR k"], 9), (["SET k 10", "INCRBY k 5"], 15), (["SET k 10", "DECRBY k 3"], 7),
    (["SET k 10.5", "INCRBYFLOAT k 0.1"], b"10.6"), (["SET k 3.0e3", "INCRBYFLOAT k 200"], b"3200"),
    (["SET k Hello", ["APPEND", "k", b" World"]], 11), ([["SET", "k", b"Hello World"], "GETRANGE k 0 4"], b"Hello"), ([["SET", "k", b"Hello World"], "GETRANGE k -5 -1"], b"World"),
    ([["SET", "k", b"Hello World"], "SETRANGE k 6 Redis", "GET k"], b"Hello Redis"), (["STRLEN k"], 0), (["SETNX k v"], 1), (["SET k v", "SETNX k w"], 0),
    (["SET k v NX"], OK), (["SET k v", "SET k w NX"], None), (["SET k v XX"], None), (["SET k v", "SET k w XX GET"], b"v"), (["SET k v GET"], None),
    (["SET k v EX 100", "TTL k"], 100), (["SET k v PX 1500", "TTL k"], 1), (["SET k v PX 10", "PTTL k"], 1000), (["SET k v EX 100", "SET k w", "TTL k"], -1),
    (["SET k v EX 100", "SET k w KEEPTTL", "TTL k"], 100), (["TTL k"], -2), (["SET k v", "EXPIRE k 10", "TTL k"], 10), (["SET k v", "EXPIRE k 0", "GET k"], None),
    (["EXPIRE k 10"], 0), (["SET k v EX 5", "PERSIST k"], 1), (["SET k v", "PERSIST k"], 0), (["SET k v", "EXPIREAT k 1", "EXISTS k"], 0), (["EXPIREAT k 1"], 1),
    ([f"SET k v EXAT {NOW // 10**6 + 60}", "TTL k"], 60), (["SET k v", f"PEXPIREAT k {NOW // 1000 + 90_500}", "TTL k"], 90),
    (["MSET a 1 b 2", "MGET b x a b"], [b"2", None, b"1", b"2"]), (["MSET a 1 b 2", "EXISTS a a x b"], 3), (["MSET a 1 b 2", "DEL a x a"], 1), (["SET k v", "DEL k", "DEL k"], 0),
    (["SET k v", "GETDEL k"], b"v"), (["SET k v", "GETDEL k", "GETDEL k"], None), (["SET k v", "GETEX k EX 9", "TTL k"], 9), (["SET k v EX 9", "GETEX k PERSIST", "TTL k"], -1),
    (["SET a v EX 9", "RENAME a b", "TTL b"], 9), (["SET a v", "RENAME a a", "GET a"], b"v"), (["SET a 1", "SET b 2", "RENAMENX a b"], 0), (["SET a 1", "RENAMENX a b"], 1),
    (["SET a 1", "COPY a b", "GET b"], b"1"), (["MSET a 1 b 2", "COPY a b"], 0), (["MSET a 1 b 2", "COPY a b REPLACE"], 1), (["COPY a b"], 0),
    (["TYPE k"], Status("none")), (["SET k v", "TYPE k"], Status("string")), (["SET k v", "OBJECT ENCODING k"], b"raw"), (["MSET a 1 b 2", "DBSIZE"], 2),
    (["MSET user:1 a user:2 b x c", "KEYS user:*"], [b"user:1", b"user:2"]), (["MSET a 1 b 2 c 3", "SCAN 0 COUNT 2"], [b"2", [b"a", b"b"]]), (["MSET a 1 b 2 c 3", "SCAN 2 COUNT 2"], [b"0", [b"c"]]),
    (["SET k v", "FLUSHDB", "DBSIZE"], 0), (["SET k v", "SELECT 1", "DBSIZE"], 0), (["SET k v", "SELECT 1", "FLUSHALL", "SELECT 0", "DBSIZE"], 0), (["RANDOMKEY"], None),
    (["PING"], Status("PONG")), (["PING hi"], b"hi"), (["ECHO x"], b"x"), (["TIME"], [b"1700000000", b"0"]), (["WAIT 1 0"], 0), (["COMMAND"], []), (["get k"], None), (["gEt k"], None),
    (["MULTI", "SET k v", "GET k", "EXEC"], [OK, b"v"]), (["MULTI", "SET k v"], Status("QUEUED")), (["MULTI", "SET k v", "DISCARD", "GET k"], None), (["MULTI", "SET k x", "INCR k", "GET k", "EXEC"], None),
    (["WATCH k", "MULTI", "SET k v", "EXEC"], [OK]), (["CLUSTER KEYSLOT foo"], 12182), (["CONFIG GET m?xmemory"], [b"maxmemory", b"0"]), (["UNSUBSCRIBE"], [b"unsubscribe", None, 0]),
    (["SUBSCRIBE a b"], [[b"subscribe", b"a", 1], [b"subscribe", b"b", 2]]), (["SUBSCRIBE a", "PSUBSCRIBE ?", "PUBLISH a m"], 2), (["SUBSCRIBE a", "UNSUBSCRIBE a", "PUBLISH a m"], 0),
]


@pytest.mark.parametrize("commands,reply", CASES)
def test_replies(commands, reply):
    got = run(*commands)
    if commands[0] == "MULTI" and "INCR k" in commands:
        assert got[0] == OK and isinstance(got[1], Error) and got[2] == b"x"  # no rollback
    else:
        assert got == reply and type(got) is type(reply)


ERRORS = [
    ["SET k notanumber", "INCR k"], ["SET k 9223372036854775807", "INCR k"], ["SET k -9223372036854775808", "DECRBY k 1"], ["INCRBY k 1.5"], ["INCRBYFLOAT k nan"], ["SET k v EX 0"], ["SET k v EX x"],
    ["SET k v NX XX"], ["SET k v BAD"], ["SET k v EXAT 5"], ["SETEX k 0 v"], ["PSETEX k -1 v"], ["EXPIRE k -1"], ["SETRANGE k -1 x"], ["RENAME a b"], ["RENAMENX a b"], ["OBJECT ENCODING k"], ["SELECT 16"], ["SELECT 256"],
    ["MULTI", "MULTI"], ["EXEC"], ["DISCARD"], ["MULTI", "WATCH k"], ["NOSUCH"], ["GET"], ["MSET a 1 b"], ["DUMP k"], ["CONFIG SET a b"], ["GETEX k BAD", "SET k v", "GETEX k BAD"],
]


@pytest.mark.parametrize("commands", ERRORS)
def test_errors_are_replies(commands):
    got = run(*commands)
    assert isinstance(got, Error) and not str(got).startswith("ERR ERR")


def test_errors_leave_the_value():
    s = Store()
    assert run("SET k abc", "INCR k", "APPEND k d", store=s) == 4
    assert run("GET k", store=s) == b"abcd"


def test_watch_conflict_and_expiry():
    s = Store()
    run("SET k 1", "WATCH k", "MULTI", "SET k 2", store=s, conn=1)
    run("SET k 3", store=s, conn=2)
    assert run("EXEC", store=s, conn=1) is None and run("GET k", store=s) == b"3"
    run("SET t v EX 10", store=s)
    assert run("GET t", store=s, now=NOW + 9_999_999) == b"v"
    assert run("GET t", store=s, now=NOW + 10_000_000) is None


def test_capacity():
    s = Store(max_keys=2)
    assert run("SET a 1", "SET b 2", "SET a 3", store=s) == OK
    assert str(run("SET c 1", store=s)).startswith("OOM")


def test_capacity_in_bytes():
    s = Store(max_bytes=10)
    assert run("SET a 12345", "SET b 12", "SET a 123456", store=s) == OK and s.held[0] == 10
    assert str(run("SET c 1", store=s)).startswith("OOM") and str(run("APPEND b 3", store=s)).startswith("OOM")
    assert run("DEL a", "SET c 1", "FLUSHDB", "SET a 123456789", store=s) == OK and s.held[0] == 10


def test_cluster_answers():
    a, b = slot_of(b"a"), slot_of(b"b")
    at = lambda **how: Node(1, ((0, a - 1, 1, ()), (a, a, 2, (1,)), (a + 1, 16383, 1, ())), ((1, "10.0.0.1:7000"), (2, "10.0.0.2:7001")), **how)
    moved = f"MOVED {a} 10.0.0.2:7001"
    s = Store(node=at())
    assert str(run("GET a", store=s)) == str(run("SET a 1", store=s)) == str(run("MSET a 1 b 2", store=s)) == moved
    assert run("SET b 1", store=s) == OK and run("MGET b {b}x", store=s) == [b"1", None]
    assert str(run("MGET a b", store=s)).startswith("CROSSSLOT") and str(run("MSET b 1 a 2", store=s)).startswith("CROSSSLOT")
    assert str(run("READONLY", "GET a", store=s)) == moved  # no reads from replicas
    s = Store(node=at(replica_read=True))
    assert str(run("GET a", store=s)) == moved and run("READONLY", "GET a", store=s) is None and str(run("SET a 1", store=s)) == moved and str(run("READWRITE", "GET a", store=s)) == moved
    assert run("CLUSTER MYID", store=s) == b"1".rjust(40, b"0") and run("CLUSTER MYID") == b"0" * 40
    assert b"cluster_slots_ok:16384" in run("CLUSTER INFO", store=s) and run("CLUSTER NODES") == b"standalone mode"
    assert run("CLUSTER SLOTS", store=s)[1][:2] == [a, a] and b"myself,master - 0 0 0 connected 0-" in run("CLUSTER NODES", store=s)
    assert str(run("GET b", store=Store(node=Node(1, (), ())))).startswith("CLUSTERDOWN") and b != a
    assert b"redis_mode:cluster" in run("INFO", store=s) and b"used_memory_human:0B" in run("INFO")


COMMANDS = "seq long, db int, conn_id long, cmd string, args array<binary>, ts timestamp_ntz"


def test_replay_by_key_by_database_and_whole(spark):
    b = lambda *a: [x.encode() if isinstance(x, str) else x for x in a]
    one = [(1, 0, 1, "SET", b("a", "1"), None), (2, 0, 1, "INCR", b("a"), None), (3, 1, 1, "GET", b("a"), None), (4, 0, None, "get", b("a"), None), (5, None, 1, None, None, None), (6, 0, 1, "SET", [None, b"x"], None), (7, 0, 1, "GET", b(), None)]
    linked = [*one, (8, 0, 1, "RENAME", b("a", "z"), None), (9, 0, 1, "GET", b("z"), None)]
    wide = [*linked, (10, 0, 9, "SELECT", b("1"), None), (11, 0, 9, "SET", b("q", "v"), None), (12, 0, 9, "DBSIZE", b(), None)]
    for rows in (one, linked, wide):
        got = {r.seq: r for r in replay(spark.createDataFrame(rows, COMMANDS).repartition(3)).collect()}
        assert len(got) == len(rows)
        assert got[1].str == "OK" and got[2].int == 2 and got[3].bulk is None and got[4].bulk == b"2"
        assert got[5].kind == got[6].kind == got[7].kind == "error"
        if 9 in got:
            assert got[9].bulk == b"2"
        if 12 in got:
            assert got[12].int == 1
    assert replay(spark.createDataFrame([], COMMANDS)).count() == 0
    # what a connection has selected stays; a bad SELECT changes nothing; subscriptions are a stream beside the databases
    sel = [(1, 3, 5, "SET", b("a", "3"), None), (2, 3, 5, "SELECT", b("7"), None), (3, 3, 5, "SET", b("a", "7"), None), (4, 3, 5, "SELECT", b("x"), None), (5, 3, 5, "GET", b("a"), None), (6, 3, 6, "GET", b("a"), None),
        (7, 3, 5, "SELECT", b(), None), (8, 3, 5, "SUBSCRIBE", b("c"), None), (9, 1, 6, "PUBLISH", b("c", "m"), None), (10, 3, 5, "SELECT", b("-1"), None), (11, 3, 5, "DBSIZE", b(), None)]
    for more in ([], [(12, 0, 8, "INFO", b(), None)]):
        got = {r.seq: r for r in replay(spark.createDataFrame(sel + more, COMMANDS).repartition(3)).collect()}
        assert got[5].bulk == b"7" and got[6].bulk == b"3" and got[9].int == 1 and got[11].int == 1
        assert [got[i].kind for i in (2, 4, 7, 10)] == ["simple", "error", "error", "error"]


def test_replay_under_a_cap_takes_a_database_as_one_stream(spark):
    rows = [(1, 0, 9, "SET", [b"a", b"1"], None), (2, 0, 9, "SET", [b"b", b"1"], None), (3, 0, 9, "SET", [b"a", b"2"], None), (4, 1, 9, "SET", [b"b", b"1"], None)]
    got = {r.seq: r.kind for r in replay(spark.createDataFrame(rows, COMMANDS).repartition(3), max_keys=1).collect()}
    assert got[2] == "error" and "error" not in (got[1], got[3], got[4])


def test_exact_fold(spark):
    rows = [
        ("a", 1, "SET", "9223372036854775806"), ("a", 2, "INCRBY", "1"), ("a", 3, "INCRBY", "1"), ("a", 4, "APPEND", "x"), ("a", 5, "INCRBY", "1"), ("a", 6, "DEL", None), ("a", 7, "INCRBYFLOAT", "0.5"),
        ("b", 1, "INCRBY", None), ("b", 2, "GET", None), (None, 1, "SET", "n"), (None, 2, "GET", None), ("c", 1, None, None)]
    got = {(None if r.key is None else bytes(r.key).decode(), r.seq): r for r in exact_fold(spark.createDataFrame(rows, "key string, seq long, cmd string, arg string")).collect()}
    assert got["a", 2].reply == b"9223372036854775807" and "overflow" in got["a", 3].error and got["a", 3].value == b"9223372036854775807"
    assert "integer" in got["a", 5].error and got["a", 6].reply == b"1" and got["a", 7].reply == b"0.5"
    assert got["b", 1].error and got["b", 2].reply is None and got[None, 2].reply == b"n" and got["c", 1].error


def test_resp_round_trip_in_pieces():
    values = [OK, Error("ERR x"), 7, -1, b"", b"a\r\nb", None, [b"x", [1, None], []], [b"SET", b"k", b"v"]]
    raw = b"".join(map(dump, values))
    assert load(raw) == values
    p, got = Parser(), []
    for i in range(len(raw)):
        p.feed(raw[i : i + 1])
        while (v := p.next()) is not Parser.MORE:
            got.append(v)
    assert got == values
    assert load(b"PING hello\r\n") == [[b"PING", b"hello"]]
    for bad in (b"$x\r\n", b"$-5\r\n", b"$1\r\nabc\r\n", b"*99999999\r\n"):
        with pytest.raises(Malformed):
            load(bad)
