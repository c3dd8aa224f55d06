"""Commands in order: an interpreter of the whole command surface, run over partitions of a command table.

Set-based forms of single commands stand in `reads`, `folds` and `state`. This is the exact form for mixed logs, where a
command's effect depends on all before it: conditional writes, renames, transactions. Times come from the commands, never from the clock.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.glob import glob_to_regex
from keystrata.functions.numbers import human_size, plain_float
from keystrata.functions.slots import CRC16, SLOTS
from keystrata.operators import prefix
from keystrata.session import ship
from keystrata.sources.resp import Error, Status

DATABASES = 16
SECOND = 1_000_000
NOT_INT = "ERR value is not an integer or out of range"
_INT, _FLOAT = re.compile(rb"[+-]?[0-9]+"), re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def strict_int(raw: bytes, low: int = -(2**63), high: int = 2**63 - 1) -> int | None:
    """An optionally signed row of digits in range, else None."""
    if not _INT.fullmatch(raw):
        return None
    n = int(raw)
    return n if low <= n <= high else None


def strict_float(raw: bytes) -> float | None:
    """A finite number, else None."""
    if not _FLOAT.fullmatch(raw):
        return None
    x = float(raw)
    return x if abs(x) < float("inf") else None


def slot_of(key: bytes) -> int:
    """Hash slot of one key."""
    m = re.match(rb"[^{]*\{([^}]+)\}", key)
    crc = 0
    for b in m[1] if m else key:
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b]
    return crc % SLOTS


@dataclass
class Entry:
    value: bytes
    ttl: int
    at: int
    generation: int

    def gone(self, now: int) -> bool:
        return self.ttl > 0 and now >= self.at + self.ttl * SECOND


@dataclass
class Connection:
    db: int = 0
    queue: list[list[bytes]] | None = None
    watched: dict[tuple[int, bytes], int | None] = field(default_factory=dict)
    selected: bool = False
    readonly: bool = False


class Refused(Exception):
    """Ends a command with an error reply."""


COMMANDS: dict[bytes, tuple[int, Callable]] = {}


def command(name: str, arity: int):
    """Registers a command with the least number of arguments after its name."""

    def add(f: Callable) -> Callable:
        for n in name.split():
            COMMANDS[n.encode()] = (arity, f)
        return f

    return add


@dataclass(frozen=True)
class Node:
    """One node's view of its cluster, for commands that it may not answer itself.

    `ranges` (first slot, last slot, node id of the primary, ids of the replicas) and `addresses` (node id, redis address) are few. With `replica_read` a
    connection that has sent READONLY is answered from the replicas that this node holds.
    """

    node_id: int
    ranges: tuple[tuple[int, int, int, tuple[int, ...]], ...]
    addresses: tuple[tuple[int, str], ...]
    replica_read: bool = False
    statuses: tuple[tuple[int, str], ...] = ()

    def owner(self, slot: int) -> tuple[int | None, tuple[int, ...]]:
        return next(((p, r) for first, last, p, r in self.ranges if first <= slot <= last), (None, ()))


class Store:
    """Databases, connections and subscriptions of one command stream.

    With `max_keys` and `max_bytes` (of keys and values, for each database) a write that would go beyond is refused. An expired key keeps
    its place until it is touched. With `resolved` the database of a command is given with it, SELECT or not.
    """

    def __init__(self, max_keys: int | None = None, node: Node | None = None, max_bytes: int | None = None, resolved: bool = False):
        self.dbs: dict[int, dict[bytes, Entry]] = {}
        self.held: dict[int, int] = {}
        self.generation: dict[int, int] = {}
        self.conns: dict[int, Connection] = {}
        self.exact: dict[bytes, set[int]] = {}
        self.patterns: dict[bytes, set[int]] = {}
        self.max_keys, self.max_bytes, self.node, self.resolved, self.now = max_keys, max_bytes, node, resolved, 0

    # state

    def _forget(self, db: int, key: bytes) -> None:
        e = self.dbs[db].pop(key)
        self.held[db] -= len(key) + len(e.value)

    def peek(self, c: Connection, key: bytes) -> Entry | None:
        e = self.dbs.setdefault(c.db, {}).get(key)
        if e is not None and e.gone(self.now):
            self._forget(c.db, key)
            return None
        return e

    def alive(self, c: Connection) -> list[bytes]:
        return [k for k in list(self.dbs.get(c.db, {})) if self.peek(c, k)]

    def _next(self, db: int) -> int:
        self.generation[db] = self.generation.get(db, 0) + 1
        return self.generation[db]

    def put(self, c: Connection, key: bytes, value: bytes, ttl: int = 0) -> None:
        if len(key) > 65_535:
            raise Refused("ERR key too long")
        old = self.peek(c, key)
        held = self.dbs.setdefault(c.db, {})
        more = len(key) + len(value) - (len(key) + len(old.value) if old else 0)
        if (self.max_keys is not None and not old and len(held) >= self.max_keys) or (self.max_bytes is not None and self.held.get(c.db, 0) + more > self.max_bytes):
            raise Refused("OOM command not allowed when used memory > 'maxmemory'.")
        self.held[c.db] = self.held.get(c.db, 0) + more
        held[key] = Entry(value, ttl, self.now, self._next(c.db))

    def drop(self, c: Connection, key: bytes) -> bool:
        if not self.peek(c, key):
            return False
        self._next(c.db)
        self._forget(c.db, key)
        return True

    def elsewhere(self, c: Connection, name: bytes, args: list[bytes]) -> Error | None:
        """Why this node does not run a command on keys: their slot is another's, or MGET and MSET name several slots."""
        if self.node is None or name not in KEYED:
            return None
        keys = args[::2] if name == b"MSET" else args if name == b"MGET" else args[:1]
        slots = [slot_of(k) for k in keys]
        moved = None
        owner, replicas = self.node.owner(slots[0])
        if owner != self.node.node_id and not (c.readonly and self.node.replica_read and name in READS and self.node.node_id in replicas):
            moved = Error(f"MOVED {slots[0]} {dict(self.node.addresses).get(owner, '')}" if owner is not None else "CLUSTERDOWN Hash slot not served")
        if name == b"MSET" and moved:  # asked of the first key before the other slots are looked at
            return moved
        return Error("CROSSSLOT Keys in request don't hash to the same slot") if len(set(slots)) > 1 else moved

    # dispatch

    def run(self, conn: int, db: int | None, args: list[bytes], now: int) -> object:
        """The reply to one command. `db` is the connection's database until it has run a SELECT."""
        self.now = max(now, 0)
        c = self.conns.setdefault(conn, Connection())
        if not c.selected or self.resolved:
            c.db = db or 0
        name = args[0].upper() if args and args[0] is not None else b""
        if c.queue is not None and name not in (b"MULTI", b"EXEC", b"DISCARD", b"WATCH"):
            c.queue.append(args)
            return Status("QUEUED")
        return self.execute(c, conn, args)

    def execute(self, c: Connection, conn: int, args: list[bytes]) -> object:
        name = args[0].upper() if args and args[0] is not None else b""
        known = COMMANDS.get(name)
        if known is None:
            return Error(f"ERR Unknown command '{name.decode('latin-1')}'")
        if len(args) - 1 < known[0] or any(a is None for a in args[1:]):
            return Error(f"ERR wrong number of arguments for '{name.decode().lower()}' command")
        moved = self.elsewhere(c, name, args[1:])
        if moved is not None:
            return moved
        try:
            return known[1](self, c, args[1:], conn)
        except Refused as e:
            return Error(str(e))


def _int(raw: bytes, low: int = -(2**63), high: int = 2**63 - 1) -> int:
    n = strict_int(raw, low, high)
    if n is None:
        raise Refused(NOT_INT)
    return n


def _lifetime(s: Store, unit: bytes, raw: bytes, error: str) -> int | None:
    """Seconds of an EX, PX, EXAT or PXAT option; None for a moment that has passed."""
    n = _int(raw, 0, 2**63 - 1)
    if unit == b"EX" or unit == b"PX":
        if n <= 0 or (unit == b"EX" and n >= 2**32):
            raise Refused(error)
        return n if unit == b"EX" else max(n // 1000, 1)
    if unit == b"EXAT":
        now = s.now // SECOND
        return n - now if n > now else None
    left = n - s.now // 1000
    return max(left // 1000, 1) if left > 0 else None


@command("PING", 0)
def _ping(s, c, a, conn):
    return a[0] if a else Status("PONG")


@command("ECHO", 1)
def _echo(s, c, a, conn):
    return a[0]


@command("TIME", 0)
def _time(s, c, a, conn):
    return [str(s.now // SECOND).encode(), str(s.now % SECOND).encode()]


@command("GET", 1)
def _get(s, c, a, conn):
    e = s.peek(c, a[0])
    return e.value if e else None


@command("SET", 2)
def _set(s, c, a, conn):
    key, value, opts = a[0], a[1], [x.upper() for x in a[2:]]
    ttl, flags, i = 0, set(), 0
    while i < len(opts):
        o = opts[i]
        if o in (b"EX", b"PX", b"EXAT", b"PXAT"):
            if i + 1 >= len(opts):
                raise Refused("ERR syntax error")
            got = _lifetime(s, o, a[2 + i + 1], NOT_INT)
            if got is None:
                raise Refused("ERR invalid expire time in 'set' command")
            ttl = got
            i += 2
        elif o in (b"NX", b"XX", b"KEEPTTL", b"GET"):
            flags.add(o)
            i += 1
        else:
            raise Refused("ERR syntax error")
    if {b"NX", b"XX"} <= flags:
        raise Refused("ERR XX and NX options at the same time are not compatible")
    old = s.peek(c, key)
    if (b"NX" in flags and old) or (b"XX" in flags and not old):
        return None
    if b"KEEPTTL" in flags:
        ttl = old.ttl if old else 0
    s.put(c, key, value, ttl)
    if b"GET" in flags:
        return old.value if old else None
    return Status("OK")


@command("SETNX", 2)
def _setnx(s, c, a, conn):
    if s.peek(c, a[0]):
        return 0
    s.put(c, a[0], a[1])
    return 1


def _setex(unit: bytes):
    def f(s, c, a, conn):
        if (strict_int(a[1]) or 0) <= 0:
            raise Refused("ERR invalid expire time")
        s.put(c, a[0], a[2], _lifetime(s, unit, a[1], "ERR invalid expire time"))
        return Status("OK")

    return f


command("SETEX", 3)(_setex(b"EX"))
command("PSETEX", 3)(_setex(b"PX"))


@command("MGET", 1)
def _mget(s, c, a, conn):
    return [_get(s, c, [k], conn) for k in a]


@command("MSET", 2)
def _mset(s, c, a, conn):
    if len(a) % 2:
        raise Refused("ERR wrong number of arguments for 'mset' command")
    for k, v in zip(a[::2], a[1::2]):
        s.put(c, k, v)
    return Status("OK")


@command("DEL UNLINK", 1)
def _del(s, c, a, conn):
    return sum(s.drop(c, k) for k in a)


@command("GETDEL", 1)
def _getdel(s, c, a, conn):
    e = s.peek(c, a[0])
    if e:
        s.drop(c, a[0])
    return e.value if e else None


@command("GETEX", 1)
def _getex(s, c, a, conn):
    e = s.peek(c, a[0])
    if not e:
        return None
    if len(a) > 1:
        o = a[1].upper()
        if o == b"PERSIST":
            s.put(c, a[0], e.value)
        elif o in (b"EX", b"PX", b"EXAT", b"PXAT"):
            if len(a) < 3:
                raise Refused("ERR syntax error")
            if (strict_int(a[2]) or 0) <= 0 and o in (b"EX", b"PX"):
                raise Refused("ERR invalid expire time")
            ttl = _lifetime(s, o, a[2], "ERR invalid expire time")
            if ttl is not None:
                s.put(c, a[0], e.value, ttl)
        else:
            raise Refused("ERR unsupported option")
    return e.value


@command("EXISTS", 1)
def _exists(s, c, a, conn):
    return sum(s.peek(c, k) is not None for k in a)


@command("TYPE", 1)
def _type(s, c, a, conn):
    return Status("string" if s.peek(c, a[0]) else "none")


@command("OBJECT", 1)
def _object(s, c, a, conn):
    if a[0].upper() == b"HELP":
        return [b"OBJECT ENCODING <key>"]
    if a[0].upper() != b"ENCODING" or len(a) < 2:
        raise Refused("ERR unknown subcommand")
    if not s.peek(c, a[1]):
        raise Refused("ERR no such key")
    return b"raw"


@command("STRLEN", 1)
def _strlen(s, c, a, conn):
    e = s.peek(c, a[0])
    return len(e.value) if e else 0


def _rewrite(s: Store, c: Connection, key: bytes, value: bytes) -> None:
    """A new value under the old TTL; its clock restarts."""
    e = s.peek(c, key)
    s.put(c, key, value, e.ttl if e else 0)


@command("APPEND", 2)
def _append(s, c, a, conn):
    new = (_get(s, c, a[:1], conn) or b"") + a[1]
    _rewrite(s, c, a[0], new)
    return len(new)


@command("GETRANGE", 3)
def _getrange(s, c, a, conn):
    lo, hi = _int(a[1]), _int(a[2])
    v = _get(s, c, a[:1], conn) or b""
    lo = max(len(v) + lo, 0) if lo < 0 else lo
    hi = max(len(v) + hi, 0) if hi < 0 else hi
    return v[lo : hi + 1] if lo <= hi else b""


@command("SETRANGE", 3)
def _setrange(s, c, a, conn):
    at = strict_int(a[1], 0, 1 << 24)
    if at is None:
        raise Refused("ERR offset is out of range")
    v = (_get(s, c, a[:1], conn) or b"").ljust(at, b"\0")
    new = v[:at] + a[2] + v[at + len(a[2]) :]
    _rewrite(s, c, a[0], new)
    return len(new)


def _add(s: Store, c: Connection, key: bytes, by: int) -> int:
    held = strict_int(_get(s, c, [key], 0) or b"0")
    if held is None:
        raise Refused(NOT_INT)
    if not -(2**63) <= held + by < 2**63:
        raise Refused("ERR increment or decrement would overflow")
    _rewrite(s, c, key, str(held + by).encode())
    return held + by


command("INCR", 1)(lambda s, c, a, conn: _add(s, c, a[0], 1))
command("DECR", 1)(lambda s, c, a, conn: _add(s, c, a[0], -1))
command("INCRBY", 2)(lambda s, c, a, conn: _add(s, c, a[0], _int(a[1])))
command("DECRBY", 2)(lambda s, c, a, conn: _add(s, c, a[0], -_int(a[1])))


@command("INCRBYFLOAT", 2)
def _incrbyfloat(s, c, a, conn):
    held, by = strict_float(_get(s, c, a[:1], conn) or b"0"), strict_float(a[1])
    if held is None or by is None:
        raise Refused("ERR value is not a valid float")
    if abs(held + by) == float("inf"):
        raise Refused("ERR increment would produce NaN or Infinity")
    new = plain_float(held + by).encode()
    _rewrite(s, c, a[0], new)
    return new


def _left(unit: int):
    def f(s, c, a, conn):
        e = s.peek(c, a[0])
        return -2 if not e else -1 if not e.ttl else (e.at + e.ttl * SECOND - s.now) // unit

    return f


command("TTL", 1)(_left(SECOND))
command("PTTL", 1)(_left(1000))


def _expire(per_second: int, absolute: bool):
    """Lifetimes in whole seconds; nothing left deletes the key. A moment that has passed answers 1 even for a missing key."""

    def f(s, c, a, conn):
        n = _int(a[1], 0, 2**32 - 1 if per_second == 1 and not absolute else 2**63 - 1)
        if absolute:
            left = n - s.now // (SECOND // per_second)
            if left <= 0:
                s.drop(c, a[0])
                return 1
            n = max(left, per_second) if per_second > 1 else left
        e = s.peek(c, a[0])
        if not e:
            return 0
        if n // per_second == 0:
            s.drop(c, a[0])
        else:
            s.put(c, a[0], e.value, n // per_second)
        return 1

    return f


command("EXPIRE", 2)(_expire(1, False))
command("PEXPIRE", 2)(_expire(1000, False))
command("EXPIREAT", 2)(_expire(1, True))
command("PEXPIREAT", 2)(_expire(1000, True))


@command("PERSIST", 1)
def _persist(s, c, a, conn):
    e = s.peek(c, a[0])
    if not e or not e.ttl:
        return 0
    s.put(c, a[0], e.value)
    return 1


def _copied(s: Store, c: Connection, src: bytes, dst: bytes) -> None:
    e = s.peek(c, src)
    s.put(c, dst, e.value, e.ttl)


@command("RENAME", 2)
def _rename(s, c, a, conn):
    if not s.peek(c, a[0]):
        raise Refused("ERR no such key")
    if a[0] != a[1]:
        _copied(s, c, a[0], a[1])
        s.drop(c, a[0])
    return Status("OK")


@command("RENAMENX", 2)
def _renamenx(s, c, a, conn):
    if not s.peek(c, a[0]):
        raise Refused("ERR no such key")
    if s.peek(c, a[1]):
        return 0
    _rename(s, c, a, conn)
    return 1


@command("COPY", 2)
def _copy(s, c, a, conn):
    replace = any(x.upper() == b"REPLACE" for x in a[2:])
    if not s.peek(c, a[0]) or (s.peek(c, a[1]) and not replace):
        return 0
    _copied(s, c, a[0], a[1])
    return 1


def _matching(s: Store, c: Connection, pattern: bytes) -> list[bytes]:
    rx = re.compile(glob_to_regex(pattern.decode("latin-1"))[:-1] + r"\Z")
    return sorted(k for k in s.alive(c) if rx.match(k.decode("latin-1")))


command("KEYS", 1)(lambda s, c, a, conn: _matching(s, c, a[0]))
command("DBSIZE", 0)(lambda s, c, a, conn: len(s.alive(c)))


@command("SCAN", 1)
def _scan(s, c, a, conn):
    cursor, opts, count, pattern = _int(a[0], 0), a[1:], 10, b"*"
    for name, v in zip(opts, opts[1:]):
        if name.upper() == b"MATCH":
            pattern = v
        elif name.upper() == b"COUNT":
            count = strict_int(v, 1) or 10
    found = _matching(s, c, pattern)
    upto = cursor + count
    return [str(upto if upto < len(found) else 0).encode(), found[cursor:upto]]


@command("RANDOMKEY", 0)
def _randomkey(s, c, a, conn):
    return min(s.alive(c), default=None)


@command("FLUSHDB", 0)
def _flushdb(s, c, a, conn):
    s.dbs[c.db], s.held[c.db] = {}, 0
    s._next(c.db)
    return Status("OK")


@command("FLUSHALL", 0)
def _flushall(s, c, a, conn):
    for db in s.dbs:
        s.dbs[db], s.held[db] = {}, 0
        s._next(db)
    return Status("OK")


@command("SELECT", 1)
def _select(s, c, a, conn):
    n = strict_int(a[0], 0, DATABASES - 1)
    if n is None:
        raise Refused("ERR DB index is out of range")
    c.db, c.selected = n, True
    return Status("OK")


for _name, _reply in (("WAIT", 0), ("COMMAND", [])):
    command(_name, 0)(lambda s, c, a, conn, r=_reply: r)


def _reading(only: bool):
    def f(s, c, a, conn):
        c.readonly = only
        return Status("OK")

    return f


command("READONLY", 0)(_reading(True))
command("READWRITE", 0)(_reading(False))
for _name in ("DUMP", "DEBUG", "RESTORE"):
    command(_name, 0)(lambda s, c, a, conn, n=_name: Error(f"ERR {n} not supported"))


@command("CONFIG", 1)
def _config(s, c, a, conn):
    sub = a[0].upper()
    if sub == b"RESETSTAT":
        return Status("OK")
    if sub == b"GET" and len(a) > 1:
        pairs = {"maxmemory": "0", "maxmemory-policy": "noeviction", "databases": str(DATABASES), "save": "", "appendonly": "yes", "maxkeys": str(s.max_keys or 0)}
        rx = re.compile(glob_to_regex(a[1].decode("latin-1").lower())[:-1] + r"\Z")
        return [x.encode() for k, v in pairs.items() if rx.match(k) for x in (k, v)]
    raise Refused("ERR CONFIG subcommand not supported")


@command("INFO", 0)
def _info(s, c, a, conn):
    """Server, Memory, Replication and Keyspace; figures that a stream of commands does not have (caches, latencies, files) are in `stats`."""
    space, entries, total = [], 0, 0
    for db in sorted(s.dbs):
        own = Connection(db)
        n = len(s.alive(own))
        entries, total = entries + n, total + s.held.get(db, 0)
        if n:
            space.append(f"db{db}:keys={n},expires={sum(1 for k in s.alive(own) if s.dbs[db][k].ttl)}")
    lines = ["# Server", "redis_version:7.0.0", f"redis_mode:{'cluster' if s.node else 'standalone'}", "# Memory", f"used_memory:{total}", f"used_memory_human:{human_size(total)}",
        f"used_memory_peak:{total}", f"maxmemory:{s.max_bytes or 0}", "maxmemory_policy:noeviction", f"keyspace_live_entries:{entries}",
        "# Replication", "role:master", *([] if s.node else ["connected_slaves:0"]), "# Keyspace", *space]
    return ("\r\n".join(lines) + "\r\n").encode()


@command("CLUSTER", 1)
def _cluster(s, c, a, conn):
    sub, node = a[0].upper(), s.node
    if sub == b"KEYSLOT" and len(a) > 1:
        return slot_of(a[1])
    if sub == b"MYID":
        return f"{node.node_id if node else 0:040x}".encode()
    if sub == b"INFO":
        if node is None:
            return b"cluster_enabled:0\r\n"
        status = {i: st.lower() for i, st in node.statuses}
        n = {st: sum(last - first + 1 for first, last, p, _ in node.ranges if status.get(p, "active") == st) for st in ("suspect", "dead")}
        ok, known = sum(last - first + 1 for first, last, *_ in node.ranges) - sum(n.values()), len(node.addresses)
        active = sum(status.get(i, "active") == "active" for i, _ in node.addresses)
        pairs = {"cluster_enabled": 1, "cluster_state": "ok", "cluster_slots_assigned": SLOTS, "cluster_slots_ok": ok, "cluster_slots_pfail": n["suspect"], "cluster_slots_fail": n["dead"],
            "cluster_known_nodes": known, "cluster_size": active, "local_node_id": node.node_id}
        return "".join(f"{k}:{v}\r\n" for k, v in pairs.items()).encode()
    if sub == b"NODES":
        if node is None:
            return b"standalone mode"
        mark = {"suspect": ",fail?", "dead": ",fail"}
        out = []
        for i, address in node.addresses:
            own = " ".join(f"{first}-{last}" if first < last else f"{first}" for first, last, p, _ in node.ranges if p == i)
            flags = ("myself," if i == node.node_id else "") + "master" + mark.get(dict(node.statuses).get(i, "active").lower(), "")
            out.append(f"{i:040x} {address} {flags} - 0 0 0 connected {own}\n")
        return "".join(out).encode()
    if sub == b"SLOTS" and node is not None:
        at = dict(node.addresses)
        place = lambda i: [at.get(i, ":0").rsplit(":", 1)[0].encode(), int(at.get(i, ":0").rsplit(":", 1)[1]), f"{i:040x}".encode()]
        return [[first, last, place(p), *[place(r) for r in rs]] for first, last, p, rs in node.ranges]
    raise Refused("ERR This instance has cluster support disabled" if node is None else "ERR unknown subcommand")


@command("MULTI", 0)
def _multi(s, c, a, conn):
    if c.queue is not None:
        raise Refused("ERR MULTI calls can not be nested")
    c.queue = []
    return Status("OK")


@command("EXEC", 0)
def _exec(s, c, a, conn):
    if c.queue is None:
        raise Refused("ERR EXEC without MULTI")
    queued, c.queue = c.queue, None
    watched, c.watched = c.watched, {}
    for (db, key), seen in watched.items():
        e = s.peek(Connection(db), key)
        if (e.generation if e else None) != seen:
            return None
    return [s.execute(c, conn, q) for q in queued]


@command("DISCARD", 0)
def _discard(s, c, a, conn):
    if c.queue is None:
        raise Refused("ERR DISCARD without MULTI")
    c.queue, c.watched = None, {}
    return Status("OK")


@command("WATCH", 1)
def _watch(s, c, a, conn):
    if c.queue is not None:
        raise Refused("ERR WATCH inside MULTI is not allowed")
    for k in a:
        e = s.peek(c, k)
        c.watched[c.db, k] = e.generation if e else None
    return Status("OK")


@command("UNWATCH", 0)
def _unwatch(s, c, a, conn):
    c.watched = {}
    return Status("OK")


def _subscribing(word: bytes, table: str, add: bool):
    def f(s, c, a, conn):
        held = getattr(s, table)
        names = a or ([] if add else sorted(k for k, v in held.items() if conn in v))
        out = []
        for n in names:
            (held.setdefault(n, set()).add if add else held.get(n, set()).discard)(conn)
            out.append([word, n, sum(conn in v for v in (*s.exact.values(), *s.patterns.values()))])
        return out[0] if len(out) == 1 else out or [word, None, 0]

    return f


command("SUBSCRIBE", 1)(_subscribing(b"subscribe", "exact", True))
command("PSUBSCRIBE", 1)(_subscribing(b"psubscribe", "patterns", True))
command("UNSUBSCRIBE", 0)(_subscribing(b"unsubscribe", "exact", False))
command("PUNSUBSCRIBE", 0)(_subscribing(b"punsubscribe", "patterns", False))


@command("PUBLISH", 2)
def _publish(s, c, a, conn):
    text = a[0].decode("latin-1")
    globbed = sum(len(v) for p, v in s.patterns.items() if re.match(glob_to_regex(p.decode("latin-1"))[:-1] + r"\Z", text))
    return len(s.exact.get(a[0], ())) + globbed


#: Commands that touch one key only, and those that touch none.
ONE_KEY = """GET SET SETNX SETEX PSETEX GETDEL GETEX TYPE STRLEN APPEND GETRANGE SETRANGE INCR DECR INCRBY DECRBY INCRBYFLOAT
TTL PTTL EXPIRE PEXPIRE EXPIREAT PEXPIREAT PERSIST""".split()
#: Commands on keys, and those of them that only read.
KEYED = {n.encode() for n in (*ONE_KEY, "MGET", "MSET", "DEL", "UNLINK", "EXISTS", "RENAME", "RENAMENX", "COPY")}
READS = {b"GET", b"MGET", b"EXISTS", b"TYPE", b"STRLEN", b"GETRANGE", b"TTL", b"PTTL"}
PUBSUB = "PUBLISH SUBSCRIBE PSUBSCRIBE UNSUBSCRIBE PUNSUBSCRIBE".split()
NO_KEY = "PING ECHO TIME READONLY READWRITE WAIT COMMAND DUMP DEBUG RESTORE CONFIG".split()
#: Databases that are named in the plan; more are joined.
MOST_DBS = 1_000
REPLY = "seq long, kind string, str string, int long, bulk binary, items array<binary>"


def _reply_row(r: object) -> tuple:
    """kind, str, int, bulk, items of a reply; nested lists are given flat, other values in lists as their text."""
    if isinstance(r, Status):
        return "simple", str(r), None, None, None
    if isinstance(r, Error):
        return "error", str(r), None, None, None
    if isinstance(r, int):
        return "integer", None, int(r), None, None
    if isinstance(r, list):
        flat: list = []
        for x in r:
            flat += (_reply_row(x)[4] or []) if isinstance(x, list) else [x if x is None or isinstance(x, bytes) else str(x).encode()]
        return "array", None, None, None, flat
    return "bulk", None, None, r, None


def replay(commands: DataFrame, max_keys: int | None = None, *, max_bytes: int | None = None, node: Node | None = None) -> DataFrame:
    """Replies (seq, kind, str, int, bulk, items) to commands (seq, db, conn_id, cmd, args, ts), one for each.

    Commands run in the order of `seq`. Where a database sees only commands of one key, each key is its own ordered stream; else
    the database is one stream, as it is with `max_keys` or `max_bytes`, caps on all its keys. What a connection has SELECTed is found before, so databases
    stay streams of their own; publishing and subscribing is a stream by itself. A FLUSHALL or INFO, and a MULTI in a table with SELECT or
    subscriptions, makes the whole table one stream. Streams are read in order with the live keys as the only state. `node` makes commands on other nodes' slots errors. Null
    args count as none, a null cmd is an unknown command, a null ts takes the stream's last time, a null conn_id is connection 0, a null db database 0.
    """
    ship(commands.sparkSession)
    c = commands.select("seq", F.coalesce("db", F.lit(0)).cast("int").alias("db"), F.coalesce("conn_id", F.lit(0)).cast("long").alias("conn_id"),
        F.upper(F.coalesce("cmd", F.lit(""))).alias("cmd"), F.coalesce("args", F.array().cast("array<binary>")).alias("args"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    is_ = lambda *names: F.col("cmd").isin(*names)
    says = c.agg(F.max(is_("SELECT")), F.max(is_("MULTI")), F.max(is_("FLUSHALL", "INFO")), F.max(is_(*PUBSUB)), F.max(is_("READONLY", "READWRITE"))).first()
    select, multi, wide, talk, reading = (bool(x) for x in says)
    wide = wide or (multi and (select or talk)) or (reading and node is not None)
    resolved = select and not wide
    if resolved:
        chosen = F.expr("try_cast(cast(get(args, 0) as string) as int)")
        valid = is_("SELECT") & (F.expr("cast(get(args, 0) as string)").rlike(r"^[+-]?[0-9]+$")) & chosen.between(0, DATABASES - 1)
        c = prefix.last_value(c, ["conn_id"], "seq", chosen, F.coalesce(valid, F.lit(False)), "chosen", before=False)
        c = c.withColumn("db", F.coalesce("chosen", "db")).drop("chosen")
    if max_keys is not None or max_bytes is not None:
        c = c.withColumn("linked", F.lit(True))
    else:
        links = c.where(~is_(*ONE_KEY, *NO_KEY, "SELECT", *PUBSUB)).select(F.col("db").alias("of")).distinct()
        dbs = [r[0] for r in links.limit(MOST_DBS + 1).collect()]
        c = c.withColumn("linked", F.col("db").isin(dbs)) if len(dbs) <= MOST_DBS else c.join(links, F.col("db") == F.col("of"), "left").withColumn("linked", F.col("of").isNotNull()).drop("of")
    stream = F.when(F.lit(wide), F.lit("*")).when(is_(*PUBSUB), F.lit("p")).when(F.col("linked"), F.concat(F.lit("d"), F.col("db").cast("string"))).otherwise(
        F.concat(F.lit("k"), F.col("db").cast("string"), F.lit("/"), F.coalesce(F.hex(F.try_element_at("args", F.lit(1))), F.lit(""))))
    rows = c.withColumn("stream", stream).drop("linked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, store, now = None, None, 0
        for b in batches:
            out: list[tuple] = []
            for stream_, seq, db, conn, cmd, args, us in zip(*(b[x].to_pylist() for x in ("stream", "seq", "db", "conn_id", "cmd", "args", "us"))):
                if stream_ != at or store is None:
                    at, store, now = stream_, Store(max_keys, node, max_bytes, resolved), 0
                now = now if us is None else us
                out.append((seq, *_reply_row(store.run(conn, db, [cmd.encode(), *args], now))))
            cols = [list(x) for x in zip(*out)] or [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=["seq", "kind", "str", "int", "bulk", "items"])

    return rows.repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, REPLY)


def cluster_node(slots: DataFrame, nodes: DataFrame, node_id: int, *, replica_read: bool = False) -> Node:
    """A node's view from slots (slot, primary, replicas) and nodes (node_id, redis_addr, status). Both are as small as a cluster is: 16,384 slots at most."""
    held = sorted((r["slot"], r["primary"], tuple(r["replicas"] or ())) for r in slots.select("slot", "primary", "replicas").collect())
    ranges: list[list] = []
    for slot, primary, replicas in held:
        if ranges and ranges[-1][1] == slot - 1 and ranges[-1][2:] == [primary, replicas]:
            ranges[-1][1] = slot
        else:
            ranges.append([slot, slot, primary, replicas])
    known = sorted((r["node_id"], r["redis_addr"], r["status"]) for r in nodes.select("node_id", "redis_addr", "status").collect())
    return Node(node_id, tuple(tuple(r) for r in ranges), tuple((i, a) for i, a, _ in known), replica_read, tuple((i, st) for i, _, st in known))
