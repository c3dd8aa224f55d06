"""Binary formats of the store: log entries, records in blocks, peer messages; and Spark data sources over log and data files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keystrata.functions.slots import CRC32C

# Fixed values of the formats.
WAL_MAGIC, RECORD_MAGIC, BLOCK_FOOTER_MAGIC = 0x57414C21, 0x564B, 0xF00DFACEB10CDA7A
PUT, DELETE = 1, 2
DELETED, COMPRESSED = 1, 2
FILE_HEADER, BLOCK, PAD = 4096, 1 << 20, 128
WAL_HEAD = struct.Struct("<IBBHIIII")
RECORD_HEAD = struct.Struct("<HHIIQIB3xI")
PEER_HEAD = struct.Struct(">BHIII")


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ CRC32C[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def lz4_block(src: bytes) -> bytes:
    """A size-prepended LZ4 block, unpacked."""
    size = int.from_bytes(src[:4], "little")
    out, i = bytearray(), 4

    def length(base: int) -> int:
        nonlocal i
        n = base
        if base == 15:
            while True:
                n += src[i]
                i += 1
                if src[i - 1] != 255:
                    break
        return n

    while i < len(src):
        token = src[i]
        i += 1
        lit = length(token >> 4)
        out += src[i : i + lit]
        i += lit
        if i >= len(src):
            break
        back = int.from_bytes(src[i : i + 2], "little")
        i += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("LZ4 offset out of range")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("LZ4 block of another size")
    return bytes(out)


def wal_entry(kind: int, key: bytes, value: bytes, generation: int, ttl: int = 0) -> bytes:
    """One log entry. A delete has no value."""
    value = value if kind == PUT else b""
    return WAL_HEAD.pack(WAL_MAGIC, kind, 0, len(key), len(value), generation, ttl, zlib.crc32(key + value)) + key + value


def wal_entries(data: bytes, verify: bool = False) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(kind, key, value, generation, ttl) up to the first entry that is cut off or has a wrong magic; with `verify` also up to
    the first whose checksum is wrong.
    """
    at = 0
    while at + WAL_HEAD.size <= len(data):
        magic, kind, _, k, v, gen, ttl, crc = WAL_HEAD.unpack_from(data, at)
        body = at + WAL_HEAD.size
        if magic != WAL_MAGIC or body + k + v > len(data):
            return
        key, value = data[body : body + k], data[body + k : body + k + v]
        if verify and kind == PUT and crc != zlib.crc32(key + value):
            return
        yield kind, key, value, gen, ttl
        at = body + k + v


def record(key: bytes, value: bytes, generation: int, ts_us: int, ttl: int = 0, flags: int = 0) -> bytes:
    """A stored record, padded to a multiple of 128 bytes."""
    head = RECORD_HEAD.pack(RECORD_MAGIC, len(key), len(value), generation, ts_us, ttl, flags, 0)
    raw = head[:28] + struct.pack("<I", crc32c(head[:28] + key + value)) + key + value
    return raw + b"\0" * (-len(raw) % PAD)


def record_length(data: bytes, at: int) -> int:
    """Bytes of the record that begins at `at`, without padding; 0 where none does."""
    if at + RECORD_HEAD.size > len(data):
        return 0
    magic, k, v, *_ = RECORD_HEAD.unpack_from(data, at)
    return RECORD_HEAD.size + k + v if magic == RECORD_MAGIC else 0


def records(block: bytes, verify: bool = True) -> Iterator[dict]:
    """The records of a block, up to the first place without one; damaged ones are left out. Compressed values are unpacked."""
    at = 0
    while at + RECORD_HEAD.size <= len(block):
        magic, k, v, gen, ts, ttl, flags, crc = RECORD_HEAD.unpack_from(block, at)
        body = at + RECORD_HEAD.size
        if magic != RECORD_MAGIC or body + k + v > len(block):
            return
        key, value = block[body : body + k], block[body + k : body + k + v]
        if not verify or crc == crc32c(block[at : at + 28] + key + value):
            if flags & COMPRESSED:
                value = lz4_block(value)
            yield {"key": key, "value": value, "generation": gen, "ts_us": ts, "ttl_secs": ttl, "deleted": bool(flags & DELETED)}
        at = body + k + v + (-(RECORD_HEAD.size + k + v) % PAD)


def peer_message(op: int, shard: int, ttl: int, key: bytes = b"", value: bytes = b"") -> bytes:
    return PEER_HEAD.pack(op, shard, ttl, len(key), len(value)) + key + value


def peer_messages(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(op, shard, ttl, key, value) of whole messages."""
    at = 0
    while at + PEER_HEAD.size <= len(data):
        op, shard, ttl, k, v = PEER_HEAD.unpack_from(data, at)
        body = at + PEER_HEAD.size
        if body + k + v > len(data):
            return
        yield op, shard, ttl, data[body : body + k], data[body + k : body + k + v]
        at = body + k + v


@dataclass
class FilePart(InputPartition):
    path: str
    shard: int
    begin: int = 0
    end: int = 0


def _shard(path: Path) -> int:
    digits = "".join(c for c in path.parent.name if c.isdigit())
    return int(digits) if digits else 0


class WalSource(DataSource):
    """`spark.read.format("keystrata_wal").load(dir)`: entries of all `wal_*.log` files below a POSIX folder that all executors see (`files.wal` reads any file system).

    One partition a file, as an entry can only be found from the start. Option `verify` stops a file at a wrong checksum.
    """

    @classmethod
    def name(cls) -> str:
        return "keystrata_wal"

    def schema(self) -> str:
        return "shard int, file string, entry_no long, entry_type int, key binary, value binary, generation long, ttl_secs long"

    def reader(self, schema) -> DataSourceReader:
        return WalReader(self.options)


class WalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.verify = options["path"].removeprefix("file://"), str(options.get("verify", "true")).lower() == "true"

    def partitions(self) -> list[FilePart]:
        return [FilePart(str(p), _shard(p)) for p in sorted(Path(self.path).rglob("wal_*.log"))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        data = Path(partition.path).read_bytes()
        for i, (kind, key, value, gen, ttl) in enumerate(wal_entries(data, self.verify)):
            yield partition.shard, Path(partition.path).name, i, kind, key, value if kind == PUT else None, gen, ttl


class RecordSource(DataSource):
    """`spark.read.format("keystrata_records").load(dir)`: records of all `data_*.sst` files, one partition for each run of blocks."""

    @classmethod
    def name(cls) -> str:
        return "keystrata_records"

    def schema(self) -> str:
        return "file string, block int, key binary, value binary, generation long, ts_us long, ttl_secs long, deleted boolean"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.blocks = options["path"].removeprefix("file://"), int(options.get("blocksPerPartition", 128))

    def partitions(self) -> list[FilePart]:
        out = []
        for p in sorted(Path(self.path).rglob("data_*.sst")):
            n = -(-(p.stat().st_size - FILE_HEADER) // BLOCK)
            out += [FilePart(str(p), 0, b, min(n, b + self.blocks)) for b in range(0, max(n, 0), self.blocks)]
        return out

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for b in range(partition.begin, partition.end):
                f.seek(FILE_HEADER + b * BLOCK)
                for r in records(f.read(BLOCK)):
                    yield Path(partition.path).name, b, r["key"], None if r["deleted"] else r["value"], r["generation"], r["ts_us"], r["ttl_secs"], r["deleted"]


def register(spark) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(WalSource)
    spark.dataSource.register(RecordSource)
