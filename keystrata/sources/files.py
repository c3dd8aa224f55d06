"""Binary files as DataFrames over any file system that Spark reads, batch or stream, and sinks that make them.

Files are read by Spark's own binaryFile source, so a path may be on HDFS, an object store or a local disk, and are taken apart in Arrow
batches, one task a file (a log can only be read from its start; its writer rotates it). An *image* is a row with a file's or block's bytes: sinks give images, which any Spark sink
stores; where all executors see one POSIX folder, `write_files` makes files of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import prefix
from keystrata.session import ship
from keystrata.sources import binary
from keystrata.sources.resp import Malformed, Parser, dump

ROWS = 10_000
WAL = "shard int, file string, entry_no long, entry_type int, key binary, value binary, generation long, ttl_secs long"
RECORDS = "file string, block int, key binary, value binary, generation long, ts_us long, ttl_secs long, deleted boolean"
RESP = "file string, seq long, cmd string, args array<binary>, error string"
PEER = "file string, seq long, op int, shard_id int, ttl_secs long, key binary, value binary"
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}


def _parse(images: DataFrame, schema: str, rows_of: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of images (path, content) by a function of a path and bytes, in batches of ROWS."""
    ship(images.sparkSession)
    names, types = zip(*(f.rsplit(" ", 1) for f in schema.split(", ")))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows), types)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                for row in rows_of(path.as_py(), content.as_py() or b""):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    return images.select("path", "content").mapInArrow(run, schema)


def images(spark: SparkSession, path: str, names: str, *, stream: bool = False) -> DataFrame:
    """(path, content) of the files below `path` whose name matches `names`. As a stream, files that appear later come out later."""
    if not stream:
        return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path).select("path", "content")
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return s.option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _shard(path: str) -> int:
    digits = "".join(c for c in path.rsplit("/", 2)[-2] if c.isdigit()) if "/" in path else ""
    return int(digits) if digits else 0


def wal(images: DataFrame, verify: bool = True) -> DataFrame:
    """Log entries of images; a file ends at an entry that is cut off, has a wrong magic or, with `verify`, a wrong checksum."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for i, (kind, key, value, gen, ttl) in enumerate(binary.wal_entries(data, verify)):
            yield _shard(path), _name(path), i, kind, key, value if kind == binary.PUT else None, gen, ttl

    return _parse(images, WAL, rows)


def records(images: DataFrame, verify: bool = True) -> DataFrame:
    """Records of images of data files: a header of 4,096 bytes and blocks of 1 MB, of which a record longer than one has several. Damaged records are left out."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        at, n = binary.FILE_HEADER, 0
        while at < len(data):
            span = -(-binary.record_length(data, at) // binary.BLOCK) or 1
            for r in binary.records(data[at : at + span * binary.BLOCK], verify):
                yield _name(path), n, r["key"], None if r["deleted"] else r["value"], r["generation"], r["ts_us"], r["ttl_secs"], r["deleted"]
            at, n = at + span * binary.BLOCK, n + span

    return _parse(images, RECORDS, rows)


def resp(images: DataFrame) -> DataFrame:
    """Commands of images of RESP bytes, in order; one that is cut off at the end is left out, bytes that are no RESP end a file with an `error` row."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        parser, seq = Parser(), 0
        parser.feed(data)
        try:
            while (v := parser.next()) is not Parser.MORE:
                ok = isinstance(v, list) and v and all(isinstance(x, bytes) for x in v)
                yield (_name(path), seq, v[0].decode("latin-1"), v[1:], None) if ok else (_name(path), seq, None, None, "ERR Protocol error: no command")
                seq += 1
        except Malformed as e:
            yield _name(path), seq, None, None, f"ERR Protocol error: {e}"

    return _parse(images, RESP, rows)


def peer(images: DataFrame) -> DataFrame:
    """Peer messages of images of their bytes, in order, up to one that is cut off."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for i, (op, shard, ttl, key, value) in enumerate(binary.peer_messages(data)):
            yield _name(path), i, op, shard, ttl, key, value

    return _parse(images, PEER, rows)


def _joined(rows: DataFrame, by: list[str], order: list[str], raw: Callable[[dict], bytes], close: Callable[[str, list[bytes]], bytes], path: Callable[[dict], str], full: Callable[[int, bytes], bool]) -> DataFrame:
    """Images (path, content) of rows: the bytes of each run of rows with the same path, in order; a new one begins where `full`."""
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size, number = None, [], 0, 0

        def image() -> pa.RecordBatch:
            name = at.format(number)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([close(name, parts)], pa.binary())], names=["path", "content"])

        for b in batches:
            for values in zip(*(b[c].to_pylist() for c in columns)):
                r = dict(zip(columns, values))
                to, piece = path(r), raw(r)
                if at is not None and (to != at or full(size, piece)):
                    yield image()
                    number = number + 1 if to == at else 0
                    parts, size = [], 0
                at = to
                parts.append(piece)
                size += len(piece)
        if parts:
            yield image()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, "path string, content binary")


def wal_images(entries: DataFrame, file_bytes: int = 64 << 20) -> DataFrame:
    """Log files of entries (shard, entry_id, kind, key, value, generation, ttl_secs), rotated after `file_bytes`, as images.

    A shard's log is cut into files before it is written, so a large shard is many tasks.
    """
    size: Column = F.lit(binary.WAL_HEAD.size) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    cut = prefix.running_sum(entries, ["shard"], "entry_id", size.cast("long"), "begun", before=True)
    cut = cut.select("shard", F.floor(F.col("begun") / file_bytes).cast("long").alias("file_no"), "entry_id", "kind", "key", "value", "generation", "ttl_secs")

    def raw(r: dict) -> bytes:
        return binary.wal_entry(binary.PUT if r["kind"] == "PUT" else binary.DELETE, r["key"], r["value"] or b"", r["generation"], max(r["ttl_secs"] or 0, 0))

    return _joined(cut, ["shard", "file_no"], ["entry_id"], raw, lambda _, parts: b"".join(parts), lambda r: f"shard-{r['shard']}/wal_{r['file_no']:08d}.log", lambda *_: False)


def block_images(rows: DataFrame, by: str = "db", blocks_per_file: int = 64) -> DataFrame:
    """Data files of state rows (`by`, key, value, generation, ts_us, ttl_secs, deleted) as images: records padded to 128 bytes, none divided between blocks of 1 MB.

    Records of a group go to files by the hash of their key, so a large group is many tasks; a file is closed when its blocks are full. A record longer than a block has
    blocks of its own.
    """
    spread = rows.select(by, F.pmod(F.xxhash64("key"), F.lit(64)).alias("part"), "key", "value", "generation", "ts_us", "ttl_secs", "deleted")

    def raw(r: dict) -> bytes:
        return binary.record(r["key"], r["value"] or b"", r["generation"], r["ts_us"] or 0, max(r["ttl_secs"] or 0, 0), binary.DELETED if r["deleted"] else 0)

    def close(_: str, parts: list[bytes]) -> bytes:
        out, block = [bytes(binary.FILE_HEADER)], b""
        for p in parts:
            if block and len(block) + len(p) > binary.BLOCK:
                out.append(block.ljust(-(-len(block) // binary.BLOCK) * binary.BLOCK, b"\0"))
                block = b""
            block += p
        out.append(block.ljust(-(-len(block) // binary.BLOCK) * binary.BLOCK, b"\0"))
        return b"".join(out)

    return _joined(spread, [by, "part"], ["key"], raw, close, lambda r: f"{by}-{r[by]}/data_{r['part']:02d}{{:06d}}.sst", lambda size, p: size + len(p) > blocks_per_file * binary.BLOCK * 0.9)


def resp_images(commands: DataFrame, by: str = "conn_id", file_bytes: int = 64 << 20) -> DataFrame:
    """RESP bytes of commands (`by`, seq, cmd, args), each connection's in order, in files of about `file_bytes`, as images."""
    rows = commands.select(F.col(by).alias("by"), "seq", F.coalesce("cmd", F.lit("")).alias("cmd"), F.coalesce("args", F.array().cast("array<binary>")).alias("args"))
    size = F.octet_length("cmd") + F.aggregate("args", F.lit(24), lambda n, a: n + F.coalesce(F.octet_length(a), F.lit(0)) + 12)
    cut = prefix.running_sum(rows, ["by"], "seq", size.cast("long"), "begun", before=True).withColumn("file_no", F.floor(F.col("begun") / file_bytes).cast("long")).drop("begun")
    raw = lambda r: dump([r["cmd"].encode(), *(a if a is not None else b"" for a in r["args"])])
    return _joined(cut, ["by", "file_no"], ["seq"], raw, lambda _, parts: b"".join(parts), lambda r: f"conn-{r['by']}/{r['file_no']:08d}.resp", lambda *_: False)


def write_files(images_: DataFrame, folder: str) -> int:
    """Make files of images below a folder that all executors see as a POSIX path; their number. Each appears whole, by a rename, also when a task is run again.

    A folder of another file system is an error: store the images themselves there (any Spark sink), `wal` and the others read them back.
    """
    at = folder.removeprefix("file://").removeprefix("file:")
    if "://" in at or ":/" in at[:12]:
        raise ValueError(f"{folder} is no POSIX path; write the images with a Spark sink instead")
    ship(images_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                to = Path(at, path)
                to.parent.mkdir(parents=True, exist_ok=True)
                part = to.with_name(f".{to.name}-{os.getpid()}")
                part.write_bytes(content)
                os.replace(part, to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return images_.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
