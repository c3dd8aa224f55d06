"""Command tables from RESP files, and reply tables as RESP bytes."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader

from keystrata.session import ship
from keystrata.sources.binary import FilePart
from keystrata.sources.resp import Error, Malformed, Parser, Status, dump

CHUNK = 1 << 20


class RespSource(DataSource):
    """`spark.read.format("keystrata_resp").load(dir)`: the commands of all `*.resp` files, in order; one partition a file (a connection)."""

    @classmethod
    def name(cls) -> str:
        return "keystrata_resp"

    def schema(self) -> str:
        return "file string, seq long, cmd string, args array<binary>, error string"

    def reader(self, schema) -> DataSourceReader:
        return RespReader(self.options)


class RespReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[FilePart]:
        return [FilePart(str(p), 0) for p in sorted(Path(self.path).rglob("*.resp"))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        """Whole commands; one that is cut off at the end is left out. Bytes that are no RESP end the file with an `error` row."""
        name, seq, parser = Path(partition.path).name, 0, Parser()
        with open(partition.path, "rb") as f:
            while data := f.read(CHUNK):
                parser.feed(data)
                try:
                    while (v := parser.next()) is not Parser.MORE:
                        ok = isinstance(v, list) and v and all(isinstance(x, bytes) for x in v)
                        yield (name, seq, v[0].decode("latin-1"), v[1:], None) if ok else (name, seq, None, None, "ERR Protocol error: no command")
                        seq += 1
                except Malformed as e:
                    yield name, seq, None, None, f"ERR Protocol error: {e}"
                    return


def reply_bytes(replies: DataFrame) -> DataFrame:
    """(seq, raw): replies (seq, kind, str, int, bulk, items) as RESP-2 bytes. A null kind gives a null bulk string."""
    ship(replies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for kind, text, n, bulk, items in zip(*(b[c].to_pylist() for c in ("kind", "str", "int", "bulk", "items"))):
                value = {"simple": lambda: Status(text), "error": lambda: Error(text), "integer": lambda: n, "array": lambda: items}.get(kind, lambda: bulk)()
                raw.append(dump(value))
            yield pa.RecordBatch.from_arrays([b["seq"], pa.array(raw, pa.binary())], names=["seq", "raw"])

    return replies.select("seq", "kind", "str", "int", "bulk", "items").mapInArrow(run, "seq long, raw binary")
