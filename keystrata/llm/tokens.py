"""Encoding of a corpus with a public byte-level BPE tokenizer, by tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.session import ship

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A token never goes on from a printable ASCII character to a blank or line feed, and never from an ASCII letter to an ASCII
#: digit; what stands left of such a place is split alike with or without the rest, and the other way round.
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])")
_encoders: dict = {}


def encoder(rank_file: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, one for each process."""
    if (rank_file, pattern) not in _encoders:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[rank_file, pattern]


def _sent(spark, rank_file: str) -> str:
    """Send the rank file to the executors; its name there (see `_there`)."""
    spark.sparkContext.addFile(rank_file)
    return rank_file.rstrip("/").rsplit("/", 1)[-1]


def _there(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def pieces(text: str, longest: int) -> Iterator[str]:
    """`text` cut at safe places into pieces of about `longest` characters.

    Where there is no safe place (no printable ASCII character before a blank, no ASCII letter before a digit), a piece is longer; a text
    without any goes to the encoder whole.
    """
    at = 0
    while len(text) - at > longest:
        m = SAFE.search(text, at + longest)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str | None, longest: int = 1 << 16) -> list[int]:
    """Ids of one text, none for null and empty ones. Text that looks like a special token is plain text."""
    if not text:
        return []
    if len(text) <= longest:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, longest) for i in enc.encode_ordinary(p)]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, rank_file: str, *, pattern: str = PATTERN, longest: int = 1 << 16) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row, whole texts, one pass without a shuffle. The driver sends the rank file to the executors. Null and empty texts have an empty list.

    Repeated rows come out as often as they come in; other columns are not read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = _sent(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_there(name), pattern)
        for b in batches:
            ids = pa.array([encode_text(enc, t, longest) for t in b["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["id"], ids], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, rank_file: str, *, pattern: str = PATTERN) -> DataFrame:
    """(id, raw BINARY, text) of lists of ids: the bytes joined, and their text, null where the bytes are not UTF-8.

    A null list gives null, an empty one empty bytes.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    name = _sent(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_there(name), pattern)
        for b in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(raw, pa.binary())], names=["id", "raw"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, raw binary")
    return out.withColumn("text", F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string")))
