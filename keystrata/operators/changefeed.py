"""Applying a stream of inserts, updates and deletes: a table of append-only files with delete vectors.

Row images are only ever appended. An index gives the file and position of each key's present image and its generation
(deleted keys keep theirs). Applying a batch finds the superseded images through the index, sets their bits in per-file
bitmaps, appends the new images, and commits all of it as one version. Reads leave out positions whose bit is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators import bloom
from keystrata.operators.versions import Versions

VECTOR_BROADCAST = 8_000  # bitmaps of 4 KB: 32 MB
BUCKET_BITS = 32_768


def mutation_kind(op: Column, entry_type: Column) -> Column:
    """PUT or DELETE: `op` without outer blanks and regardless of case, `entry_type` (1, 2) where it is null; else null."""
    said = F.upper(F.regexp_replace(op, r"^\s+|\s+$", ""))
    return F.when(op.isNotNull(), F.when(said.isin("PUT", "DELETE"), said)).otherwise(F.when(entry_type == 1, "PUT").when(entry_type == 2, "DELETE"))


def changes(log: DataFrame) -> DataFrame:
    """The rows of a log that carry a change, with `kind`: key and generation not null, a PUT or a DELETE."""
    return log.withColumn("kind", mutation_kind(F.col("op"), F.col("entry_type"))).where("key IS NOT NULL AND generation IS NOT NULL AND kind IS NOT NULL")


class VectorTable:
    """Present state of a keyed table below `path`, with the columns of `payload` kept in the images.

    Keys are (db, key), null-safe. A change wins over what is known of its key if its generation is higher; the same generation
    again is the same change, an older one is late and has no effect, not even after a delete.
    """

    def __init__(self, spark: SparkSession, path: str, payload: T.StructType = T.StructType()):
        taken = {"db", "key", "generation", "kind", "file", "pos", "bucket", "bits"} & {f.name for f in payload.fields}
        if taken:
            raise ValueError(f"payload columns {sorted(taken)} have names that the table needs")
        self.spark, self.path, self.payload = spark, path.rstrip("/"), payload
        self.versions = Versions(spark, f"{self.path}/log")
        self.image = T.StructType([T.StructField("db", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("generation", T.LongType()), *payload.fields])

    INDEX = "db int, key binary, generation long, file string, pos long"
    VECTORS = "file string, bucket long, bits binary"

    def _read(self, manifest: dict, kind: str, schema) -> DataFrame:
        at = [f"{self.path}/{x}" for x in manifest.get(kind, [])]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _index(self, manifest: dict, keys: DataFrame | None = None) -> DataFrame:
        """The newest entry of each key, or of the keys of a batch; `file` is null for a deleted key."""
        held = self._read(manifest, "index", self.INDEX)
        if keys is not None:
            held = bloom.touched(held, keys, ["db", "key"])
        if len(manifest.get("index", [])) < 2:
            return held
        return held.groupBy("db", "key").agg(F.max(F.struct("generation", "file", "pos")).alias("m")).select("db", "key", "m.*")

    def apply(self, batch: DataFrame, *, before_commit=None) -> int:
        """Apply rows with db, key, generation, kind and the payload; returns the version.

        Rows come in any order and any number of times; those with a null key or generation or another kind are left out, other
        columns are not read, an empty batch is an empty version. The batch is first reduced to each key's highest generation, before any
        shuffle and again after it, so a hot key costs one row for each task. A large index is scanned, but only its entries of the batch's keys go on.
        """
        manifest, number = self.versions.load(), self.versions.number() + 1
        tag = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        cols = [f.name for f in self.payload.fields]
        batch = batch.where("key IS NOT NULL AND generation IS NOT NULL AND kind IN ('PUT', 'DELETE')")
        new = batch.withColumn("db", F.col("db").cast("int")).withColumn("generation", F.col("generation").cast("long")).groupBy("db", "key")
        if cols:
            new = new.agg(F.max(F.struct("generation", "kind", *cols)).alias("c")).select("db", "key", "c.*")
        else:  # two numbers for each key, which a hash aggregate takes
            new = new.agg(*[F.max(F.when(F.col("kind") == k, F.col("generation"))).alias(k) for k in ("PUT", "DELETE")])
            put = F.col("DELETE").isNull() | (F.col("PUT") >= F.col("DELETE"))
            new = new.select("db", "key", F.greatest("PUT", "DELETE").alias("generation"), F.when(put, "PUT").otherwise("DELETE").alias("kind"))
        if manifest.get("index") and bloom.large(self._read(manifest, "index", self.INDEX)):
            new.write.parquet(f"{self.path}/batch-{tag}")
            new = self.spark.read.schema(new.schema).parquet(f"{self.path}/batch-{tag}")
            index = self._index(manifest, new)
        else:
            index = self._index(manifest)
        old = index.select(F.col("db").alias("odb"), F.col("key").alias("okey"), F.col("generation").alias("ogen"), F.col("file").alias("ofile"), F.col("pos").alias("opos"))
        won = new.join(old, F.col("db").eqNullSafe(F.col("odb")) & (F.col("key") == F.col("okey")), "left").where("ogen IS NULL OR generation > ogen")
        won.drop("odb", "okey").write.parquet(f"{self.path}/won-{tag}")
        won = self.spark.read.parquet(f"{self.path}/won-{tag}")
        won.where("kind = 'PUT'").select("db", "key", "generation", *cols).write.parquet(f"{self.path}/data-{tag}")
        placed = self.spark.read.schema(self.image).parquet(f"{self.path}/data-{tag}").select(
            "db", "key", "generation", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
        gone = won.where("kind = 'DELETE'").select("db", "key", "generation", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("pos"))
        placed.unionByName(gone).write.parquet(f"{self.path}/index-{tag}")
        dead = won.where("ofile IS NOT NULL").groupBy(F.col("ofile").alias("file"), F.expr("bitmap_bucket_number(opos + 1)").alias("bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(opos + 1))").alias("bits"))
        dead.write.parquet(f"{self.path}/vectors-{tag}")
        if before_commit:
            before_commit()
        self.versions.commit(number, {k: [*manifest.get(k, []), f"{k}-{tag}"] for k in ("data", "index", "vectors")})
        return number

    def vectors(self, version: int | None = None) -> DataFrame:
        """(file, bucket, bits): all bits set so far; bit i of bucket b is position (b - 1) * 32768 + i."""
        return self._read(self.versions.load(version), "vectors", self.VECTORS).groupBy("file", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows (db, key, generation, payload) of a version, the last by default.

        Vectors are broadcast if they are at most VECTOR_BROADCAST bitmaps, else joined by a shuffle of file and bucket.
        """
        manifest = self.versions.load(version)
        rows = self._read(manifest, "data", self.image)
        if not manifest.get("data"):
            return rows
        names = rows.columns
        rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
        rows = rows.withColumn("bucket", F.expr("bitmap_bucket_number(pos + 1)"))
        v = self.vectors(version)
        v = F.broadcast(v) if v.limit(VECTOR_BROADCAST + 1).count() <= VECTOR_BROADCAST else v
        bit = (F.col("pos") % BUCKET_BITS).cast("int")
        byte = F.ascii(F.decode(F.substring(F.col("bits"), F.shiftright(bit, 3) + 1, F.lit(1)), "ISO-8859-1"))
        is_set = F.call_function("getbit", byte.cast("long"), bit % 8) == 1
        return rows.join(v, ["file", "bucket"], "left").where(F.col("bits").isNull() | ~is_set).select(*names)

    def compact(self) -> int:
        """Rewrite the live rows into new files without vectors; generations of live and deleted keys stay as they are."""
        manifest, number = self.versions.load(), self.versions.number() + 1
        tag = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        self.read().write.parquet(f"{self.path}/data-{tag}")
        placed = self.spark.read.schema(self.image).parquet(f"{self.path}/data-{tag}").select(
            "db", "key", "generation", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
        placed.unionByName(self._index(manifest).where("file IS NULL")).write.parquet(f"{self.path}/index-{tag}")
        self.versions.commit(number, {"data": [f"data-{tag}"], "index": [f"index-{tag}"], "vectors": []})
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the last `keep` versions don't name: leftovers of batches, failed ones too, and files before a rewrite."""
        return self.versions.remove(self.path, keep)
