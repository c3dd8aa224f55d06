"""A folder whose content is named by numbered manifests; a new version appears by one rename.

The rename must fail if the target exists, as it does on HDFS and local disks. Object stores whose rename is a copy don't promise that: there the folder of the manifests
belongs on a file system that does, while the data may lie anywhere.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from keystrata.session import hadoop_path


class VersionConflict(RuntimeError):
    """Another writer committed the same version first."""


class Versions:
    """Manifests `version-<n>.json` below `path`. What no manifest names does not exist for readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, p = hadoop_path(spark, self.path)
        self.fs.mkdirs(p)

    def _jvm_path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def number(self) -> int:
        """The last committed version, 0 before the first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._jvm_path(""))] if self.fs.exists(self._jvm_path(".")) else []
        return max([0, *(int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json"))])

    def load(self, number: int | None = None) -> dict:
        """The manifest of a version (the last by default); empty before the first."""
        number = self.number() if number is None else number
        if not number:
            return {}
        stream = self.fs.open(self._jvm_path(f"version-{number:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def unnamed(self, folder: str, keep: int) -> list[str]:
        """Names of the folders below `folder` that no manifest of the last `keep` versions names, but for ones that a running writer may be about
        to commit: those whose number is above the last version.
        """
        last = self.number()
        named = {x for n in range(max(1, last - keep + 1), last + 1) for v in self.load(n).values() if isinstance(v, list) for x in v}
        out = []
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        for s in self.fs.listStatus(jvm) if self.fs.exists(jvm) else []:
            name = s.getPath().getName()
            m = re.fullmatch(r"[a-z]+-(\d{9})-[0-9a-f]{8}", name)
            if m and int(m[1]) <= last and name not in named:
                out.append(name)
        return sorted(out)

    def remove(self, folder: str, keep: int) -> list[str]:
        """Delete what `unnamed` gives, and its names; versions before the last `keep` can't be read any more."""
        gone = self.unnamed(folder, keep)
        for name in gone:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
        return gone

    def commit(self, number: int, manifest: dict) -> None:
        """Make `manifest` version `number`. Fails with VersionConflict if that version exists."""
        jvm = self.spark.sparkContext._jvm
        tmp, final = self._jvm_path(f".writing-{number:09d}-{id(manifest)}"), self._jvm_path(f"version-{number:09d}.json")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            fc.rename(tmp, final, none)
        except Exception as e:
            self.fs.delete(tmp, False)
            if "AlreadyExists" in str(e):
                raise VersionConflict(f"version {number} of {self.path} exists") from None
            raise
