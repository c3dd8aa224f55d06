"""Session settings and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "keystrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` has the last word (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset (tests, one machine), a temporary one. On a cluster it must be set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("keystrata.shared.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("intermediate tables need a folder that all executors see: set spark.checkpoint.dir")
        at = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("keystrata.shared.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below `shared_dir`, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def clean() -> None:
        try:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or work_dir(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if ":" in shared:  # a folder that only Hadoop can write: the driver keeps the archive
        shared = tempfile.mkdtemp(prefix="keystrata-pkg-")
    folder = os.path.join(shared, f"keystrata-{app}")
    os.makedirs(folder, exist_ok=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "keystrata.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
