"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plan quality; cluster sizing is left to spark-submit.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cpus: str | int = "*", memory: str = "20g", app: str = "dialoom") -> SparkSession:
    """A local session for tests and benches. On a cluster, use spark-submit and `configure`."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.driver.memory", memory)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.extraJavaOptions", "-Xss16m"))
    for k, v in SQL_SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the session's Python workers (once per application), in place of --py-files."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="dialoom-"), "dialoom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("dialoom", os.path.relpath(full, here)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session somebody else built, and give its workers this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize in the cluster's shared checkpoint folder, so lost executors cost no recomputation chain."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="dialoom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_SCRATCH: dict[str, str] = {}
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for files of this session in the shared folder `spark.checkpoint.dir`; Spark removes it at its end."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="dialoom-files-", dir=os.environ.get("TMPDIR", "/tmp"))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/files-{uuid.uuid4().hex}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _SCRATCH[app] = path.toString()
    return f"{_SCRATCH[app]}/{uuid.uuid4().hex}"


def stored(df: DataFrame, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """Written to a compressed table in the shared folder and read again: cuts the lineage like a checkpoint, in less room.

    Shuffle files of the writing go with it. `spent` names stored tables that nothing reads from then on; they go too.
    """
    spark = df.sparkSession
    path, was = scratch_folder(spark), spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(RELEASE_SHUFFLES) if was is None else spark.conf.set(RELEASE_SHUFFLES, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for t in spent:
        drop_stored(t)
    return out


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a `stored` table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
