"""Session construction and the shared scratch location.

Everything that must survive executor loss (checkpoints, round-trip
tables) lives under the folder named by ``spark.checkpoint.dir``.  On a
cluster that setting points at shared storage and is read, never
overridden; only when it is unset (local tests) do we pick a folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fieldmodes", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fieldmodes`` importable on every executor (once per app).

    Functions run by mapInArrow / applyInArrow refer to this package by
    module name, so Python workers must import it; ``addPyFile`` ships a
    zip of the package the way ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="fieldmodes-pyfiles-"), "fieldmodes.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> str:
    """Checkpoint folder + package shipped to executors; returns the folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster intermediate tables need a shared folder")
        conf_dir = tempfile.mkdtemp(prefix="fieldmodes-ckpt-")  # one machine: a local folder is shared by all tasks
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whatever store it names?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table nobody reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str = "tmp") -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


class Lifetime:
    """Owns what a job keeps between its steps: cached frames, scratch tables, broadcast values.

    All are freed, the last first, when the ``with`` block ends, also if it ends
    with an error.  What the job returns must not read from them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frees: list[Callable[[], object]] = []

    def cache(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._frees.append(df.unpersist)
        return df

    def scratch(self, name: str = "tmp") -> str:
        path = scratch_path(self.spark, name)
        self._frees.append(lambda: delete_path(self.spark, path))
        return path

    def broadcast(self, value):
        bc = self.spark.sparkContext.broadcast(value)
        self._frees.append(bc.unpersist)
        return bc

    def release(self) -> None:
        while self._frees:
            self._frees.pop()()

    def __enter__(self) -> Lifetime:
        return self

    def __exit__(self, *_) -> None:
        self.release()
