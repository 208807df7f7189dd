"""Session and durable-intermediate helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kasane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (AQE, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir`` (or by an earlier
    ``setCheckpointDir``). Only where neither is set and all runs on one machine
    (master ``local``), as in tests, a temporary folder is made and set.
    """
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kasane-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Writes intermediate tables to the shared folder and reads them back.

    Each ``save`` runs one job, cuts the lineage, and survives the loss of any
    executor. ``drop`` removes a table no later step reads, ``close`` all of
    them. What a lazy result still needs is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kasane-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clear)

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kasane_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_kasane_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        """Removes all tables now; results that still read them must have been written."""
        _delete(self.spark, self.root)
        atexit.unregister(self._clear)

    def _clear(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the JVM is gone; the folder goes with the cluster's clean-up
            pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
