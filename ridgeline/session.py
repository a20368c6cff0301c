"""Sessions and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: The folder that holds this package.
HOME = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started;
    a cluster that installs it needs nothing."""
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), HOME]))


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.master(master).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # else what ``cut`` writes stays
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, on any filesystem that Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Where that setting is unset a temporary folder is set first and removed at
    exit; only a local master may do so.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one of this
    process where executors are threads of it."""
    global _own
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if _own is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own}")
    return f"file://{_own}"
