"""Shared storage: where lineage is cut and where round-trip tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[str, list[str]] = {}  # paths by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a fresh folder, once per session. Anywhere else
    a folder of the driver's own would be invisible to the executors, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, remembered for :func:`clean_up`."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows once to shared storage and read them back.

    Cuts lineage, so a lost executor costs a re-read and not a re-run, and gives the planner real
    sizes: later joins broadcast the table only when it is small enough.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> bool:
    """Delete one stored table before the session ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables this session stored; DataFrames that read them are void afterwards. Returns their number."""
    return sum(discard(spark, path) for path in _STORED.pop(spark.sparkContext.applicationId, []))
