"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names in spark.checkpoint.dir. A folder of our own serves only where that is unset and all
    tasks run in this process, as in tests; on a cluster that is an error, since executors can't share a machine's folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.match(r"local(\[|$)", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quarry-checkpoint"))


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, so that a plan used several times is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the checkpoint folder and read back: compressed, and later reads take only their columns.

    Survives lost executors like a checkpoint. The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_stored)
    _WRITTEN.append((spark, path))
    return spark.read.parquet(path)


def stored_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; the tables that were stored while it was made and run are removed at once, where those of stored() stay
    as long as the session. Only for frames that nothing but the result reads."""
    first = len(_WRITTEN)
    out = stored(make())
    for spark, path in _WRITTEN[first:-1]:
        _remove(spark, path)
    del _WRITTEN[first:-1]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_stored() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended already
            return
