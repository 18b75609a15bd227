"""What the library needs of a session: the shared folder, checkpoints, and checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which :func:`small` marks a side for broadcasting.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (a local session, as in tests) a temporary folder is made and set, which is right only
    because such a session runs on one machine; on a cluster the absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="driftwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into a table in the shared folder, so that several consumers read it and a lost executor costs
    nothing. The table is removed when the driver's Python ends.

    A written table, not a checkpoint: its size is known to the optimizer, whereas a checkpoint carries the estimates of the
    plan it was made by, which square with every join of a loop."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except Exception:  # noqa: BLE001, the JVM may be gone, and what is left is in a scratch folder
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``rows`` rows, else as it is, for a shuffle join.

    The size is checked on at most ``rows + 1`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
