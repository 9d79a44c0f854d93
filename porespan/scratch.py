"""Storage that driver and executors share for intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or else the context's checkpoint folder. In local mode a folder of our own where
    neither is set; on a cluster that is an error, as no folder of one machine would do."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="porespan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: list[tuple[SparkSession, str]] = []


def table_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table of intermediate results; it goes when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def drop_tables() -> None:
    """Delete the tables made so far; no DataFrame that reads them can be used afterwards."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            to = spark._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
