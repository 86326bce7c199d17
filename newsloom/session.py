"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that runs it from a source
    tree. Needless where it is installed on the executors."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom"),
        "zip",
        root_dir=os.path.dirname(here),
        base_dir=os.path.basename(here),
    )
    context.addPyFile(archive)
    context._newsloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or the session's
    checkpoint directory. Only where neither is set and all tasks run inside the driver
    (`local` or `local[...]`, not `local-cluster`) a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(context, "_newsloom_folder"):
        context._newsloom_folder = tempfile.mkdtemp(prefix="newsloom-")
    return context._newsloom_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write `df` to the shared folder, in folders by the columns `partitions`, and read it back.

    Used where a plan is read more than once or must not be computed twice, such as
    model responses. The copy outlives lost executors, until `discard`.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partitions).parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._newsloom_path = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Remove what `materialize` wrote. Frames that still read it must be done by then."""
    for copy in copies:
        spark = copy.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(copy._newsloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
