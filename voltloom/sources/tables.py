"""Tables of a directory, and the places for intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the cluster names. Only a local master, whose executors
    are one process on this machine, may go without; it gets a folder that is removed at exit."""
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_folder, "own", None)
    if own is None:
        own = shared_folder.own = tempfile.mkdtemp(prefix="voltloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, read from there. Spark removes
    the files of tables that are no longer used where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
