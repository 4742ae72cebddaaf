"""Session settings that the core jobs want."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, with the same settings but one; the caller's stays as it is.

    Feature tables have some seventy computed columns with filters between them.  Spark's constraint
    propagation derives a constraint for every combination of such aliases and predicates, and planning then
    takes minutes; Spark documents this setting for that case.  Core jobs filter nulls themselves."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return own


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where a local session names none, a folder of
    its own is made, set as the checkpoint folder and removed at exit; any other session gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="wattloom-core-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back: what is used often is computed once, and lineage ends here."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
