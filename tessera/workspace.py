"""Tables written between steps, in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  A session on one machine (tests) that names none gets one of its own; on a cluster that is an error."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CONF} must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.__dict__["_written"] = path
    return again


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing will read any more."""
    for t in tables:
        if path := t.__dict__.pop("_written", None):
            delete(t.sparkSession, path)


def passed_on(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, which is all that reads the written table ``source``, to be discarded in its place."""
    if path := source.__dict__.pop("_written", None):
        df.__dict__["_written"] = path
    return df


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder: results that weren't written elsewhere can't be read after it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}-*")
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ():
        delete(spark, f.getPath().toString())
