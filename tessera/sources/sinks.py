"""Sinks: query log, write-ahead log, document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import OPS
from ..workspace import delete


def record_query(spark: SparkSession, path: str, query: str) -> None:
    record_queries(spark, path, [query])


def record_queries(spark: SparkSession, path: str, queries: list[str]) -> None:
    """Append to the log; a file for each call, so that a busy server hands over many at a time."""
    spark.createDataFrame([(q,) for q in queries], "value string").coalesce(1).write.mode("append").text(path)


def append_wal(spark: SparkSession, path: str, records: list[tuple[int, str, str]]) -> None:
    """Append (seq, op, path); op is one of ADD, REMOVE and REINDEX."""
    wrong = [r for r in records if r[1] not in OPS]
    if wrong:
        raise ValueError(f"unknown operation {wrong[0][1]!r}")
    spark.createDataFrame(records, "seq long, op string, path string").coalesce(1).write.mode("append").parquet(path)


def save_documents(spark: SparkSession, path: str, changes: DataFrame, most_versions: int = 8) -> None:
    """Upsert on path into a Parquet table: only the changes are written, as a version of their own.

    Reading takes the newest row of each path.  At ``most_versions`` the table is
    written together into one version, and the others are deleted.
    """
    seen = _versions(spark, path)
    number = seen[-1] + 1 if seen else 0
    changes.withColumn("indexed_at", F.current_timestamp()).write.parquet(f"{path}/version={number}")
    if len(seen) + 1 >= most_versions:
        stored_documents(spark, path).write.parquet(f"{path}/version={number + 1}")
        for v in [*seen, number]:
            delete(spark, f"{path}/version={v}")


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each path; of several in one version, any."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c != "version"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*kept), "version").alias("d")).select("d.*")


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not _exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
