"""Structured Streaming forms: rate limiting, running popularity, ingest, log replay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..workspace import discard, shared_dir, written

LIMIT, WINDOW_US = 60, 60_000_000


def _decide(times: np.ndarray, count: int, start: int | None, limit: int, window_us: int) -> tuple[np.ndarray, int, int | None]:
    """Whether each request (microseconds, ascending) passes; windows open at the first request after the last one's end."""
    out = np.zeros(len(times), bool)
    for i, t in enumerate(times.tolist()):
        if start is None or t - start >= window_us:
            start, count = t, 0
        count += 1
        out[i] = count <= limit
    return out, count, start


def rate_limit(requests: DataFrame, limit: int = LIMIT, window_us: int = WINDOW_US) -> DataFrame:
    """(key, ts, event_id, allowed) of requests (key, ts, event_id); a key's requests in order of time and id.

    A key's decisions depend on one another, so that they are one task's; sorted by Spark they
    pass through it batch by batch, and all it holds of a key is its window's start and count.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, start = None, 0, None
        for b in batches:
            keys, us = b.column("key"), b.column("us").to_numpy()
            rows = keys.to_pylist()
            allowed = np.zeros(len(rows), bool)
            cut = [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]] + [len(rows)]
            for a, e in zip(cut[:-1], cut[1:]):
                if own is None or own[0] != rows[a]:
                    own, count, start = (rows[a],), 0, None
                allowed[a:e], count, start = _decide(us[a:e], count, start, limit, window_us)
            yield pa.RecordBatch.from_arrays([keys, b.column("ts"), b.column("event_id"), pa.array(allowed)], ["key", "ts", "event_id", "allowed"])

    rows = requests.select("key", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kind = dict(requests.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInArrow(decide, f"key {kind['key']}, ts {kind['ts']}, event_id {kind['event_id']}, allowed boolean")


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, window_us: int = WINDOW_US) -> DataFrame:
    """The same over a stream: (count, start) is each key's state; a key unseen for a window's time may start anew."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, start = state.get if state.exists else (0, -1)
        got = list(batches)
        if not got:
            return
        rows = pd.concat(got).sort_values(["us", "event_id"], kind="stable")
        allowed, count, first = _decide(rows["us"].to_numpy(), count, None if start < 0 else start, limit, window_us)
        state.update((count, -1 if first is None else first))
        rows["allowed"] = allowed
        yield rows[["key", "event_id", "allowed"]]

    rows = requests.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kind = dict(requests.dtypes)
    return rows.groupBy("key").applyInPandasWithState(decide, f"key {kind['key']}, event_id {kind['event_id']}, allowed boolean", "count int, start long", "append", "NoTimeout")


def popularity(log: DataFrame) -> DataFrame:
    """Running counts of a query stream, for the complete or update mode."""
    return log.groupBy("query").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window with a watermark (beyond what a query log needs)."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a time with zone
    w = events.groupBy(F.window("ts", size).alias("w"), "query").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "query", "n")


def settled(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream's query has given once all that is there was processed; batches and checkpoint go to the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def ingest(source: DataFrame, target: str, checkpoint: str, wal: str | None = None):
    """Append documents of a stream whose path isn't in the target yet, once for each batch; with ``wal``, after an ADD in the log.

    Of the target only the paths are read.  A batch that is run again after a failure adds nothing twice.
    """
    from ..sources.sinks import _exists

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["path"])
        if _exists(batch.sparkSession, target):
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select("path"), "path", "left_anti")
        if wal:
            fresh = written(fresh, "ingest")
            fresh.select((F.lit(number << 40) + F.monotonically_increasing_id()).alias("seq"), F.lit("ADD").alias("op"), "path").write.mode("append").parquet(wal)
        fresh.write.mode("append").parquet(target)
        discard(fresh)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(wal: DataFrame, apply, checkpoint: str):
    """A log stream (seq, op, path), folded within each batch and handed on: apply(path and op to be done, whether to start anew)."""
    from ..operators.incremental import wal_fold

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        apply(wal_fold(batch), batch.where("op = 'REINDEX'").limit(1).count() > 0)
        batch.unpersist()

    return wal.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
