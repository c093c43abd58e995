"""Structured Streaming: rate buckets, exactly-once page commits and the leased queue as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lanternfish.operators.jobqueue import STATE, Job


def stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rate_stream(events: DataFrame, time: str, ok: Column, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """(bucket, ok, failed) of tumbling windows; the watermark bounds their state."""
    window = F.window(time, f"{minutes} minutes")
    return events.withWatermark(time, late).groupBy(window).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")).select(F.col("window.start").alias("bucket"), "ok", "failed")


def committed(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writes every batch to a folder of its own number before the offset is committed; a batch that is run again replaces its folder, so a repeat adds nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run(writer: DataStreamWriter, seconds: int = 300) -> None:
    """Runs a stream over what is there now, then ends."""
    query = writer.start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not end")


def queue_stream(events: DataFrame, lease: float = 900.0, most_attempts: int = 8) -> DataFrame:
    """State of each job after every batch that touches it: the state machine of the queue, kept by the stream."""
    columns = [c.split()[0] for c in STATE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(key[0])
        if state.exists:
            held = state.get
            job.state, job.worker, job.attempts, job.produced, job.lease, job.cursor, job.refused = (held[0] or None, held[1] if held[1] >= 0 else None, *held[2:5], held[5] or None, held[6])
        # Chunks of a micro-batch come in no order, so a job's events of one batch are sorted; the files per batch bound them.
        rows = sorted(e for batch in batches for e in batch[["at", "seq", "kind", "worker", "amount", "cursor"]].itertuples(index=False, name=None))
        for at, _, kind, worker, amount, cursor in rows:
            job.apply(kind, worker, amount, at, lease, most_attempts, cursor)
        state.update((job.state or "", -1 if job.worker is None else int(job.worker), job.attempts, job.produced, job.lease, job.cursor or "", job.refused))
        yield pd.DataFrame([job.row()], columns=columns).astype({"worker": "Int64"})

    return events.groupBy("job").applyInPandasWithState(step, STATE, "state string, worker long, attempts int, produced double, lease double, cursor string, refused int", "update", "NoTimeout")


def history(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Appends the rows of every batch to a history of JSON lines. A batch has a folder of its own, so one that is run again adds nothing twice."""

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{folder}/batch={number}")

    return df.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True)


def batches(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("batch=*"))
