"""The job log as a stream: status per job, event-time counts, and the same results in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.sources.stages import new_table

#: Statuses that a job can have, by the events that set them (fixed values).
STATUS = {"view": "queued", "click": "running", "purchase": "done"}


def status_of(c):
    out = F.lit("canceled")
    for event, name in STATUS.items():
        out = F.when(c == event, name).otherwise(out)
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and status; the watermark bounds the state."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), status_of(F.col("event_type")).alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "status", "n")


def latest_status(log: DataFrame) -> DataFrame:
    """Last write wins: the status of the newest event of each job, as a stateful stream (update mode)."""

    def newest(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (0, -1, "")
        for part in rows:
            for ts, event, status in zip(part["us"], part["event_id"], part["status"], strict=True):
                at = max(at, (int(ts), int(event), str(status)))
        state.update(at)
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [at[1]], "status": [at[2]]})

    rows = log.select("user_id", "event_id", F.unix_micros("ts").alias("us"), status_of(F.col("event_type")).alias("status"))
    return rows.groupBy("user_id").applyInPandasWithState(newest, "user_id long, event_id long, status string", "us long, event_id long, status string", "update", GroupStateTimeout.NoTimeout)


def latest_status_batch(log: DataFrame) -> DataFrame:
    last = log.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", status_of(F.col("event_type")).alias("status"))).alias("m"))
    return last.select("user_id", "m.event_id", "m.status")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run the stream over what is there now; its result as tables that executors write in the shared folder: the last batch's in complete mode, else those of all."""
    spark = stream.sparkSession
    paths: list[str] = []

    def keep(batch: DataFrame, _: int) -> None:
        paths.append(new_table(spark, name))
        batch.write.parquet(paths[-1])

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))
