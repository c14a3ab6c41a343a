"""Structured Streaming forms: arriving events, windows with watermarks, de-duplication, state per session, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .. import sinks
from ..session import exists


def read_folder(spark: SparkSession, folder: str, schema: StructType, glob: str, time: str) -> DataFrame:
    """A file stream; its event time as a timestamp that a watermark accepts (UTC)."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)
    return s.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, time: str, value: str, width: str = "60 seconds", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Windows aligned with the clock, not with a session's first row as in the batch forms."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sliding(stream: DataFrame, time: str, value: str, width: str = "45 seconds", step: str = "5 seconds", late: str = "10 minutes", *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, time: str, gap: str = "30 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First arrivals only, remembered within the watermark.  For all time, use ``foreachBatch`` with an anti join on what is stored."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def intervals(stream: DataFrame, key: str, time: str, late: str | None = "1 hour", keep_s: int = 86_400) -> DataFrame:
    """key, t_us, rr_ms: differences of arriving beats; the last beat of each key is the state.

    Beats of one batch go by time; earlier ones than the state are late and left
    out.  A key without beats for ``keep_s`` of the stream's time is forgotten,
    so the state holds the keys in use only; without ``late`` it is kept for ever.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t = pd.concat([f[time] for f in frames]).sort_values()
        t = t.astype("datetime64[us, UTC]" if t.dt.tz else "datetime64[us]").astype("int64")
        last = state.get[0] if state.exists else None
        if last is not None:
            t = t[t >= last]
        if len(t):
            last_us = int(t.iloc[-1])
            state.update((last_us,))
            if late is not None:
                state.setTimeoutTimestamp(max(last_us // 1000, state.getCurrentWatermarkMs()) + 1000 * keep_s)
            if last is not None:
                t = pd.concat([pd.Series([last]), t])
            yield pd.DataFrame({key: k[0], "t_us": t.iloc[1:], "rr_ms": (t.diff().iloc[1:]) / 1000.0})

    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    rows = stream if late is None else stream.withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, t_us long, rr_ms double", "last long", "append", timeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a Parquet table under ``folder``, beside its state, and returns that table.

    In complete mode every batch writes a table of its own and the last one counts.
    """
    spark = stream.sparkSession
    if mode == "append":
        w = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        w.start(f"{folder}/table").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    done = [None]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/{batch_id}")
        done[0] = batch_id

    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    w.start().awaitTermination()
    if done[0] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table/{done[0]}")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``write`` for every batch that is there; a batch that failed is given again under its number."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_new(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """Adds rows whose key the Parquet table at ``target`` does not hold yet: de-duplication for all time.

    A batch is one partition of the table, replaced if the batch is given
    again, so a repeat changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(spark, target):
            held = spark.read.parquet(target).where(F.col("batch") < batch_id).select(key)
            rows = rows.join(held, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def replace_keys(target: str, key: str, buckets: int = sinks.BUCKETS) -> Callable[[DataFrame, int], None]:
    """Replaces, for every batch, the keys it has rows for in the table at ``target``; a batch whose marker is there is left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.once(batch.sparkSession, target, batch_id, lambda: sinks.replace_sessions(batch, target, key, buckets))

    return write


class Progress(StreamingQueryListener):
    """Keeps the last progress of each running query: rows of the batch, rows a second, batch number."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"batch": None, "rows": 0, "rows_per_second": 0.0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.last[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.last:
            self.last[str(event.id)]["failed"] = event.exception
