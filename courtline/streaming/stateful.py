"""Streaming forms of folds and windowed counts; each batch is sorted by time, rows older than the state are dropped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in one of our own only if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="courtline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ema_stream(points: DataFrame, alpha: float) -> DataFrame:
    """(track_id, t, frame, ema) after each batch's last point, from a stream of (track_id, t, frame, px)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_frame, value = state.get if state.exists else (float("-inf"), -1, None)
        rows = pd.concat(parts).sort_values(["t", "frame"])
        for t, frame, x in zip(rows.t, rows.frame, rows.px, strict=True):
            if (t, frame) > (last_t, last_frame):
                value = x if value is None else alpha * x + (1 - alpha) * value
                last_t, last_frame = float(t), int(frame)
        state.update((last_t, last_frame, value))
        yield pd.DataFrame({"track_id": [key[0]], "t": [last_t], "frame": [last_frame], "ema": [value]})

    out, kept = "track_id bigint, t double, frame bigint, ema double", "t double, frame bigint, ema double"
    return points.groupBy("track_id").applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows a window and key; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and gives what it emitted, as a table in the shared folder.

    Batches are written under their number, so that a batch that is run again replaces itself.
    """
    spark, path = stream.sparkSession, folder(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", folder(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
