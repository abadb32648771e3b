"""Streaming ingestion: a watched folder of Parquet files, count-based chunks, idle flush, running histograms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema: str, most_files: int = 5, pattern: str = "*.parquet") -> DataFrame:
    """New files of the folder, `most_files` a batch; the checkpoint keeps what has been seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("pathGlobFilter", pattern).parquet(folder)


def chunked(records: DataFrame, least: int, idle: str = "10 minutes", key: str = "source") -> DataFrame:
    """Chunks of records (key, record_id, n, ...): records are taken in order until the sum of n exceeds `least` (the crossing record is in); after the idle time the rest becomes a last chunk.

    The state of a key is its open chunk alone: number, records, sum.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ids, total = state.get if state.exists else (1, [], 0)
        ids = list(ids)
        out = []
        if state.hasTimedOut:
            if ids:
                out.append((k[0], number, ids, total, True))
            state.remove()
        else:
            for part in parts:
                for i, n in part.sort_values("record_id")[["record_id", "n"]].itertuples(index=False):
                    ids.append(int(i))
                    total += int(n)
                    if total > least:
                        out.append((k[0], number, ids, total, False))
                        number, ids, total = number + 1, [], 0
            state.update((number, ids, total))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["key", "chunk", "records", "total", "final"])

    return records.groupBy(key).applyInPandasWithState(step, "key string, chunk int, records array<long>, total long, final boolean", "number int, ids array<long>, total long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def chunks_of(records: DataFrame, least: int, key: str = "source") -> DataFrame:
    """The same chunks over a batch, a key's records in order; the rest is a last chunk."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out, ids, total, number = [], [], 0, 1
        for i, n in part.sort_values("record_id")[["record_id", "n"]].itertuples(index=False):
            ids.append(int(i))
            total += int(n)
            if total > least:
                out.append((part[key].iloc[0], number, ids, total, False))
                number, ids, total = number + 1, [], 0
        if ids:
            out.append((part[key].iloc[0], number, ids, total, True))
        return pd.DataFrame(out, columns=["key", "chunk", "records", "total", "final"])

    return records.select(key, "record_id", "n").groupBy(key).applyInPandas(fold, "key string, chunk int, records array<long>, total long, final boolean")


def sessions(events: DataFrame, gap: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Runs of events of a user with no longer pause than the gap."""
    return events.groupBy(by, F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("begin"), F.max("ts").alias("last")).drop("w")


def rates(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and mean value of each type by time window; `late` sets a watermark for streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("begin"), "event_type", "n", "mean")
