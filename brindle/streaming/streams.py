"""Structured Streaming jobs; each takes a batch frame as well, so that a stream can be held against its batch twin (K1-K5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .breakers import failure_runs


def ingest(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records without exact re-deliveries inside the watermark (K1). The best of each fingerprint is chosen by the upsert."""
    keys = ["dataset_fingerprint", "metadata_completeness", "canonical_id"]
    return records.withWatermark("ingestion_timestamp", late).dropDuplicatesWithinWatermark(keys) if records.isStreaming else records.dropDuplicates(keys)


def write_upserts(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch to ``merge`` (K1); batches are numbered, so a repeated one can be told."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(events: DataFrame, ts: str, by: str, value: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events, sums and means in tumbling or sliding windows (K2, K3); later rows than the watermark are dropped."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, late) if d.isStreaming else d
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return d.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean")).select(F.col("w.start").alias("window_start"), by, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n): runs of events closer than ``gap`` (K4)."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, late) if d.isStreaming else d
    return d.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def failure_streaks(events: DataFrame, by: str, ts: str, failed: str, key: str, opens: int = 3) -> DataFrame:
    """(by, first, last, length) of runs of consecutive failures of at least ``opens`` (K5), from prefix sums over ranges of time."""
    runs = failure_runs(events, by, ts, failed, key).filter(F.col("length") >= opens)
    return runs.select(F.col("source").alias(by), F.col("first"), F.col("last"), "length")


def stream_streaks(events: DataFrame, by: str, opens: int = 3) -> DataFrame:
    """Open and recovered states of each source, in order of arrival (K5). ``events`` has ts, failed and the source column."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n, is_open) = state.get if state.exists else (0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, failed in zip(rows["ts"], rows["failed"], strict=True):
            n = n + 1 if failed else 0
            if failed and n >= opens and not is_open:
                is_open = True
                out.append((key[0], ts, "open", n))
            elif not failed and is_open:
                is_open = False
                out.append((key[0], ts, "recovered", 0))
        state.update((n, is_open))
        yield pd.DataFrame(out, columns=["source", "ts", "status", "streak"])

    d = events.select(F.col(by).cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "failed")
    return d.groupBy("source").applyInPandasWithState(step, "source string, ts timestamp, status string, streak int", "n int, is_open boolean", "append", "NoTimeout")
