"""Circuit breakers over a log of calls, as a batch job and as a stream with event-time timers (K5).

A breaker is closed; after ``opens`` failures in a row it is open, and calls are turned away, so their results don't
count. After the recovery time a probe is due; the first call from then on is let through (half open): if it succeeds,
the breaker is closed again, else it is open anew from then on.

Both forms return (source, ts, status): ``open``, ``probe_due``, ``half_open`` and ``closed``, each once for each change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stages import first_after, ranged, running, staged

SCHEMA = "source string, ts timestamp, status string"


def _calls(events: DataFrame, by: str, ts: str, failed: str, key: str) -> DataFrame:
    return events.select(F.col(by).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("at"), F.col(key).alias("key"), F.col(failed).alias("failed"))


def failure_runs(events: DataFrame, by: str, ts: str, failed: str, key: str) -> DataFrame:
    """(source, start, first, last, length): runs of consecutive failures; ``start`` is the number of the first call.

    Calls are split into ranges of source and time, numbers of calls and of successes are prefix sums over the ranges,
    and runs are groups of failures with as many successes before them: no source is gathered in one task.
    """
    order = ["at", "key"]
    parts = ranged(_calls(events, by, ts, failed, key), "source", *order)
    numbered = running(parts, ["source"], order, F.when(F.col("failed"), 0).otherwise(1).cast("long"), "run")
    numbered = running(numbered, ["source"], order, F.lit(1).cast("long"), "pos")
    runs = numbered.filter("failed").groupBy("source", "run")
    return runs.agg(F.min("pos").alias("start"), F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("length")).drop("run")


def transitions(events: DataFrame, by: str, ts: str, failed: str, key: str, opens: int = 3, recovery: str = "60 seconds", until: str | Column | None = None) -> DataFrame:
    """Changes of state of each source's breaker, from a table of calls; ``until`` is the time up to which the log reaches.

    The state machine is a chain of openings. From each failure on that could be an opening, two lookups lead to the
    next one: the first call after the recovery time, and, if that call succeeds, the first call after it that ends
    ``opens`` failures in a row. Both are found for all failures at once, over ranges of time. Which of them are
    openings is then found by doubling: each round takes twice as many links at a time.
    """
    wait, order = F.expr(f"INTERVAL {recovery}"), ["at", "key"]
    parts = ranged(_calls(events, by, ts, failed, key), "source", *order)
    rows = running(parts, ["source"], order, F.when(F.col("failed"), 0).otherwise(1).cast("long"), "run")
    rows = staged(running(rows, ["source"], order, F.lit(1).cast("long"), "pos"))
    ends = rows.filter("failed").groupBy("source", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= opens).select("source", (F.col("start") + (opens - 1)).alias("pos"), F.lit(True).alias("opening"))
    rows = staged(rows.join(ends, ["source", "pos"], "left").withColumn("opening", F.coalesce("opening", F.lit(False))))
    rows = staged(first_after(rows, ["source"], order, F.when(F.col("opening"), F.col("pos")), "next_opening"))

    # the first call from the recovery time on: questions and calls in one order, questions before calls of their time
    asks = rows.filter("failed").select("source", (F.col("at") + wait).alias("at"), F.lit(0).alias("kind"), "key", "pos", F.lit(None).cast("boolean").alias("failed"), F.lit(None).cast("long").alias("next_opening"))
    calls = rows.select("source", "at", F.lit(1).alias("kind"), "key", "pos", "failed", "next_opening")
    both = ranged(asks.unionByName(calls), "source", "at", "kind", "key")
    call = F.when(F.col("kind") == 1, F.struct("pos", "at", "failed", "next_opening"))
    asked = first_after(both, ["source"], ["at", "kind", "key"], call, "probe").filter("kind = 0")
    nodes = staged(asked.select("source", "pos", (F.col("at") - wait).alias("opened"), F.col("at").alias("due"), "probe", F.when(F.col("probe.failed"), F.col("probe.pos")).otherwise(F.col("probe.next_opening")).alias("next")))

    reached = staged(rows.filter("opening").groupBy("source").agg(F.min("pos").alias("pos")))
    links = nodes.filter("next IS NOT NULL").select("source", "pos", "next")
    known = 0
    while (n := reached.count()) > known:
        known = n
        further = reached.join(links, ["source", "pos"]).select("source", F.col("next").alias("pos"))
        reached = staged(reached.unionByName(further).distinct())
        then = links.select("source", F.col("pos").alias("next"), F.col("next").alias("after"))
        links = staged(links.join(then, ["source", "next"]).select("source", "pos", F.col("after").alias("next")))

    on = nodes.join(reached, ["source", "pos"])
    probed = F.col("probe").isNotNull()
    late = F.lit(False) if until is None else F.col("due") <= (F.lit(until).cast("timestamp") if isinstance(until, str) else until)
    said = [
        F.struct(F.col("opened").alias("ts"), F.lit("open").alias("status")), F.when(probed | late, F.struct(F.col("due").alias("ts"), F.lit("probe_due").alias("status"))),
        F.when(probed, F.struct(F.col("probe.at").alias("ts"), F.lit("half_open").alias("status"))), F.when(probed & ~F.col("probe.failed"), F.struct(F.col("probe.at").alias("ts"), F.lit("closed").alias("status"))),
    ]
    return on.select("source", F.explode(F.array_compact(F.array(*said))).alias("s")).select("source", "s.*")


STATE = "fails int, opened long, due boolean, at array<long>, key array<long>, failed array<boolean>"


def _step(opens: int, wait: int):
    """The state machine of one source over the calls that the watermark has passed; later ones wait in the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fails, opened, due, *held = state.get if state.exists else (0, -1, False, [], [], [])
        calls = list(zip(*held, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                calls += zip((rows["at"].astype("int64") // rows["unit"]).tolist(), rows["key"].tolist(), rows["failed"].tolist(), strict=True)
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        calls.sort()
        passed = [c for c in calls if c[0] <= mark]
        for at, _, failed in passed:
            if opened < 0:
                fails = fails + 1 if failed else 0
                if fails >= opens:
                    opened, due = at, False
                    out.append((at, "open"))
            elif at >= opened + wait:
                out += [(at, "half_open")] if due else [(opened + wait, "probe_due"), (at, "half_open")]
                if failed:
                    opened, due = at, False
                    out.append((at, "open"))
                else:
                    opened, fails = -1, 0
                    out.append((at, "closed"))
        if opened >= 0 and not due and opened + wait <= mark:  # the timer of an open breaker
            due = True
            out.append((opened + wait, "probe_due"))
        calls = calls[len(passed) :]
        state.update((fails, opened, due, *([list(c) for c in zip(*calls, strict=True)] or [[], [], []])))
        wakes = [c[0] for c in calls[:1]] + ([opened + wait] if opened >= 0 and not due else [])
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes) // 1000, mark // 1000) + 1)
        yield pd.DataFrame({"source": [key[0]] * len(out), "ts": pd.to_datetime([t for t, _ in out], unit="us"), "status": [s for _, s in out]})

    return run


def stream_transitions(events: DataFrame, by: str, ts: str, failed: str, key: str, opens: int = 3, recovery_seconds: float = 60.0, late: str = "1 hour") -> DataFrame:
    """The same changes from a stream of calls, in event time (K5).

    Calls wait in the state until the watermark has passed them, so they are taken in order however they arrive; a timer
    at the end of the recovery time tells that a probe is due, without a call. ``key`` is a long that orders calls of one time.
    """
    d = _calls(events, by, ts, failed, key).withColumns({"key": F.col("key").cast("long"), "unit": F.lit(1000).cast("long")}).withWatermark("at", late)
    return d.groupBy("source").applyInPandasWithState(_step(opens, round(recovery_seconds * 1e6)), SCHEMA, STATE, "append", "EventTimeTimeout")
