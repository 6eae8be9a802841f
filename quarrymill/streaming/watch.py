"""Streams over growing logs and events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.curves import parsed_log


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a time with a zone; times without one count as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def metrics(lines: DataFrame) -> DataFrame:
    """M1: the measures of each log line as it comes (file, ord, line); stateless, so G1 itself."""
    return parsed_log(lines)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Extension: counts and sums by window and kind of event; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    counted = _timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Extension: a user's events with no gap between them, as one session."""
    w = F.session_window("ts", gap)
    return _timed(events).withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.unix_timestamp("session_window.start").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """M6: repeated rows of a restarted attempt count once within the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def collapse_gate(snapshots: DataFrame, floor: float, share: float, streak: int = 2) -> DataFrame:
    """M4/M5: snapshots (run string, step long, value double) to (run, step, value, best, fires): the best so far, and whether
    the last `streak` values lie below max(floor, share x the first). State of a run: first value, best, streak, last step.
    A step not after the last one seen is a repeat and is ignored (M6)."""

    def fold(key: Any, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        first, best, low, last = state.get if state.exists else (None, None, 0, -1)
        out = []
        for step, value in sorted((int(s), float(v)) for pdf in batches for s, v in zip(pdf["step"], pdf["value"])):
            if step <= last:
                continue
            first = value if first is None else first
            best = value if best is None else max(best, value)
            low = low + 1 if value < max(floor, share * first) else 0
            last = step
            out.append((key[0], step, value, best, low >= streak))
        state.update((first, best, low, last))
        yield pd.DataFrame(out, columns=["run", "step", "value", "best", "fires"])

    return snapshots.groupBy("run").applyInPandasWithState(fold, "run string, step long, value double, best double, fires boolean", "first double, best double, low int, last long", "append", "NoTimeout")


def stalls(beats: DataFrame, seconds: int = 900) -> DataFrame:
    """M2: (run, stalled): a row for each run that sends nothing for so long by the clock, and one when it comes back."""

    def watch(key: Any, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((True,))
            yield pd.DataFrame([(key[0], True)], columns=["run", "stalled"])
            return
        back = state.exists and state.get[0]
        for _ in batches:
            pass
        state.update((False,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame([(key[0], False)] if back else [], columns=["run", "stalled"])

    return beats.groupBy("run").applyInPandasWithState(watch, "run string, stalled boolean", "stalled boolean", "append", "ProcessingTimeTimeout")


def next_size(size: int, log: str, failures: int, streak: int = 5, least: int = 1) -> int | None:
    """M4: what to try after a failed attempt: two thirds of the size (rounded down) if the log says that memory ran out, the same size
    otherwise; None, to give up, after `streak` failures in a row or below the least size."""
    if failures >= streak:
        return None
    # fixed values: how logs say that memory ran out
    if re.search(r"out of memory|OutOfMemory|Insufficient Memory|MemoryError", log, re.I):
        size = size * 2 // 3
    return size if size >= least else None
