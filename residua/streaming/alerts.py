"""Windowed alert rules.  Each works on a batch table and on a stream; on a stream the caller's
watermark bounds the state to the open windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from residua.functions.quantiles import grouped_quantiles


def watermarked(df: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp with a lateness bound."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _start(window: str = "window") -> list[Column]:
    return [F.col(f"{window}.start").alias("window_start")]


def failure_ratio(df: DataFrame, failed: Column, window: str = "15 minutes", slide: str = "5 minutes", threshold: float = 0.1, time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Share of failed rows per (sliding) window and whether it exceeds the threshold."""
    t = F.col(time).cast("timestamp")
    counted = df.groupBy(F.window(t if not df.isStreaming else F.col(time), window, slide), *(by or [])).agg(
        F.count("*").alias("total"), F.count_if(failed).alias("failed")
    )
    ratio = F.col("failed") / F.col("total")
    return counted.select(*_start(), *(by or []), "total", "failed", ratio.alias("ratio"), (ratio > threshold).alias("firing"))


def rate(df: DataFrame, window: str = "5 minutes", seconds: int = 300, threshold: float = 1.0, time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Rows per second in tumbling windows and whether the rate exceeds the threshold."""
    t = F.col(time) if df.isStreaming else F.col(time).cast("timestamp")
    counted = df.groupBy(F.window(t, window), *(by or [])).agg(F.count("*").alias("total"))
    r = F.col("total") / float(seconds)
    return counted.select(*_start(), *(by or []), "total", r.alias("rate"), (r > threshold).alias("firing"))


def window_sum(df: DataFrame, value: str, window: str = "1 hour", budget: float = 100.0, time: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Sum per window and whether it is over budget."""
    t = F.col(time) if df.isStreaming else F.col(time).cast("timestamp")
    summed = df.groupBy(F.window(t, window), *(by or [])).agg(F.sum(value).alias("amount"))
    return summed.select(*_start(), *(by or []), "amount", (F.col("amount") > budget).alias("firing"))


def p95(df: DataFrame, value: str, by: list[str], window: str = "30 minutes", threshold: float = 100.0, time: str = "ts") -> DataFrame:
    """95th percentile per group and window: exact on batch tables (a heavy group is cut into
    value ranges), a bounded-size sketch on streams."""
    t = F.col(time) if df.isStreaming else F.col(time).cast("timestamp")
    start = F.window(t, window)
    if df.isStreaming:
        out = df.groupBy(start, *by).agg(F.percentile_approx(value, 0.95, 10_000).alias("p95"))
        return out.select(*_start(), *by, "p95", (F.col("p95") > threshold).alias("firing"))
    keyed = df.withColumn("window_start", start["start"])
    out = grouped_quantiles(keyed, ["window_start", *by], value, {"p95": 0.95})
    return out.withColumn("firing", F.col("p95") > threshold)


def sustained(flags: DataFrame, step_seconds: int, min_seconds: int, by: list[str], start: str = "window_start", firing: str = "firing") -> DataFrame:
    """Unbroken runs of firing windows that last at least ``min_seconds``.

    ``flags`` is a windowed aggregate (one row per group and window), so the windows below run
    over time steps, not events."""
    per = Window.partitionBy(*by).orderBy(start)
    on = flags.where(F.col(firing)).withColumn("__t", F.unix_timestamp(F.col(start).cast("timestamp")))
    fresh = F.when(F.col("__t") - F.lag("__t").over(per) == step_seconds, 0).otherwise(1)
    runs = on.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(per))
    length = F.max("__t") - F.min("__t") + step_seconds
    return (
        runs.groupBy(*by, "__run")
        .agg(F.min(start).alias("run_start"), F.count("*").alias("windows"), length.alias("seconds"))
        .where(F.col("seconds") >= min_seconds).drop("__run")
    )


SUSTAINED_STATE = "run_start long, last long, windows int, times array<long>, flags array<boolean>"


def sustained_stream(flags: DataFrame, step_seconds: int, min_seconds: int, by: str, start: str = "window_start", firing: str = "firing", delay: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``sustained``: emits a row when a run reaches ``min_seconds``.

    Flags (one per group and step) may come in any order and in any number of micro-batches, late by ``delay`` at
    most.  State per group is one open run and the flags that
    the watermark has not passed yet; an event-time timer takes them up in order of time once it has.  A
    repeated flag counts once, the last one seen.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        run_start, last, windows, times, on = state.get if state.exists else (0, -1, 0, [], [])
        open_flags = dict(zip(times, on))
        for rows in batches:
            open_flags.update(zip(rows["t"].tolist(), rows["on"].tolist()))
        passed = state.getCurrentWatermarkMs()
        out = []
        for t in sorted(t for t in open_flags if t * 1000 < passed):
            if not open_flags.pop(t):
                run_start, last, windows = 0, -1, 0
                continue
            if windows and t - last == step_seconds:
                windows += 1
            else:
                run_start, windows = t, 1
            last = t
            seconds = last - run_start + step_seconds
            if seconds >= min_seconds and seconds - step_seconds < min_seconds:
                out.append((key[0], pd.Timestamp(run_start, unit="s"), windows, seconds))
        waiting = sorted(open_flags)
        state.update((int(run_start), int(last), int(windows), [int(t) for t in waiting], [bool(open_flags[t]) for t in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(passed, waiting[0] * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=[by, "run_start", "windows", "seconds"])

    timed = flags.withColumn("__start", F.col(start).cast("timestamp")).withWatermark("__start", delay)
    rows = timed.select(by, "__start", F.unix_timestamp("__start").alias("t"), F.col(firing).alias("on"))
    kind = flags.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, run_start timestamp, windows int, seconds long", SUSTAINED_STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )
