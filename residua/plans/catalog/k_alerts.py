"""Windowed alerts and streams over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators.rules import Rule
from residua.plans.catalog.registry import Tables, query
from residua.streaming import alerts, scoring

STREAM_RULES = [
    Rule("high", "numeric_bin", {"column": "value", "lower": 100.0, "upper": float("inf")}),
    Rule("error", "categorical", {"column": "event_type", "value": "error"}),
    Rule("near", "cluster", {"center": {"value": 50.0}}),
]


def event_stream(t: Tables) -> DataFrame:
    return scoring.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def drain(t: Tables, stream: DataFrame) -> DataFrame:
    """Run a stream over everything available and read its output table."""
    root = t.scratch()
    scoring.run_to_table(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "stream_scores", "K1 H28", "event_id high:1 error:1 near:6",
    "SELECT event_id, (value > 100)::INT AS high, (event_type = 'error')::INT AS error, 1 / (1 + abs(value - 50)) AS near FROM events",
)
def stream_scores(t: Tables) -> DataFrame:
    return drain(t, scoring.score_stream(event_stream(t), STREAM_RULES, ["event_id"]))


FAIL_SQL = """(WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) - o * INTERVAL '5 minutes' AS ws, event_type FROM events, (SELECT unnest([0, 1, 2]) AS o))
  SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') / count(*) AS ratio,
    count(*) FILTER (event_type = 'error') / count(*) > 0.1 AS firing FROM w GROUP BY ws)"""


def _text(df: DataFrame, c: str = "window_start") -> DataFrame:
    return df.withColumn(c, F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"))


@query("failure_ratio", "K2", "window_start total failed ratio:6 firing", f"SELECT * FROM {FAIL_SQL}")
def failure_ratio(t: Tables) -> DataFrame:
    return _text(alerts.failure_ratio(t.events, F.col("event_type") == "error"))


@query(
    "failure_ratio_stream", "K2", "closed_windows_match windows_ok", "SELECT true AS closed_windows_match, true AS windows_ok",
)
def failure_ratio_stream(t: Tables) -> DataFrame:
    """Windows the stream has closed, compared with the batch twin."""
    stream = alerts.failure_ratio(alerts.watermarked(event_stream(t)), F.col("event_type") == "error")
    closed, batch = drain(t, stream), alerts.failure_ratio(t.events, F.col("event_type") == "error")
    same = closed.join(batch.withColumnRenamed("total", "n").withColumnRenamed("failed", "f").select("window_start", "n", "f"), "window_start", "left")
    return same.agg(
        (F.count_if((F.col("total") == F.col("n")) & (F.col("failed") == F.col("f"))) == F.count("*")).alias("closed_windows_match"),
        (F.count("*") > 0).alias("windows_ok"),
    )


@query(
    "event_rate", "K3", "window_start event_type total rate:6 firing",
    """SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS total, count(*) / 600.0 AS rate, count(*) / 600.0 > 0.002 AS firing FROM events GROUP BY 1, 2""",
)
def event_rate(t: Tables) -> DataFrame:
    return _text(alerts.rate(t.events, "10 minutes", 600, 0.002, by=["event_type"]))


@query(
    "p95_window", "K4", "window_start event_type p95:4 firing",
    """SELECT strftime(time_bucket(INTERVAL '30 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.95) > 100 AS firing FROM events GROUP BY 1, 2""",
)
def p95_window(t: Tables) -> DataFrame:
    return _text(alerts.p95(t.events, "value", ["event_type"]))


@query(
    "hourly_budget", "K5", "window_start amount:4 firing",
    "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, sum(value) AS amount, sum(value) > 800 AS firing FROM events GROUP BY 1",
)
def hourly_budget(t: Tables) -> DataFrame:
    return _text(alerts.window_sum(t.events, "value", "1 hour", 800.0))


SUSTAINED_SQL = """(WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, event_type, count(*) / 3600.0 > 0.0006 AS firing FROM events GROUP BY 1, 2),
  g AS (SELECT *, ws - row_number() OVER (PARTITION BY event_type ORDER BY ws) * INTERVAL '1 hour' AS island FROM w WHERE firing)
  SELECT event_type, strftime(min(ws), '%Y-%m-%d %H:%M:%S') AS run_start, count(*) AS windows, count(*) * 3600 AS seconds FROM g GROUP BY event_type, island HAVING count(*) * 3600 >= 7200)"""


def hourly_flags(df: DataFrame) -> DataFrame:
    return alerts.rate(df, "1 hour", 3600, 0.0006, by=["event_type"])


@query("sustained_condition", "K6", "event_type run_start windows seconds", f"SELECT * FROM {SUSTAINED_SQL}")
def sustained_condition(t: Tables) -> DataFrame:
    return _text(alerts.sustained(hourly_flags(t.events), 3600, 7200, ["event_type"]), "run_start")


@query("sustained_stream", "K6", "event_type run_start windows:int", f"SELECT event_type, run_start, 2 AS windows FROM {SUSTAINED_SQL}")
def sustained_stream(t: Tables) -> DataFrame:
    """The stateful twin: a closed-window stream of flags, then one open run per group.  The flags come in files
    dealt by a hash, several micro-batches of them; a last flag far ahead lets the watermark pass all others."""
    flags = hourly_flags(t.events)
    end = flags.agg(F.max("window_start").alias("m")).select(F.lit("end").alias("event_type"), (F.col("m") + F.expr("INTERVAL 60 DAYS")).alias("window_start"), F.lit(False).alias("firing"))
    root = t.scratch()
    flags.select("event_type", "window_start", "firing").repartition(6, F.xxhash64("window_start", "event_type")).write.parquet(f"{root}/flags")
    end.write.mode("append").parquet(f"{root}/flags")
    stream = scoring.read_stream(t.spark, f"{root}/flags", end.schema, files_per_batch=3)
    return _text(drain(t, alerts.sustained_stream(stream, 3600, 7200, "event_type", delay="45 days")), "run_start")


@query(
    "failure_ratio_closed", "K2", "window_start total failed",
    f"""SELECT window_start, total, failed FROM {FAIL_SQL} WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL '15 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
)
def failure_ratio_closed(t: Tables) -> DataFrame:
    """What a stream has written once it has read all: the windows that its watermark has passed."""
    stream = alerts.failure_ratio(alerts.watermarked(event_stream(t)), F.col("event_type") == "error")
    return _text(drain(t, stream))
