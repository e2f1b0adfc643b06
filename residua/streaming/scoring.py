"""Score a stream with stored rules: the batch projection, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from residua.operators.rules import Rule, apply_rules


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files arriving in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).parquet(folder)
    )


def score_stream(stream: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    return apply_rules(stream, rules, keep)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there and stop."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
