"""Registered queries: a Spark builder and, where SQL can say it, the equivalent SQL text.

``cols`` lists the result columns; ``name:6`` rounds a double to 6 decimals on both sides so
that summation order does not matter, ``name:int`` makes both sides 32-bit integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import expr
from residua.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None
    cols: tuple[tuple[str, str | None], ...]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[_shaped(c, d).alias(c) for c, d in self.cols])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        outs = [
            c if d is None else f"{c}::INTEGER AS {c}" if d == "int" else f"round({c}::DOUBLE, {d}) + 0.0 AS {c}"
            for c, d in self.cols
        ]
        return f"SELECT {', '.join(outs)} FROM ({self.sql}) q"


def _shaped(column: str, form: str | None) -> Column:
    c = expr.col(column)
    if form is None:
        return c
    return c.cast("int") if form == "int" else F.round(c.cast("double"), int(form)) + F.lit(0.0)


class Tables:
    """The input tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A fresh folder in the shared checkpoint location."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"

    def order_frame(self) -> DataFrame:
        """Orders with their customer: the keyed frame most model queries use."""
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))

    def event_frame(self) -> DataFrame:
        """Events with a residual that is planted to depend on the event type."""
        planted = F.when(F.col("event_type") == "purchase", 100.0).otherwise(0.0)
        return self.events.withColumn("residual", F.col("value") + planted)


ORDER_FRAME = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
EVENT_FRAME = (
    "(SELECT *, value + CASE WHEN event_type = 'purchase' THEN 100.0 ELSE 0.0 END AS residual FROM events)"
)

CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, cols: str, sql: str | None = None):
    """Register a builder under a name; ``covers`` names the operators it exercises."""
    parsed = tuple(
        (c.split(":")[0], c.split(":")[1] if ":" in c else None) for c in cols.split()
    )

    def add(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, covers, build, sql, parsed)
        return build

    return add


def uniform_sql(key: str, salt: str, slot: int = 0) -> str:
    """SQL twin of ``hashing.draw(digest(key, salt), slot)``."""
    return f"(('0x' || substr(md5({key} || ':{salt}'), {8 * slot + 1}, 8))::BIGINT / 4294967296.0)"


def fold_sql(key: str, seed: int = 42, k: int = 5) -> str:
    return f"floor({uniform_sql(key, f'fold{seed}')} * {k})::INT"
