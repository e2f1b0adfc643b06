"""Column fingerprints, version diffs and what they mean for stored rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import expr
from residua.session import durable, spread

NULL_MARK = "\x00<<NULL>>\x00"
RENAME_MAX_DISTANCE = 2
# Event kinds and compatibility levels; fixed strings of the contract.
REVIEW_KINDS = ["retype", "value_change", "rename_candidate"]
BREAKING_KINDS = ["drop"]


def additive_fingerprint(value: Column) -> Column:
    """Order-insensitive digest of a column: count, nulls and sums of two 60-bit md5 words.  Each sum
    is exact in decimal arithmetic and combines map-side, so no sort is needed."""
    text = F.coalesce(value.cast("string"), F.lit(NULL_MARK))
    hexed = F.md5(text.cast("binary"))
    words = [
        F.sum(F.conv(F.substring(hexed, 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")) for i in range(2)
    ]
    parts = [F.count(F.lit(1)).cast("string"), F.count_if(value.isNull()).cast("string")]
    parts += [F.coalesce(w.cast("decimal(38,0)").cast("string"), F.lit("0")) for w in words]
    return F.sha2(F.concat_ws(":", *parts), 256)


def snapshot(df: DataFrame, version: int) -> DataFrame:
    """(column_name, dtype, value_hash, version, position) of every column, in one aggregation."""
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            additive_fingerprint(expr.col(f.name)).alias("value_hash"),
            F.lit(version).alias("version"),
            F.lit(i).alias("position"),
        ).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    wide = spread(df).agg(*entries)
    return wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(entries))])).alias("s")).select("s.*")


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two texts differ; the longer length when lengths differ."""
    differing = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
            lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)),
        )
    )
    return (
        F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b)))
        .when(a == b, F.lit(0))
        .otherwise(differing)
    )


def classify(prev: DataFrame, curr: DataFrame, max_distance: int = RENAME_MAX_DISTANCE) -> DataFrame:
    """Events between two snapshots: ok, retype, value_change, rename_candidate, drop, add.

    Snapshots hold one row per column, so these joins are over metadata; they are materialised
    first so that the hashed tables are read once.
    """
    prev, curr = durable(prev), durable(curr)
    p = prev.select(
        F.col("column_name").alias("pn"), F.col("dtype").alias("pt"),
        F.col("value_hash").alias("ph"), F.col("position").alias("pp"),
    )
    c = curr.select(
        F.col("column_name").alias("cn"), F.col("dtype").alias("ct"),
        F.col("value_hash").alias("ch"), F.col("position").alias("cp"),
    )
    both = p.join(c, p.pn == c.cn, "full_outer")
    lost = both.where(F.col("cn").isNull()).select("pn", "pt", "ph", "pp")
    new = both.where(F.col("pn").isNull()).select("cn", "ct", "ch", "cp")
    # candidate pairs share the type; the nearest free column wins, earliest first
    pairs = (
        lost.join(new, F.col("pt") == F.col("ct"))
        .withColumn("distance", hamming(F.col("ph"), F.col("ch")))
        .where(F.col("distance") <= max_distance)
    )
    first_new = Window.partitionBy("pn").orderBy("distance", "cp")
    first_old = Window.partitionBy("cn").orderBy("pp")
    # equal hashes pair up rank by rank, which is what first-come matching gives
    slot_old = Window.partitionBy("pt", "ph").orderBy("pp")
    slot_new = Window.partitionBy("ct", "ch").orderBy("cp")
    exact = (
        lost.withColumn("slot", F.row_number().over(slot_old))
        .join(
            new.withColumn("slot_n", F.row_number().over(slot_new)),
            (F.col("pt") == F.col("ct")) & (F.col("ph") == F.col("ch")) & (F.col("slot") == F.col("slot_n")),
        )
        .select("pn", "cn")
    )
    near = (
        pairs.join(exact.select("pn"), "pn", "left_anti")
        .join(exact.select("cn"), "cn", "left_anti")
        .withColumn("r", F.row_number().over(first_new))
        .where(F.col("r") == 1)
        .withColumn("s", F.row_number().over(first_old))
        .where(F.col("s") == 1)
        .select("pn", "cn")
    )
    renames = exact.unionByName(near)
    matched = both.where(F.col("pn").isNotNull() & F.col("cn").isNotNull()).select(
        F.col("cn").alias("column_name"),
        expr.first_match(
            (F.col("pt") != F.col("ct"), "retype"),
            (F.col("ph") != F.col("ch"), "value_change"),
            default="ok",
        ).alias("kind"),
        F.lit(None).cast("string").alias("prior_column_name"),
        F.when(F.col("pt") != F.col("ct"), F.concat_ws(" -> ", "pt", "ct")).alias("detail"),
    )

    def event(rows: DataFrame, name: str, kind: str, prior: Column) -> DataFrame:
        return rows.select(
            F.col(name).alias("column_name"), F.lit(kind).alias("kind"),
            prior.alias("prior_column_name"), F.lit(None).cast("string").alias("detail"),
        )

    none = F.lit(None).cast("string")
    return (
        matched.unionByName(event(renames, "cn", "rename_candidate", F.col("pn")))
        .unionByName(event(lost.join(renames, "pn", "left_anti"), "pn", "drop", none))
        .unionByName(event(new.join(renames, "cn", "left_anti"), "cn", "add", none))
    )


def apply_compatibility(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Per rule (name, columns array): ok, requires_review or incompatible, and why.
    A referenced column without an event counts as dropped."""
    refs = rules.select("name", F.explode_outer("columns").alias("column_name"))
    kinds = refs.join(events.select("column_name", "kind"), "column_name", "left").withColumn(
        "kind", F.when(F.col("column_name").isNull(), F.lit("ok")).otherwise(F.coalesce("kind", F.lit("drop")))
    )
    level = (
        F.when(F.col("kind").isin(BREAKING_KINDS), 2).when(F.col("kind").isin(REVIEW_KINDS), 1).otherwise(0)
    )
    worst = F.max(level)
    blocking = F.array_sort(F.collect_list(F.when(level > 0, F.col("kind"))))
    return kinds.groupBy("name").agg(
        F.when(worst == 2, "incompatible").when(worst == 1, "requires_review").otherwise("ok").alias("compatibility"),
        F.concat_ws(",", blocking).alias("blocking_kinds"),
    )
