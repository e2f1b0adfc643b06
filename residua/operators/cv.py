"""Fold assignment and out-of-fold scoring as table-to-table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.hashing import bucket_of, digest
from residua.functions.ranks import running_sums, with_position
from residua.operators.profile import kind_of, target_facts
from residua.session import durable


def resolve_strategy(
    df: DataFrame, target: str, strategy: str = "auto", time_column: str | None = None, group_column: str | None = None
) -> str:
    """Explicit choice, then time, group, stratified (few dense integer classes), kfold."""
    if strategy != "auto":
        return strategy
    if time_column:
        return "timeseries"
    if group_column:
        return "group"
    if kind_of(df.schema[target]) in ("integer", "boolean"):
        facts = target_facts(df, target).first()
        if 1 < facts["n_unique"] <= 10 and facts["n"] / facts["n_unique"] >= 30:
            return "stratified"
    return "kfold"


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled folds by key hash: no shuffle of rows and stable under repartitioning."""
    return df.withColumn("fold", bucket_of(F.col(key), f"fold{seed}", k))


def stratified_kfold(df: DataFrame, key: str, target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of equal class mix: rows of a class in hash order are dealt out in turn.

    One range sort over (class, hash, key) serves all classes, so a class that holds most of
    the rows is spread over many tasks.
    """
    cls = expr.col(target).cast("string")
    hashed = df.withColumn("__class", cls).withColumn("__h", digest(F.col(key), f"fold{seed}"))
    placed = with_position(hashed, ["__class", "__h", key], "__pos")
    starts = placed.groupBy(F.col("__class").alias("__c")).agg(F.min("__pos").alias("__start"))
    return (
        # one row per class
        placed.join(starts, F.col("__class").eqNullSafe(F.col("__c")), "left")
        .select(*df.columns, ((F.col("__pos") - F.col("__start")) % k).cast("int").alias("fold"))
    )


def timeseries_bounds(n: int, k: int) -> tuple[int, int]:
    """(size of a test fold, position where the first test fold starts)."""
    size = n // (k + 1)
    return size, n - k * size


def timeseries_folds(df: DataFrame, time_column: str, key: str, k: int = 5) -> DataFrame:
    """Consecutive test folds over (time, key) order; rows before the first test fold get -1.
    Training rows of fold f are those with ``pos < test_start(f) - gap``."""
    n = df.count()
    size, first = timeseries_bounds(n, k)
    placed = with_position(df, [time_column, key])
    fold = F.when(F.col("pos") < F.lit(first), F.lit(-1)).otherwise(
        F.floor((F.col("pos") - F.lit(first)) / F.lit(max(1, size)))
    )
    return placed.withColumn("fold", fold.cast("int"))


def train_before(fold_number: int, n: int, k: int, gap: int = 0) -> Column:
    """Training predicate of one time-series fold."""
    size, first = timeseries_bounds(n, k)
    return F.col("pos") < F.lit(first + fold_number * size - gap)


SHARE = 100  # a group is large from 1 / SHARE of a fold


def group_kfold(df: DataFrame, group: str, k: int = 5, balance: bool = False) -> DataFrame:
    """Folds that keep each group whole: by hash of the group or, with ``balance``, by size.

    Groups of at least 1 / ``SHARE`` of a fold, of which there are at most ``k * SHARE``, go one by one, the
    largest first, into the lightest fold.  All others, in order of their size, fill the folds up to one
    level by their running total, so any number of groups is placed without gathering them."""
    if not balance:
        return df.withColumn("fold", bucket_of(expr.col(group), "group", k))
    sizes = durable(df.groupBy(expr.col(group).alias("__g")).agg(F.count("*").alias("__c")))
    n = sizes.agg(F.sum("__c")).first()[0] or 0
    large = F.col("__c") * F.lit(k * SHARE) >= F.lit(n)
    load, placed = [0] * k, []
    for r in sizes.where(large).orderBy(F.desc("__c"), "__g").collect():
        f = load.index(min(load))
        load[f] += r["__c"]
        placed.append((r["__g"], f))
    schema = f"__g {df.schema[group].dataType.simpleString()}, fold int"
    table = df.sparkSession.createDataFrame(placed, schema)
    small = sizes.where(~large).withColumn("__order", -F.col("__c"))
    rest = n - sum(load)
    if rest:
        totals = running_sums(small, ["__order", "__g"], {"__sum": F.col("__c")})
        fold = F.lit(k - 1)
        for f, bound in reversed(list(enumerate(_fill(load, rest)))):
            fold = F.when(F.col("__sum") - F.col("__c") / 2 <= F.lit(float(bound)), F.lit(f)).otherwise(fold)
        table = table.unionByName(totals.select("__g", fold.alias("fold")))
    return df.join(table, expr.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def _fill(load: list[int], rest: int) -> list[float]:
    """Running totals at which each fold is full when ``rest`` more rows bring the folds to one level."""
    lightest = sorted(load)
    level = float(lightest[0])
    for i, low in enumerate(lightest):
        top = lightest[i + 1] if i + 1 < len(lightest) else float("inf")
        level = min((rest + sum(lightest[: i + 1])) / (i + 1), top)
        if level < top:
            break
    room = [max(0.0, level - x) for x in load]
    return [sum(room[: f + 1]) for f in range(len(load))]


def assign_folds(df: DataFrame, strategy: str, key: str, target: str, k: int, seed: int = 42, time_column: str | None = None, group_column: str | None = None) -> DataFrame:
    if strategy == "timeseries":
        return timeseries_folds(df, time_column or key, key, k)
    if strategy == "group":
        if not group_column:
            raise ValueError("the group strategy needs a group column")
        return group_kfold(df, group_column, k)
    if strategy == "stratified":
        return stratified_kfold(df, key, target, k, seed)
    return kfold(df, key, k, seed)


def fill_missing_predictions(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Non-finite predictions become the fold mean of the finite ones; a fold without any
    finite prediction is an error."""
    value = expr.finite(F.col(prediction))
    means = df.groupBy("fold").agg(F.avg(value).alias("m"))
    rows = means.collect()
    bad = [r["fold"] for r in rows if r["m"] is None and r["fold"] is not None and r["fold"] >= 0]
    if bad:
        raise ValueError(f"folds without any finite prediction: {bad}")
    fill = F.lit(None).cast("double")
    for r in rows:
        if r["m"] is not None:
            fill = F.when(F.col("fold") == r["fold"], F.lit(r["m"])).otherwise(fill)
    return df.withColumn(prediction, F.coalesce(value, fill))


def fold_scores(oof: DataFrame, target: str = "y", prediction: str = "prediction") -> DataFrame:
    """R-squared and RMSE of each fold."""
    e = F.col(target) - F.col(prediction)
    sse, sst = F.sum(e * e), F.var_pop(target) * F.count("*")
    return (
        oof.where((F.col("fold") >= 0) & F.col(prediction).isNotNull())
        .groupBy("fold")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.lit(1.0) - F.try_divide(sse, sst), F.lit(0.0)).alias("r2"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
        )
    )


def fold_accuracy(oof: DataFrame, target: str = "y", prediction: str = "prediction") -> DataFrame:
    hit = F.when(F.round(F.col(prediction)) == F.col(target), F.lit(1.0)).otherwise(F.lit(0.0))
    return oof.where(F.col("fold") >= 0).groupBy("fold").agg(F.avg(hit).alias("accuracy"))


def fold_auc(oof: DataFrame, target: str = "y", prediction: str = "prediction") -> DataFrame:
    """ROC-AUC of each fold from ranks (ties averaged).  Rows collapse to one per distinct
    score first; a global running sum then replaces a window over a whole fold."""
    scored = (
        oof.where((F.col("fold") >= 0) & F.col(prediction).isNotNull())
        .groupBy("fold", F.col(prediction).alias("s"))
        .agg(F.count_if(F.col(target) == 1).alias("pos_n"), F.count_if(F.col(target) != 1).alias("neg_n"))
    )
    walked = running_sums(scored, ["fold", "s"], {"neg_upto": F.col("neg_n")})
    per_fold = walked.groupBy("fold").agg(
        F.sum(F.col("pos_n") * (F.col("neg_upto") - F.col("neg_n") / 2.0)).alias("area"),
        F.min(F.col("neg_upto") - F.col("neg_n")).alias("start"),
        F.sum("pos_n").alias("p"),
        F.sum("neg_n").alias("q"),
    )
    area = F.col("area") - F.col("p") * F.col("start")
    return per_fold.select(
        "fold", (F.col("p") + F.col("q")).alias("n"),
        F.coalesce(F.try_divide(area, (F.col("p") * F.col("q")).cast("double")), F.lit(0.0)).alias("auc"),
    )


def score_summary(scores: DataFrame, metric: str) -> DataFrame:
    """Mean and population std of a fold metric."""
    return scores.agg(F.avg(metric).alias("mean_score"), F.stddev_pop(metric).alias("std_score"))


def importance_stability(importances: DataFrame, folds: int) -> DataFrame:
    """Coefficient of variation of each feature's importance over the folds; a fold without
    the feature counts as 0.  Above 0.5 the feature is unstable."""
    filled = importances.groupBy("feature").agg(
        F.sum("importance").alias("s"), F.sum(F.col("importance") * F.col("importance")).alias("q")
    )
    mean = F.col("s") / folds
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / folds - mean * mean))
    cv = F.round(F.when(mean > 1e-10, std / mean).otherwise(F.lit(0.0)), 4)
    return filled.select("feature", mean.alias("mean_importance"), cv.alias("cv"), (cv > 0.5).alias("unstable"))


def residual_records(oof: DataFrame, key: str, target: str = "y", prediction: str = "prediction", features: list[str] | None = None, model: str = "linear") -> DataFrame:
    """One residual row per scored key: actual, predicted, residual, |residual|, fold."""
    e = F.col(target) - F.col(prediction)
    cols = [
        F.lit(model).alias("model"), F.col(key), "fold", F.col(target).cast("double").alias("actual"),
        F.col(prediction).alias("predicted"), e.alias("residual"), F.abs(e).alias("abs_residual"),
    ]
    if features:
        from residua.operators.prep import json_features

        cols.append(json_features(features).alias("feature_vector"))
    return oof.where((F.col("fold") >= 0) & F.col(prediction).isNotNull()).select(*cols)


def deviance_residual(y: Column, p: Column, eps: float = 1e-7) -> Column:
    """Signed deviance residual of a 0/1 target and a probability clipped away from 0 and 1."""
    q = expr.clip(p, eps, 1 - eps)
    yd = y.cast("double")
    return F.signum(yd - q) * F.sqrt(
        F.lit(-2.0) * (yd * F.log(q) + (F.lit(1.0) - yd) * F.log(F.lit(1.0) - q))
    )


