"""Column and dataset profiles.  Every result is a small table with one row per column,
value or issue; row-level work is one or two aggregations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.functions import expr
from residua.functions.hashing import digest
from residua.functions.moments import Moments, grouped_moments
from residua.functions.quantiles import exact_quantiles

# Fixed values of the profile rules.
BOOLEAN_WORDS = ["true", "yes", "y", "1", "1.0", "t", "false", "no", "n", "0", "0.0", "f"]
ID_NAME = r"(?i)(^|_)(id|index|key|uuid|pk)($|_)"
ID_UNIQUE_PCT = 90.0
DATETIME_SHARE = 0.80
CATEGORY_UNIQUE = 50
CATEGORY_UNIQUE_PCT = 5.0
CLASS_UNIQUE = 20
MISSING_MEDIUM, MISSING_HIGH = 30.0, 70.0
NEAR_CONSTANT = 5
HIGH_CORR, REPORT_CORR, TOP_CORR = 0.95, 0.30, 20
OUTLIER_PCT, SKEW_LIMIT, IMBALANCE = 50.0, 2.0, 0.20
VIF_WARN, VIF_HIGH, VIF_CAP, VIF_MIN_ROWS = 5.0, 10.0, 1000.0, 10
TOP_VALUES, SAMPLE_VALUES = 10, 5
DEDUCT = {"high": 10, "medium": 5, "low": 2}

WIDE = 12


def kind_of(field: T.StructField) -> str:
    """Storage family of a column: time, boolean, integer, float, string or other."""
    if isinstance(field.dataType, expr.TIME_TYPES):
        return "time"
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, expr.INTEGER_TYPES):
        return "integer"
    if expr.is_numeric(field):
        return "float"
    return "string" if isinstance(field.dataType, T.StringType) else "other"


def column_facts(df: DataFrame) -> DataFrame:
    """Null, distinct and parse facts of every column and its semantic type.

    Values travel as 128-bit fingerprints and are counted before the shuffle, so neither
    long texts nor a value that fills a third of the table burden one task.
    """
    entries = []
    for f in df.schema.fields:
        c = expr.col(f.name)
        text = c.cast("string") if kind_of(f) != "other" else F.to_json(F.struct(c))
        present = c.isNotNull()
        if kind_of(f) == "float":
            present = present & ~F.isnan(c)
        is_time = F.lit(kind_of(f) == "time")
        flag = F.lit(kind_of(f) == "boolean")
        if kind_of(f) == "string":
            is_time = F.try_to_timestamp(c).isNotNull()
            flag = F.lower(F.trim(c)).isin(BOOLEAN_WORDS)
        elif kind_of(f) in ("integer", "float"):
            flag = c.cast("double").isin(0.0, 1.0)
        entries.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                present.alias("present"),
                F.when(present, F.xxhash64(text)).alias("h1"),
                F.when(present, F.xxhash64(text, F.lit(7))).alias("h2"),
                (present & F.coalesce(is_time, F.lit(False))).alias("timelike"),
                (present & F.coalesce(flag, F.lit(False))).alias("boolean_like"),
            )
        )
    values = (
        df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        .groupBy("column_name", "present", "h1", "h2", "timelike", "boolean_like")
        .agg(F.count("*").alias("c"))
    )
    facts = values.groupBy("column_name").agg(
        F.sum("c").alias("row_count"),
        F.sum(F.when(F.col("present"), 0).otherwise(F.col("c"))).alias("null_count"),
        F.count_if("present").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("timelike"), F.col("c"))), F.lit(0)).alias("time_count"),
        F.coalesce(F.bool_and(F.when(F.col("present"), F.col("boolean_like"))), F.lit(False)).alias(
            "all_boolean"
        ),
    )
    kinds = F.create_map(
        *[F.lit(v) for f in df.schema.fields for v in (f.name, kind_of(f))]
    )
    types = F.create_map(
        *[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())]
    )
    order = F.create_map(*[F.lit(v) for i, f in enumerate(df.schema.fields) for v in (f.name, i)])
    present = F.col("row_count") - F.col("null_count")
    facts = facts.select(
        order[F.col("column_name")].alias("position"),
        "column_name",
        types[F.col("column_name")].alias("dtype"),
        kinds[F.col("column_name")].alias("kind"),
        "row_count",
        "null_count",
        F.round(F.col("null_count") / F.col("row_count") * 100, 4).alias("null_pct"),
        "unique_count",
        F.coalesce(F.round(F.try_divide(F.col("unique_count"), present) * 100, 4), F.lit(0.0)).alias(
            "unique_pct"
        ),
        F.coalesce(F.try_divide(F.col("time_count"), present), F.lit(0.0)).alias("time_share"),
        "all_boolean",
    )
    return facts.withColumn("detected_type", semantic_type()).drop("time_share", "all_boolean")


def semantic_type() -> Column:
    """First rule that holds: id, datetime, boolean, numeric, categorical, text."""
    unique, pct = F.col("unique_count"), F.col("unique_pct")
    return expr.first_match(
        (F.col("column_name").rlike(ID_NAME) & (pct > ID_UNIQUE_PCT), "id"),
        ((F.col("kind") == "time") | (F.col("time_share") >= DATETIME_SHARE), "datetime"),
        ((F.col("kind") == "boolean") | F.col("all_boolean"), "boolean"),
        (F.col("kind").isin("integer", "float"), "numeric"),
        ((unique < CATEGORY_UNIQUE) | (pct < CATEGORY_UNIQUE_PCT), "categorical"),
        default="text",
    )


def column_types(df: DataFrame) -> dict[str, str]:
    """Semantic type per column name (one small row per column reaches the driver)."""
    return {r["column_name"]: r["detected_type"] for r in column_facts(df).collect()}


def _as_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) pairs of the non-null values, as text."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), expr.col(c).cast("string").alias("value"))
        for c in columns
    ]
    return df.select(
        F.explode(F.filter(F.array(*entries), lambda s: s["value"].isNotNull())).alias("e")
    ).select("e.*")


def sample_values(df: DataFrame, columns: list[str], k: int = SAMPLE_VALUES, seed: int = 42) -> DataFrame:
    """``k`` distinct values per column, chosen by hash so the pick is repeatable."""
    values = _as_long(df, columns).distinct()
    pick = Window.partitionBy("column_name").orderBy(digest(F.col("value"), str(seed)), "value")
    return (
        values.withColumn("slot", F.row_number().over(pick))
        .where(F.col("slot") <= k)
        .select("column_name", "slot", "value")
    )


def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of each column with count and share of non-null values."""
    counts = _as_long(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("total"))
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(totals, "column_name").select(
        "column_name", "rank", "value", "count",
        F.round(F.col("count") / F.col("total") * 100, 4).alias("pct"),
    )


def unbiased_skew(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population form."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population form."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


STAT_SCHEMA = (
    "column_name string, count long, mean double, std double, min double, max double, q25 double, "
    "median double, q75 double, skewness double, kurtosis double, outlier_count long, zero_count long"
)


def numeric_stats(df: DataFrame, columns: list[str], decimals: int = 4) -> DataFrame:
    """Moments, quartiles, outliers beyond 1.5 IQR and zeros of numeric columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], STAT_SCHEMA)
    quartiles = exact_quantiles(df, {c: expr.col(c) for c in columns}, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        v = expr.as_double(expr.col(c))
        n = F.count(v).cast("double")
        q25, _, q75 = quartiles[c]
        if q25 is not None and q75 - q25 > 0:
            iqr = q75 - q25
            out = F.count_if((v < F.lit(q25 - 1.5 * iqr)) | (v > F.lit(q75 + 1.5 * iqr)))
        else:
            out = F.lit(0).cast("long")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(v).alias("count"),
                *[
                    F.round(x, decimals).alias(n_)
                    for n_, x in {
                        "mean": F.avg(v),
                        "std": F.stddev_samp(v),
                        "min": F.min(v),
                        "max": F.max(v),
                        "q25": F.lit(q25).cast("double"),
                        "median": F.lit(quartiles[c][1]).cast("double"),
                        "q75": F.lit(q75).cast("double"),
                        "skewness": unbiased_skew(F.skewness(v), n),
                        "kurtosis": unbiased_kurtosis(F.kurtosis(v), n),
                    }.items()
                ],
                out.alias("outlier_count"),
                F.count_if(v == 0).alias("zero_count"),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select(
        "s.*"
    )


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """One row with everything the task rules need to know about the target."""
    f = df.schema[target]
    kind = kind_of(f)
    c = expr.col(target)
    number = expr.as_double(c) if kind in ("integer", "float", "boolean") else F.lit(None).cast("double")
    present = c if kind not in ("float",) else F.when(~F.isnan(c), c)
    return df.agg(
        F.lit(kind).alias("kind"),
        F.count(present).alias("n"),
        F.count_distinct(present).alias("n_unique"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("all_whole"),
    )


def detected_task(facts: DataFrame) -> DataFrame:
    """Classification when there are at most 20 values and they are whole numbers or text."""
    discrete = (F.col("kind") == "integer") | (F.col("kind") == "string") | (
        (F.col("kind") == "float") & F.col("all_whole")
    )
    return facts.select(
        "n", "n_unique",
        F.when((F.col("n_unique") <= CLASS_UNIQUE) & discrete, "classification")
        .otherwise("regression").alias("task"),
    )


def problem_type(facts: DataFrame, override: str | None = None) -> DataFrame:
    """binary (values 0/1), multiclass (values 0..k-1) or regression, unless overridden."""
    if override:
        return facts.select("n", "n_unique", F.lit(override).alias("problem"))
    k = F.col("n_unique")
    discrete = F.col("kind").isin("integer", "boolean") & (k >= 2) & (k <= 10) & (F.col("min_value") >= 0)
    dense = discrete & (F.col("n") / k >= 30) & (F.col("min_value") == 0) & (F.col("max_value") == k - 1)
    return facts.select(
        "n", "n_unique",
        F.when(dense & (k == 2), "binary").when(dense, "multiclass").otherwise("regression").alias("problem"),
    )


def target_suitability(facts: DataFrame, task_type: str = "auto") -> DataFrame:
    """Task by storage type and number of values; an explicit type is only checked."""
    if task_type != "auto":
        if task_type not in ("regression", "classification"):
            raise ValueError(f"task type must be regression, classification or auto, not {task_type!r}")
        return facts.select("n_unique", F.lit(task_type).alias("task"))
    return facts.select(
        "n_unique",
        expr.first_match(
            (F.col("kind").isin("boolean", "string"), "classification"),
            ((F.col("kind") == "float") & (F.col("n_unique") > 20), "regression"),
            ((F.col("kind") == "integer") & (F.col("n_unique") <= 20), "classification"),
            default="regression",
        ).alias("task"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, largest first."""
    return (
        df.where(expr.col(target).isNotNull())
        .groupBy(expr.col(target).cast("string").alias("class"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "class")
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Smallest over largest class and whether it is below the imbalance limit."""
    return class_distribution(df, target).agg(
        F.count("*").alias("num_classes"),
        F.min("count").alias("minority"),
        F.max("count").alias("majority"),
        (F.min("count") / F.max("count")).alias("ratio"),
        (F.min("count") / F.max("count") < IMBALANCE).alias("is_imbalanced"),
    )


def target_stats(df: DataFrame, target: str, decimals: int = 4) -> DataFrame:
    """Numeric target: mean, std, min, max, median.  Text target: its ten top values."""
    if expr.is_numeric(df.schema[target]):
        return numeric_stats(df, [target], decimals).select("column_name", "mean", "std", "min", "max", "median")
    return top_values(df, [target])


def correlation_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson r of every pair over the rows where both are present (upper triangle)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return {}
    if len(columns) <= WIDE:
        x = {c: expr.finite(expr.col(c)) for c in columns}
        row = df.agg(*[expr.safe_corr(x[a], x[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
        return {pair: row[f"r{i}"] for i, pair in enumerate(pairs) if row[f"r{i}"] is not None}
    return _wide_correlations(df, columns)


def _wide_correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Many columns: pairwise-complete sums as matrix products per Arrow batch."""
    p = len(columns)
    x = df.select(*[expr.finite(expr.col(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    row = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(p)])

    def partial(batches):
        sums = np.zeros((4, p, p))
        for pdf in batches:
            raw = pdf.to_numpy(dtype=float) - centre
            seen = (~np.isnan(raw)).astype(float)
            v = np.nan_to_num(raw)
            sums += np.stack([seen.T @ seen, v.T @ seen, (v * v).T @ seen, v.T @ v])
        flat = sums.ravel()
        yield pd.DataFrame({"i": np.arange(flat.size), "v": flat})

    cells = x.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(4 * p * p)
    for c in cells:
        flat[c["i"]] = c["v"]
    n, s, q, xy = flat.reshape(4, p, p)
    out = {}
    for i in range(p):
        for j in range(i + 1, p):
            m = n[i, j]
            if m < 2:
                continue
            cov = xy[i, j] - s[i, j] * s[j, i] / m
            va = q[i, j] - s[i, j] ** 2 / m
            vb = q[j, i] - s[j, i] ** 2 / m
            if va > 0 and vb > 0:
                out[columns[i], columns[j]] = float(cov / np.sqrt(va * vb))
    return out


def correlations(
    df: DataFrame, columns: list[str], min_abs: float = REPORT_CORR, k: int | None = TOP_CORR
) -> DataFrame:
    """Pairs with |r| of at least ``min_abs``, strongest first."""
    rows = [
        (a, b, round(r, 4), round(abs(r), 4))
        for (a, b), r in correlation_matrix(df, columns).items()
        if abs(round(r, 4)) >= min_abs
    ]
    rows.sort(key=lambda t: (-t[3], t[0], t[1]))
    return df.sparkSession.createDataFrame(
        rows[:k], "feature_a string, feature_b string, correlation double, abs_correlation double"
    )


def vif_values(m: Moments, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column regressed on the others without an intercept:
    (G^-1)_ii * G_ii with G the uncentred Gram matrix."""
    i = m.index(columns)
    gram = m.raw_gram()[np.ix_(i, i)]
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    unit = gram / np.outer(scale, scale)
    try:
        if np.linalg.cond(unit) > 1e14:
            raise np.linalg.LinAlgError
        inverse = np.linalg.inv(unit)
        values = np.diag(inverse) * np.diag(unit)
    except np.linalg.LinAlgError:
        values = np.full(len(columns), VIF_CAP)
    return {c: float(min(max(v, 0.0), VIF_CAP)) for c, v in zip(columns, values)}


def vif(df: DataFrame, columns: list[str], min_vif: float = VIF_WARN) -> DataFrame:
    """Columns whose VIF exceeds ``min_vif`` with its severity."""
    schema = "feature string, vif double, severity string"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    m = grouped_moments(df, {c: expr.col(c) for c in columns}).get(0)
    if m is None or m.n < VIF_MIN_ROWS:
        return df.sparkSession.createDataFrame([], schema)
    rows = [
        (c, round(v, 2), "high" if v > VIF_HIGH else "medium" if v > VIF_WARN else "low")
        for c, v in vif_values(m, columns).items()
        if v > min_vif
    ]
    return df.sparkSession.createDataFrame(rows, schema)


ISSUE_COLUMNS = ["severity", "category", "column_name", "message", "suggestion", "position"]


def quality_issues(
    facts: DataFrame,
    stats: DataFrame,
    corr: DataFrame,
    target: str,
    imbalance: DataFrame | None = None,
    vif_table: DataFrame | None = None,
) -> DataFrame:
    """Quality problems found in the profile tables, one row each."""
    c = facts.join(stats.select("column_name", "skewness", "outlier_count"), "column_name", "left")
    q = F.concat(F.lit("'"), F.col("column_name"), F.lit("'"))
    present = F.col("row_count") - F.col("null_count")
    outlier_pct = F.try_divide(F.col("outlier_count"), present) * 100
    constant = (F.col("unique_count") <= 1) & (F.col("null_pct") < 100)

    def issue(cond: Column, severity: str, category: str, text: Column, fix: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(category).alias("category"),
                F.col("column_name"),
                text.alias("message"),
                fix.alias("suggestion"),
            ),
        )

    per_column = c.select(
        "position",
        F.explode(
            F.array_compact(
                F.array(
                    issue(
                        F.col("null_pct") > MISSING_HIGH, "high", "missing_values",
                        F.concat(q, F.format_string(" is %.1f%% null.", "null_pct")),
                        F.concat(F.lit("Consider dropping or imputing "), q, F.lit(".")),
                    ),
                    issue(
                        (F.col("null_pct") > MISSING_MEDIUM) & (F.col("null_pct") <= MISSING_HIGH),
                        "medium", "missing_values",
                        F.concat(q, F.format_string(" is %.1f%% null.", "null_pct")),
                        F.concat(F.lit("Consider imputing missing values in "), q, F.lit(".")),
                    ),
                    issue(
                        constant, "high", "constant_column",
                        F.concat(q, F.format_string(" has %d unique value(s).", "unique_count")),
                        F.concat(F.lit("Remove "), q, F.lit("; it carries no information.")),
                    ),
                    issue(
                        ~constant & (F.col("detected_type") == "numeric")
                        & (F.col("unique_count") < NEAR_CONSTANT) & (F.col("null_pct") < 100),
                        "medium", "constant_column",
                        F.concat(q, F.format_string(" has only %d unique numeric values.", "unique_count")),
                        F.concat(F.lit("Treat "), q, F.lit(" as categorical or review its meaning.")),
                    ),
                    issue(
                        F.coalesce(outlier_pct > OUTLIER_PCT, F.lit(False)), "low", "outliers",
                        F.concat(q, F.format_string(" has %d outliers.", "outlier_count")),
                        F.concat(F.lit("Consider capping or transforming "), q, F.lit(".")),
                    ),
                    issue(
                        F.coalesce(F.abs("skewness") > SKEW_LIMIT, F.lit(False)), "low", "skewness",
                        F.concat(q, F.format_string(" is heavily skewed (%.2f).", "skewness")),
                        F.concat(F.lit("Consider a log or power transform of "), q, F.lit(".")),
                    ),
                )
            )
        ).alias("i"),
    ).select("i.*", "position")
    strong = corr.where(
        (F.col("abs_correlation") >= HIGH_CORR)
        & (F.col("feature_a") != target) & (F.col("feature_b") != target)
    ).select(
        F.lit("medium").alias("severity"),
        F.lit("high_correlation").alias("category"),
        F.lit(None).cast("string").alias("column_name"),
        F.format_string("'%s' and '%s' are highly correlated (r=%.2f).", "feature_a", "feature_b", "correlation").alias("message"),
        F.format_string("Consider removing one of '%s' or '%s'.", "feature_a", "feature_b").alias("suggestion"),
        F.lit(10_000).alias("position"),
    )
    out = per_column.unionByName(strong)
    if imbalance is not None:
        out = out.unionByName(
            imbalance.where("is_imbalanced").select(
                F.lit("high").alias("severity"),
                F.lit("class_imbalance").alias("category"),
                F.lit(target).alias("column_name"),
                F.lit(f"Target '{target}' is class-imbalanced.").alias("message"),
                F.lit("Re-weight or re-sample the classes before training.").alias("suggestion"),
                F.lit(20_000).alias("position"),
            )
        )
    if vif_table is not None:
        out = out.unionByName(
            vif_table.where(F.col("vif") > VIF_WARN).select(
                "severity",
                F.lit("multicollinearity").alias("category"),
                F.col("feature").alias("column_name"),
                F.format_string("'%s' has VIF=%.2f.", "feature", "vif").alias("message"),
                F.format_string("Consider removing or combining '%s' with correlated features.", "feature").alias("suggestion"),
                F.lit(30_000).alias("position"),
            )
        )
    return out


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(99)


def quality_score(issues: DataFrame) -> DataFrame:
    """100 minus the deductions of all issues, never below 0."""
    lost = F.coalesce(
        F.sum(
            F.when(F.col("severity") == "high", DEDUCT["high"])
            .when(F.col("severity") == "medium", DEDUCT["medium"])
            .otherwise(DEDUCT["low"])
        ),
        F.lit(0),
    )
    return issues.agg(
        F.count("*").alias("n_issues"),
        F.greatest(F.lit(0.0), F.lit(100.0) - lost).alias("quality_score"),
    )


def recommendations(issues: DataFrame) -> DataFrame:
    """Distinct suggestions, most severe first, then in order of appearance."""
    return (
        issues.where(F.col("suggestion").isNotNull())
        .groupBy("suggestion")
        .agg(F.min(F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("position"))).alias("o"))
        .select("suggestion", F.col("o.rank").alias("severity_rank"), F.col("o.position").alias("position"))
        .orderBy("severity_rank", "position", "suggestion")
    )


@dataclass
class Profile:
    """Profile tables of one dataset."""

    facts: DataFrame
    stats: DataFrame
    top: DataFrame
    samples: DataFrame
    target: DataFrame
    correlations: DataFrame
    vif: DataFrame
    issues: DataFrame
    score: DataFrame
    recommendations: DataFrame


def profile(df: DataFrame, target: str, time_column: str | None = None) -> Profile:
    """All profile tables.  Type facts are computed first; only the columns a table needs are
    read for it."""
    spark = df.sparkSession
    facts_rows = column_facts(df).orderBy("position").collect()
    facts = spark.createDataFrame(facts_rows, column_facts(df).schema)
    types = {r["column_name"]: r["detected_type"] for r in facts_rows}
    numeric = [c for c in expr.numeric_columns(df) if types[c] in ("numeric", "boolean")]
    categorical = [c for c, t in types.items() if t in ("categorical", "boolean")]
    stats = numeric_stats(df, numeric)
    corr_cols = [c for c in expr.numeric_columns(df) if c != time_column]
    corr = correlations(df, corr_cols)
    vifs = vif(df, [c for c in corr_cols if c != target])
    task = detected_task(target_facts(df, target)).first()["task"]
    imbalance = class_imbalance(df, target) if task == "classification" else None
    issues = quality_issues(facts, stats, corr, target, imbalance, vifs)
    return Profile(
        facts=facts,
        stats=stats,
        top=top_values(df, categorical) if categorical else spark.createDataFrame(
            [], "column_name string, rank int, value string, count long, pct double"),
        samples=sample_values(df, [c for c, t in types.items() if t != "text"] or df.columns),
        target=class_distribution(df, target) if task == "classification" else numeric_stats(df, [target]),
        correlations=corr,
        vif=vifs,
        issues=issues,
        score=quality_score(issues),
        recommendations=recommendations(issues),
    )
