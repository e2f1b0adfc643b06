"""Preprocessing: fit small constants on the training table, compile them to one select."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import derive, expr
from residua.functions.hashing import uniform
from residua.functions.quantiles import exact_quantiles
from residua.operators.profile import kind_of
from residua.session import durable

SKIP_TYPES = ("text", "id", "datetime")
IX_PREFIX = "__ix__"
MAX_LEVELS = 1000
HOLDOUT_MIN_ROWS = 40


def feature_target(df: DataFrame, target: str, keep: list[str] | None = None) -> DataFrame:
    """Target and features only."""
    return df.select(*(keep or []), target, *[c for c in df.columns if c != target and c not in (keep or [])])


def usable_features(
    df: DataFrame, target: str, types: dict[str, str], time_column: str | None = None, exclude: tuple[str, ...] = ()
) -> list[str]:
    """Columns left after dropping text, id, datetime, time and target columns."""
    skip = {target, time_column, *exclude}
    return [c for c in df.columns if c not in skip and types.get(c) not in SKIP_TYPES]


def zero_variance(df: DataFrame, columns: list[str]) -> list[str]:
    """Numeric columns with at most one distinct value (one scan, no distinct count)."""
    if not columns:
        return []
    row = df.agg(
        *[F.coalesce(F.min(expr.col(c)) == F.max(expr.col(c)), F.lit(True)).alias(f"z{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"z{i}"]]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    got = exact_quantiles(df, {c: expr.col(c) for c in columns}, [0.5])
    return {c: got[c][0] for c in columns}


def impute_median(df: DataFrame, columns: list[str], fitted: dict[str, float] | None = None) -> DataFrame:
    """Null and NaN replaced by the (training) median."""
    fitted = fitted or medians(df, columns)
    return df.withColumns(
        {c: F.coalesce(expr.as_double(expr.col(c)), F.lit(fitted[c])) for c in columns}
    )


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, ties to the smallest.  Counted per value before one
    row per column is chosen, so a dominant value costs one group."""
    from residua.operators.profile import top_values

    got = {r["column_name"]: r["value"] for r in top_values(df, columns, 1).collect()}
    return {c: got.get(c) for c in columns}


def impute_mode(df: DataFrame, columns: list[str], fitted: dict[str, str | None] | None = None) -> DataFrame:
    fitted = fitted or modes(df, columns)
    return df.withColumns(
        {c: F.coalesce(expr.col(c).cast("string"), F.lit(fitted[c])) for c in columns}
    )


@dataclass
class Scale:
    """x -> (x - offset) / factor."""

    offset: float
    factor: float

    def apply(self, c: Column) -> Column:
        return (c - F.lit(self.offset)) / F.lit(self.factor)

    def invert(self, c: Column) -> Column:
        return c * F.lit(self.factor) + F.lit(self.offset)


def fit_scales(df: DataFrame, columns: dict[str, Column], kind: str = "standard") -> dict[str, Scale]:
    """standard (population std), minmax or robust (median, IQR) scaling constants."""
    if kind == "robust":
        got = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return {c: Scale(q[1], (q[2] - q[0]) or 1.0) for c, q in got.items()}
    aggs = []
    for i, c in enumerate(columns.values()):
        v = expr.as_double(c)
        a, b = (F.avg(v), F.stddev_pop(v)) if kind == "standard" else (F.min(v), F.max(v) - F.min(v))
        aggs += [a.alias(f"a{i}"), b.alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {c: Scale(row[f"a{i}"] or 0.0, row[f"b{i}"] or 1.0) for i, c in enumerate(columns)}


def _distinct_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("c"), expr.col(c).cast("string").alias("v")) for c in columns]
    exploded = df.select(F.explode(F.filter(F.array(*entries), lambda s: s["v"].isNotNull())).alias("e"))
    return exploded.select("e.*").distinct()


def narrow_levels(df: DataFrame, columns: list[str], max_levels: int | None = None) -> tuple[dict[str, list[str]], list[str]]:
    """Sorted distinct values of the categorical columns with ``max_levels`` values at most, and the wider columns."""
    most = MAX_LEVELS if max_levels is None else max_levels
    distinct = durable(_distinct_levels(df, columns))
    wide = {r["c"] for r in distinct.groupBy("c").count().where(F.col("count") > most).collect()}
    out: dict[str, list[str]] = {c: [] for c in columns if c not in wide}
    for r in distinct.where(~F.col("c").isin(sorted(wide))).collect() if wide else distinct.collect():
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}, [c for c in columns if c in wide]


def levels(df: DataFrame, columns: list[str], max_levels: int | None = None) -> dict[str, list[str]]:
    """Sorted distinct values per categorical column; refuses a column that is too wide to become one column per
    value (see ``narrow_levels`` and ``sparse`` for those)."""
    found, wide = narrow_levels(df, columns, max_levels)
    if wide:
        raise ValueError(f"too many values to one-hot encode: {wide}")
    return found


def with_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_frequency``, the share of the table's rows that hold the row's value: a number for models
    that cannot take a column of very many values."""
    n = df.count()
    out = df
    for c in columns:
        counts = df.groupBy(expr.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("__n")).where("v IS NOT NULL")
        keyed = out.withColumn("__k", F.struct(expr.col(c).cast("string").alias("v")))
        joined = keyed.join(counts.select(F.struct("v").alias("__k"), "__n"), "__k", "left")
        out = joined.withColumn(f"{c}_frequency", F.coalesce(F.col("__n") / F.lit(max(n, 1)), F.lit(0.0))).drop("__k", "__n")
    return out


def one_hot(column: str, values: list[str]) -> dict[str, Column]:
    """One 0/1 column per value but the first; unknown values give zeros."""
    c = expr.col(column).cast("string")
    return {
        f"{column}_{v}": F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in values[1:]
    }


@dataclass
class Preprocessor:
    """Median-impute and scale numeric columns, mode-impute and one-hot categorical ones.  Categorical columns with
    very many values stay one (imputed) column of text each, listed in ``wide``."""

    scaler: str = "standard"
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    scales: dict[str, Scale] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    wide: list[str] = field(default_factory=list)  # categorical columns with more than MAX_LEVELS values

    def fit(self, df: DataFrame, features: list[str], types: dict[str, str] | None = None) -> "Preprocessor":
        """Decide the role of each feature (an explicit type wins over the storage type) and
        learn the constants.  Booleans count as 0/1 numbers."""
        types = types or {}
        for c in features:
            role = types.get(c)
            if role is None:
                kind = kind_of(df.schema[c])
                role = {"integer": "numeric", "float": "numeric", "boolean": "numeric", "string": "categorical"}.get(kind)
            if role == "boolean":
                role = "numeric" if kind_of(df.schema[c]) != "string" else "categorical"
            if role == "numeric":
                self.numeric.append(c)
            elif role == "categorical":
                self.categorical.append(c)
        if self.numeric:
            self.medians = {
                k: (v if v is not None else 0.0)
                for k, v in exact_medians(df, self.numeric).items()
            }
            self.scales = fit_scales(df, {c: self._filled(c) for c in self.numeric}, self.scaler)
        if self.categorical:
            self.modes = modes(df, self.categorical)
            self.levels, self.wide = narrow_levels(df, self.categorical)
        return self

    def _filled(self, c: str) -> Column:
        return F.coalesce(expr.as_double(expr.col(c).cast("double")), F.lit(self.medians[c]))

    def columns(self) -> dict[str, Column]:
        """Output columns as expressions over the input table."""
        out = {c: self.scales[c].apply(self._filled(c)) for c in self.numeric}
        for c in self.categorical:
            filled = F.coalesce(expr.col(c).cast("string"), F.lit(self.modes[c]))
            if c in self.wide:
                continue
            for v in self.levels[c][1:]:
                out[f"{c}_{v}"] = F.coalesce((filled == F.lit(v)).cast("double"), F.lit(0.0))
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        missing = [c for c in [*self.numeric, *self.categorical] if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the table: {missing}")
        filled = [F.coalesce(expr.col(c).cast("string"), F.lit(self.modes[c])).alias(c) for c in self.wide]
        return df.select(*keep, *filled, *[c.alias(n) for n, c in self.columns().items()])

    def inverse(self, column: str, c: Column) -> Column:
        """Scaled values of one numeric column back in original units."""
        return self.scales[column].invert(c)


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    got = exact_quantiles(df, {c: expr.col(c).cast("double") for c in columns}, [0.5])
    return {c: got[c][0] for c in columns}


def numeric_fallback(df: DataFrame, keep: list[str]) -> DataFrame:
    """Numeric columns only, nulls filled with the median."""
    numeric = expr.numeric_columns(df, keep)
    filled = impute_median(df, numeric)
    return filled.select(*keep, *[expr.col(c) for c in numeric])


def with_holdout(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Flag a repeatable random share of rows as holdout, decided by key hash."""
    return df.withColumn("is_holdout", uniform(F.col(key), f"holdout{seed}") < F.lit(ratio))


def split_allowed(n_rows: int, ratio: float) -> bool:
    """No holdout is cut from tiny tables or for a non-positive ratio."""
    return ratio > 0 and n_rows >= HOLDOUT_MIN_ROWS


def with_temporal_holdout(df: DataFrame, time_column: str, key: str, ratio: float = 0.2) -> DataFrame:
    """Flag the last share of rows in (time, key) order as holdout."""
    from residua.functions.ranks import with_position

    n = df.count()
    cut = int(n * (1 - ratio))
    return with_position(df, [time_column, key]).withColumn("is_holdout", F.col("pos") >= F.lit(cut))


def interaction_names(a: str, b: str) -> tuple[str, str, str]:
    return f"{IX_PREFIX}{a}__x__{b}", f"{IX_PREFIX}{a}__hh__{b}", f"{IX_PREFIX}{a}__xor__{b}"


def interaction_trees(pairs: list[tuple[str, str]], medians_: dict[str, float]) -> dict[str, derive.Tree]:
    """Product, both-above-median and exactly-one-above-median of each pair, as storable expressions."""
    out: dict[str, derive.Tree] = {}
    for a, b in pairs:
        trees = derive.pair_trees(a, b, medians_[a], medians_[b])
        out.update(zip(interaction_names(a, b), (trees["product"], trees["both"], trees["either"]), strict=True))
    return out


def interaction_columns(pairs: list[tuple[str, str]], medians_: dict[str, float]) -> dict[str, Column]:
    """The columns of ``interaction_trees``."""
    return {n: derive.compiled(t) for n, t in interaction_trees(pairs, medians_).items()}


def add_interactions(df: DataFrame, pairs: list[tuple[str, str]], medians_: dict[str, float] | None = None) -> DataFrame:
    """Append interaction columns; pairs with a missing, non-numeric or empty feature are skipped."""
    numeric = set(expr.numeric_columns(df))
    usable = [(a, b) for a, b in pairs if a in numeric and b in numeric]
    if not usable:
        return df
    fitted = medians_ or medians(df, sorted({c for p in usable for c in p}))
    usable = [(a, b) for a, b in usable if fitted[a] is not None and fitted[b] is not None]
    return df.withColumns(interaction_columns(usable, fitted))


def top_pairs(strengths: DataFrame, k: int = 5, min_strength: float = 0.0) -> DataFrame:
    """Strongest pairs (feature_a, feature_b, strength) without self-pairs."""
    return (
        strengths.where((F.col("feature_a") != F.col("feature_b")) & (F.abs("strength") > min_strength))
        .orderBy(F.desc(F.abs("strength")), "feature_a", "feature_b")
        .limit(k)
    )


def is_interaction(c: Column) -> Column:
    return c.startswith(IX_PREFIX)


def winsorize(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip a column at two of its percentiles."""
    lo, hi = exact_quantiles(df, {"v": expr.col(column)}, [lower, upper])["v"]
    return df.withColumn(f"{column}_winsorized", expr.clip(expr.col(column), lo, hi))


def minmax_scores(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scores scaled to [0, 1]."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return df.withColumn(out, expr.normalise(F.col(column), row["lo"], row["hi"]))


def json_features(columns: list[str]) -> Column:
    """Feature values as JSON text; NaN and infinities become null."""
    return F.to_json(
        F.struct(*[expr.finite(expr.col(c)).alias(c) for c in columns]), {"ignoreNullFields": "false"}
    )


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns to one level of dotted names."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(
        *[F.col(".".join(expr.name(p) for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])]
    )


