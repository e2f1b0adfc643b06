"""Residual behaviour over time.  All tests share one globally ordered table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.dist import chi2_sf, correlation_p, f_sf, kendall_exact_p
from residua.functions.quantiles import exact_quantiles
from residua.functions.ranks import array_split_bin, block_window, running_sums, with_blocks, with_position

MIN_VALID, MIN_LEVENE, WINDOW, BINS, MAX_LAG = 20, 5, 50, 10, 10
ALPHA, MIN_COEFFICIENT = 0.05, 0.3


def order_by_time(df: DataFrame, time_column: str, key: str, residual: str) -> DataFrame:
    """Rows with a usable time and residual and their position in (time, key) order."""
    t = F.col(time_column)
    if dict(df.dtypes)[time_column] == "string":
        t = F.try_to_timestamp(t)
    rows = df.select(t.alias("t"), F.col(key).alias("k"), F.col(residual).cast("double").alias("e"))
    return with_position(rows.where(F.col("t").isNotNull() & F.col("e").isNotNull()), ["t", "k"])


def skip_reason(df: DataFrame, time_column: str) -> DataFrame:
    """Why a time column cannot be analysed: few_valid, constant_time or null."""
    t = F.col(time_column)
    if dict(df.dtypes)[time_column] == "string":
        t = F.try_to_timestamp(t)
    return df.agg(F.count(t).alias("n_valid"), F.min(t).alias("first_t"), F.max(t).alias("last_t")).select(
        "n_valid",
        F.when(F.col("n_valid") < MIN_VALID, "few_valid")
        .when(F.col("first_t") == F.col("last_t"), "constant_time")
        .otherwise(F.lit("none")).alias("skip_reason"),
    )


def time_bins(ordered: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """Size, mean and population variance of equal runs of rows in time order."""
    return ordered.groupBy(array_split_bin(F.col("pos"), n, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("e").alias("mean"), F.var_pop("e").alias("variance")
    )


def kendall_trend(ordered: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """Kendall's tau of the (at most ``bins``) run means against their index."""
    rows = time_bins(ordered, n, bins).orderBy("bin").collect()
    means = [r["mean"] for r in rows]
    k = len(means)
    s = sum(
        (means[j] > means[i]) - (means[j] < means[i]) for i in range(k) for j in range(i + 1, k)
    )
    ties = {}
    for m in means:
        ties[m] = ties.get(m, 0) + 1
    pairs = k * (k - 1) / 2
    tied = sum(c * (c - 1) / 2 for c in ties.values())
    tau = s / math.sqrt(pairs * (pairs - tied)) if pairs > tied else float("nan")
    if math.isnan(tau):
        p = 1.0
    elif tied:
        p = math.erfc(abs(s) / math.sqrt(k * (k - 1) * (2 * k + 5) / 18) / math.sqrt(2))
    else:
        p = kendall_exact_p(tau, k)
    keep = p < ALPHA and abs(tau) > MIN_COEFFICIENT
    return ordered.sparkSession.createDataFrame(
        [(k, tau, p, keep, ("increasing" if tau > 0 else "decreasing"))],
        "bins int, tau double, p_value double, significant boolean, direction string",
    )


def levene(ordered: DataFrame, n: int, bins: int = BINS) -> DataFrame:
    """Median-centred Levene test over the runs, and the ratio of extreme variances."""
    placed = ordered.withColumn("bin", array_split_bin(F.col("pos"), n, bins))
    k = min(bins, n)
    masks = {f"b{i}": F.when(F.col("bin") == i, F.col("e")) for i in range(k)}
    mids = exact_quantiles(placed, masks, [0.5])
    centre = F.element_at(F.array(*[F.lit(mids[f"b{i}"][0]).cast("double") for i in range(k)]), F.col("bin") + 1)
    rows = (
        placed.withColumn("z", F.abs(F.col("e") - centre))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.var_pop("e").alias("ev"))
        .where(F.col("n") >= MIN_LEVENE).collect()
    )
    schema = "groups int, statistic double, p_value double, effect double, significant boolean"
    if len(rows) < 2:
        return ordered.sparkSession.createDataFrame([(len(rows), None, None, None, False)], schema)
    total = sum(r["n"] for r in rows)
    grand = sum(r["n"] * r["m"] for r in rows) / total
    between = sum(r["n"] * (r["m"] - grand) ** 2 for r in rows) / (len(rows) - 1)
    within = sum(r["n"] * r["v"] for r in rows) / (total - len(rows))
    stat = between / within if within > 0 else float("inf")
    p = f_sf(stat, len(rows) - 1, total - len(rows))
    effect = max(r["ev"] for r in rows) / max(min(r["ev"] for r in rows), 1e-10)
    return ordered.sparkSession.createDataFrame([(len(rows), stat, p, effect, p < ALPHA)], schema)


def ljung_box(ordered: DataFrame, n: int, max_lag: int = MAX_LAG) -> DataFrame:
    """Q and p for each lag up to min(max_lag, n // 5)."""
    lags = min(max_lag, n // 5)
    mean = ordered.agg(F.avg("e")).first()[0]
    blocks = with_blocks(ordered, "pos", lags).withColumn("d", F.col("e") - F.lit(mean))
    w = block_window("pos")
    lagged = blocks.withColumns({f"l{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)}).where("own")
    row = lagged.agg(
        F.sum(F.col("d") * F.col("d")).alias("c0"),
        *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)],
    ).first()
    out, q = [], 0.0
    for k in range(1, lags + 1):
        r = (row[f"c{k}"] or 0.0) / row["c0"]
        q += r * r / (n - k)
        stat = n * (n + 2) * q
        out.append((k, r, stat, chi2_sf(stat, k)))
    return ordered.sparkSession.createDataFrame(out, "lag int, autocorrelation double, q_stat double, p_value double")


def ljung_box_summary(lags: DataFrame) -> DataFrame:
    """Smallest p among the significant lags, the first such lag and its Q."""
    hit = lags.where(F.col("p_value") < ALPHA)
    return hit.agg(
        F.min("p_value").alias("min_p"), F.min("lag").alias("first_lag"),
        F.min_by("q_stat", "lag").alias("q_stat"), (F.count("*") > 0).alias("significant"),
    )


def rolling_drift(ordered: DataFrame, n: int, window: int = WINDOW) -> DataFrame:
    """Spearman correlation of the trailing mean with time (full windows only).

    Average ranks come from running sums over distinct values, so neither the ordered rows
    nor a heavily repeated value sit in one task.
    """
    schema = "n long, r double, p_value double, significant boolean"
    if n < 2 * window:
        return ordered.sparkSession.createDataFrame([(n, None, None, False)], schema)
    frame = block_window("pos").rowsBetween(-(window - 1), 0)
    rolled = (
        with_blocks(ordered, "pos", window - 1)
        .withColumn("v", F.avg("e").over(frame))
        .where(F.col("own") & (F.col("pos") >= window - 1))
    )
    m = n - window + 1
    centre = (window - 1) + (m - 1) / 2.0
    values = rolled.groupBy("v").agg(
        F.count("*").alias("c"), F.sum(F.col("pos") - F.lit(centre)).alias("s")
    )
    walked = running_sums(values, ["v"], {"upto": F.col("c")})
    rank = F.col("upto") - F.col("c") / 2.0 + 0.5 - F.lit((m + 1) / 2.0)
    row = walked.agg(
        F.sum(rank * F.col("s")).alias("xy"), F.sum(rank * rank * F.col("c")).alias("xx")
    ).first()
    yy = m * (m * m - 1) / 12.0
    r = row["xy"] / math.sqrt(row["xx"] * yy) if row["xx"] else float("nan")
    p = correlation_p(r, m)
    keep = p < ALPHA and abs(r) > MIN_COEFFICIENT
    return ordered.sparkSession.createDataFrame([(m, r, p, keep)], schema)


def temporal_patterns(df: DataFrame, time_column: str, key: str, residual: str) -> DataFrame:
    """All time tests of a residual column as pattern rows (only the significant ones)."""
    schema = "column_name string, pattern_type string, detail string, effect_size double, p_value double"
    spark = df.sparkSession
    if skip_reason(df, time_column).first()["skip_reason"] != "none":
        return spark.createDataFrame([], schema)
    ordered = order_by_time(df, time_column, key, residual)
    n = ordered.count()
    found = []
    trend = kendall_trend(ordered, n).first()
    if trend["significant"]:
        found.append((time_column, "trend", f"{trend['direction']} trend", abs(trend["tau"]), trend["p_value"]))
    shift = levene(ordered, n).first()
    if shift["significant"]:
        found.append((time_column, "regime_shift", "variance differs between periods", shift["effect"], shift["p_value"]))
    auto = ljung_box_summary(ljung_box(ordered, n)).first()
    if auto["significant"]:
        found.append((time_column, "trend", f"autocorrelation at lag {auto['first_lag']}", auto["q_stat"], auto["min_p"]))
    drift = rolling_drift(ordered, n).first()
    if drift["significant"]:
        found.append((time_column, "trend", "rolling mean drift", abs(drift["r"]), drift["p_value"]))
    return spark.createDataFrame(found, schema)
