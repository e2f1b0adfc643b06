"""Subgroup scans, clusters, time tests, variance regimes, pattern merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.ranks import with_position
from residua.operators import cluster, models, patterns, prep, regime, scan, temporal
from residua.plans.catalog.a_sources import EVENT_PATTERNS, RIDGE_OOF, event_patterns
from residua.plans.catalog.e_models import folded_orders
from residua.plans.catalog.registry import EVENT_FRAME, ORDER_FRAME, Tables, query
from residua.session import durable

KOLMOGOROV = """CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
   lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))))) END"""


def scan_sql(members: str) -> str:
    """Brute-force scan over long rows (column_name, bin, e); every column covers all rows."""
    return f"""(WITH mem AS ({members}), whole AS (SELECT count(*) AS n, avg(e) AS ma, stddev_pop(e) AS sa FROM mem WHERE column_name = (SELECT min(column_name) FROM mem)),
      r AS (SELECT column_name, bin, e, cume_dist() OVER (PARTITION BY column_name ORDER BY e) AS fa, (rank() OVER (PARTITION BY column_name ORDER BY e) - 1) / count(*) OVER (PARTITION BY column_name) AS fal,
        cume_dist() OVER (PARTITION BY column_name, bin ORDER BY e) AS fb, (rank() OVER (PARTITION BY column_name, bin ORDER BY e) - 1) / count(*) OVER (PARTITION BY column_name, bin) AS fbl FROM mem),
      st AS (SELECT column_name, bin, count(*) AS sample_count, avg(e) AS mean_residual, stddev_pop(e) AS std_residual, max(greatest(abs(fa - fb), abs(fal - fbl))) AS ks_stat FROM r GROUP BY column_name, bin),
      t AS (SELECT st.*, n AS n_total, ma AS mean_all, sa AS std_all, (mean_residual - ma) / sa AS effect_size, sqrt(sample_count * n / (sample_count + n)) * ks_stat AS x FROM st, whole WHERE sample_count >= 20),
      p AS (SELECT *, {KOLMOGOROV} AS p_value FROM t),
      o AS (SELECT *, row_number() OVER (ORDER BY p_value, column_name, bin) AS rk, count(*) OVER () AS m FROM p)
      SELECT *, least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC)) AS adjusted_p_value FROM o)"""


TEST_COLS = "column_name bin sample_count mean_residual:4 std_residual:4 effect_size:6 ks_stat:9 p_value:6 adjusted_p_value:6"

RESIDUAL_MEMBERS = f"""WITH {RIDGE_OOF} SELECT 'o_orderpriority' AS column_name, o_orderpriority AS bin, residual AS e FROM oof
   UNION ALL SELECT 'o_orderstatus', o_orderstatus, residual FROM oof UNION ALL SELECT 'c_mktsegment', c_mktsegment, residual FROM oof"""


@query("residual_scan", "E2 E6 E16 G3 G4 G5 G6 G7", TEST_COLS, f"SELECT * FROM {scan_sql(RESIDUAL_MEMBERS)}")
def residual_scan(t: Tables) -> DataFrame:
    """Flagship: cross-fitted ridge residuals of order prices, scanned by category."""
    columns = ["o_orderpriority", "o_orderstatus", "c_mktsegment"]
    oof = durable(models.ridge_oof(folded_orders(t), ["c_acctbal"], "y").table.select("residual", *columns))
    specs = [scan.BinSpec(c) for c in columns]
    return scan.bh_adjust(scan.ks_scan(oof, specs, "residual")).withColumnRenamed("bin_value", "bin")


@query("planted_scan", "G3 G5 G6 G7", TEST_COLS, f"SELECT * FROM {scan_sql(f'''SELECT 'event_type' AS column_name, event_type AS bin, residual AS e FROM {EVENT_FRAME}''')}")
def planted_scan(t: Tables) -> DataFrame:
    tests = scan.ks_scan(t.event_frame(), [scan.BinSpec("event_type")], "residual")
    return scan.bh_adjust(tests).withColumnRenamed("bin_value", "bin")


QUANTILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _quantile_members() -> str:
    parts = []
    for c in QUANTILE_COLUMNS:
        edges = ", ".join(f"quantile_cont({c}, {i / 5}) AS e{i}" for i in range(6))
        # equal edges are merged: a bin's number is the count of distinct edges below it
        distinct = f"len(list_distinct(list_filter([e0, e1, e2, e3, e4, e5], lambda e: e < {c}))) - 1"
        parts.append(f"SELECT '{c}' AS column_name, greatest(0, {distinct})::INT AS bin, l_tax * 100 + l_quantity AS e FROM lineitem, (SELECT {edges} FROM lineitem) q")
    return " UNION ALL ".join(parts)


@query("quantile_scan", "G1 G4 G5 G6 G7", TEST_COLS, f"SELECT * FROM {scan_sql(_quantile_members())}")
def quantile_scan(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("e", F.col("l_tax") * 100 + F.col("l_quantity"))
    specs = scan.quantile_specs(df, QUANTILE_COLUMNS)
    return scan.bh_adjust(scan.ks_scan(df, specs, "e")).withColumn("bin", F.col("bin_index"))


@query(
    "equal_width_bins", "G2", "column_name bin_index sample_count mean_residual:4",
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events)
       SELECT 'value' AS column_name, greatest(0, least(4, CASE WHEN value <= lo + w THEN 0 WHEN value <= lo + w * 2 THEN 1 WHEN value <= lo + w * 3 THEN 2 WHEN value <= lo + w * 4 THEN 3 ELSE 4 END))::INT AS bin_index,
         count(*) AS sample_count, avg(user_id) AS mean_residual FROM events, b GROUP BY 2""",
)
def equal_width_bins(t: Tables) -> DataFrame:
    specs = scan.equal_width_specs(t.events, ["value"])
    return scan.bin_stats(t.events.withColumn("e", F.col("user_id").cast("double")), specs, "e")


@query(
    "bin_memberships", "G3 G4", "column_name bin_value n e_sum:2",
    f"""SELECT 'event_type' AS column_name, event_type AS bin_value, count(*) AS n, sum(residual) AS e_sum FROM {EVENT_FRAME} WHERE event_type <> 'view' GROUP BY 2
        UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), sum(residual) FROM {EVENT_FRAME} GROUP BY 2""",
)
def bin_memberships(t: Tables) -> DataFrame:
    df = t.event_frame().withColumn("user_id", F.col("user_id").cast("string")).withColumn(
        "event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    long = scan.memberships(df, [scan.BinSpec("event_type"), scan.BinSpec("user_id")], ["residual"])
    return long.groupBy("column_name", "bin_value").agg(F.count("*").alias("n"), F.sum("residual").alias("e_sum"))


PLANTED_TESTS = scan_sql(f"SELECT 'event_type' AS column_name, event_type AS bin, residual AS e FROM {EVENT_FRAME}")


@query(
    "subgroup_patterns", "G8", "column_name bin_value effect_size:6 adjusted_p_value:6 sample_count",
    f"SELECT column_name, bin AS bin_value, effect_size, adjusted_p_value, sample_count FROM {PLANTED_TESTS} WHERE adjusted_p_value <= 0.05 AND abs(effect_size) > 0.15",
)
def subgroup_patterns(t: Tables) -> DataFrame:
    return scan.subgroup_patterns(t.event_frame(), ["event_type"], "residual")


@query(
    "top_subgroups", "G9", "rule coverage:6 wracc:6 mean_residual:4 mean_outside:4 effect_size:6",
    f"""SELECT column_name || ' in ' || bin AS rule, sample_count / n_total AS coverage, sample_count / n_total * (mean_residual - mean_all) AS wracc, mean_residual, mean_all AS mean_outside, effect_size
        FROM {PLANTED_TESTS} ORDER BY abs(effect_size) DESC LIMIT 3""",
)
def top_subgroups(t: Tables) -> DataFrame:
    return scan.top_subgroups(scan.ks_scan(t.event_frame(), [scan.BinSpec("event_type")], "residual"), 3)


@query(
    "in_out_cohens_d", "G10", "bin_value sample_count mean_out:4 cohens_d:6",
    f"""SELECT event_type AS bin_value, count(*) AS sample_count, max(m2) AS mean_out, (avg(residual) - max(m2)) / sqrt(((count(*) - 1) * var_pop(residual) + (max(n2) - 1) * max(v2)) / (count(*) + max(n2) - 2)) AS cohens_d
        FROM {EVENT_FRAME} a JOIN (SELECT k.event_type AS kt, avg(b.residual) AS m2, var_pop(b.residual) AS v2, count(*) AS n2 FROM (SELECT DISTINCT event_type FROM events) k JOIN {EVENT_FRAME} b ON b.event_type <> k.event_type GROUP BY 1) o
        ON o.kt = a.event_type GROUP BY event_type""",
)
def in_out_cohens_d(t: Tables) -> DataFrame:
    return scan.in_out_cohens_d(scan.bin_stats(t.event_frame(), [scan.BinSpec("event_type")], "residual"))


@query(
    "beam_search", "G11", "rule n_conditions sample_count mean_residual:4 wracc:6",
    f"""WITH w AS (SELECT count(*) AS n, avg(residual) AS m FROM {EVENT_FRAME}), e AS (SELECT *, hour(ts)::VARCHAR AS hr, dayofweek(ts)::VARCHAR AS dow FROM {EVENT_FRAME}),
      s AS (SELECT 'event_type in ' || event_type AS rule, 1 AS c, count(*) AS k, avg(residual) AS a FROM e GROUP BY event_type UNION ALL SELECT 'dow in ' || dow, 1, count(*), avg(residual) FROM e GROUP BY dow),
      p AS (SELECT 'dow in ' || dow || ' and event_type in ' || event_type AS rule, 2 AS c, count(*) AS k, avg(residual) AS a FROM e GROUP BY dow, event_type)
      SELECT rule, c AS n_conditions, k AS sample_count, a AS mean_residual, k / n * (a - m) AS wracc FROM (SELECT * FROM s UNION ALL SELECT * FROM p), w WHERE k >= 0.02 * n""",
)
def beam_search(t: Tables) -> DataFrame:
    df = t.event_frame().withColumn("dow", (F.dayofweek("ts") - 1).cast("string"))
    return scan.beam_search(df, [scan.BinSpec("event_type"), scan.BinSpec("dow")], "residual", width=60, depth=2, min_coverage=0.02)


HIGH_SQL = f"(SELECT *, abs(residual) AS abs_error FROM {EVENT_FRAME} WHERE abs(residual) >= (SELECT quantile_cont(abs(residual), 0.8) FROM {EVENT_FRAME}))"


@query("high_error_rows", "G12", "event_id abs_error:4", f"SELECT event_id, abs_error FROM {HIGH_SQL}")
def high_error_rows(t: Tables) -> DataFrame:
    return cluster.high_error_rows(t.event_frame(), "residual")


@query(
    "standardised", "G13", "o_orderkey z_o_totalprice:6 z_bal:6",
    f"""SELECT o_orderkey, (o_totalprice - m) / s AS z_o_totalprice, coalesce((bal - bm) / bs, 0.0) AS z_bal FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM {ORDER_FRAME}),
       (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, avg(c_acctbal) FILTER (c_acctbal > 0) AS bm, stddev_pop(c_acctbal) FILTER (c_acctbal > 0) AS bs FROM {ORDER_FRAME})""",
)
def standardised(t: Tables) -> DataFrame:
    df = t.order_frame().withColumn("bal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))))
    return cluster.standardise(df, ["o_totalprice", "bal"])


@query("density_clusters", "G14 G15 G16", "cluster sample_count mean_error:2")
def density_clusters(t: Tables) -> DataFrame:
    rows = t.event_frame().withColumn("hour", F.hour("ts").cast("double")).withColumn(
        "residual", F.col("residual") + F.when(F.col("hour").between(8, 11), 150.0).otherwise(0.0))
    labelled, _ = cluster.cluster_patterns(rows, ["hour"], "residual")
    return cluster.cluster_stats(labelled, ["hour"])


WIDE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "days"]


def wide_lines(t: Tables) -> DataFrame:
    """Returned lines with five features and an error that depends on two of them."""
    days = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double")
    lines = t.lineitem.where("l_returnflag = 'R' AND l_linenumber > 5")
    planted = F.when((F.col("l_tax") > 0.06) & (F.col("l_discount") < 0.02), 300.0).otherwise(0.0)
    return lines.withColumn("days", days).withColumn("residual", F.col("l_quantity") + planted)


@query(
    "density_clusters_wide", "G14 G15", "rows lifted",
    """WITH w AS (SELECT l_quantity + CASE WHEN l_tax > 0.06 AND l_discount < 0.02 THEN 300 ELSE 0 END AS e FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 5),
       h AS (SELECT e FROM w WHERE e >= (SELECT quantile_cont(e, 0.8) FROM w))
       SELECT count(*) AS rows, count(*) FILTER (e >= 300) AS lifted FROM h""",
)
def density_clusters_wide(t: Tables) -> DataFrame:
    """Every high-error row gets one label, over five columns."""
    labelled, _ = cluster.cluster_patterns(wide_lines(t), WIDE, "residual")
    return labelled.where("cluster IS NOT NULL").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("residual") >= 300).alias("lifted"))


@query("kmeans_clusters", "G14", "cluster sample_count")
def kmeans_clusters(t: Tables) -> DataFrame:
    df = cluster.standardise(t.order_frame(), ["o_totalprice", "c_acctbal"])
    labelled = cluster.kmeans_labels(df, ["z_o_totalprice", "z_c_acctbal"], 4)
    return labelled.groupBy("cluster").agg(F.count("*").alias("sample_count"))


EMBEDDED = "(SELECT vec_id, label AS cluster, embedding[1]::DOUBLE AS d1, embedding[2]::DOUBLE AS d2, abs(embedding[1]::DOUBLE) * 10 + label AS abs_error FROM embeddings)"


def embedded(t: Tables) -> DataFrame:
    """Vectors with their label as cluster id and an error that grows with it."""
    d1 = F.element_at("embedding", 1).cast("double")
    return t.embeddings.select(
        "vec_id", F.col("label").alias("cluster"), d1.alias("d1"), F.element_at("embedding", 2).cast("double").alias("d2"),
        (F.abs(d1) * 10 + F.col("label")).alias("abs_error"),
    )


@query(
    "cluster_stats", "G15", "cluster sample_count mean_error:6 std_error:6 center_d1:6 center_d2:6",
    f"SELECT cluster, count(*) AS sample_count, avg(abs_error) AS mean_error, stddev_pop(abs_error) AS std_error, avg(d1) AS center_d1, avg(d2) AS center_d2 FROM {EMBEDDED} WHERE cluster >= 0 GROUP BY cluster",
)
def cluster_stats(t: Tables) -> DataFrame:
    return cluster.cluster_stats(embedded(t), ["d1", "d2"])


@query(
    "cluster_gates", "G16", "cluster sample_count mean_error:6 error_lift:4 global_mean_error:4",
    f"""WITH s AS (SELECT cluster, count(*) AS sample_count, avg(abs_error) AS mean_error FROM {EMBEDDED} GROUP BY cluster), g AS (SELECT avg(abs_error) AS g FROM {EMBEDDED})
        SELECT cluster, sample_count, mean_error, mean_error / g AS error_lift, g AS global_mean_error FROM s, g
        WHERE sample_count >= 15 AND mean_error > g AND mean_error / g >= 1.1 AND mean_error - g >= greatest(0.01, 0.05 * g)""",
)
def cluster_gates(t: Tables) -> DataFrame:
    df = embedded(t)
    mean = df.agg(F.avg("abs_error")).first()[0]
    return cluster.accepted_clusters(cluster.cluster_stats(df, ["d1", "d2"]), mean)


@query("residual_space_clusters", "G17", "cluster size coverage_pct:4")
def residual_space_clusters(t: Tables) -> DataFrame:
    df = t.event_frame().withColumn("hour", F.hour("ts").cast("double"))
    return cluster.residual_space_clusters(df, ["hour"], "residual").stats


ORDERED = f"(SELECT residual AS e, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM {EVENT_FRAME})"
BINNED = f"""(SELECT e, pos, n, CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1) ELSE n % 10 + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS bin FROM {ORDERED})"""


def ordered_events(t: Tables) -> tuple[DataFrame, int]:
    o = temporal.order_by_time(t.event_frame(), "ts", "event_id", "residual")
    return o, o.count()


@query("time_bins", "G18", "bin n mean:6 variance:4", f"SELECT bin::INT AS bin, count(*) AS n, avg(e) AS mean, var_pop(e) AS variance FROM {BINNED} GROUP BY bin")
def time_bins(t: Tables) -> DataFrame:
    o, n = ordered_events(t)
    return temporal.time_bins(o, n)


@query(
    "kendall_trend", "G18", "bins:int tau:6",
    f"""WITH b AS (SELECT bin, avg(e) AS m FROM {BINNED} GROUP BY bin) SELECT 10 AS bins, sum(sign(y.m - x.m)) / count(*) AS tau FROM b x JOIN b y ON x.bin < y.bin""",
)
def kendall_trend(t: Tables) -> DataFrame:
    o, n = ordered_events(t)
    return temporal.kendall_trend(o, n)


@query(
    "levene_test", "G19", "groups:int statistic:5 effect:6",
    f"""WITH m AS (SELECT bin, quantile_cont(e, 0.5) AS md, var_pop(e) AS ev FROM {BINNED} GROUP BY bin), z AS (SELECT b.bin, abs(e - md) AS z FROM {BINNED} b JOIN m ON b.bin = m.bin),
      g AS (SELECT bin, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY bin), t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g)
      SELECT max(k) AS groups, (sum(n * (m - gm) * (m - gm)) / (max(k) - 1)) / (sum(n * v) / (max(nn) - max(k))) AS statistic, (SELECT max(ev) / min(ev) FROM m) AS effect FROM g, t""",
)
def levene_test(t: Tables) -> DataFrame:
    o, n = ordered_events(t)
    return temporal.levene(o, n)


LJUNG = f"""(WITH o AS (SELECT pos, n, e - avg(e) OVER () AS d FROM {ORDERED}), c0 AS (SELECT sum(d * d) AS c0, max(n) AS n FROM o),
   l AS (SELECT x.k, sum(x.d * y.d) AS ck FROM (SELECT *, unnest(range(1, 11)) AS k FROM o) x JOIN o y ON x.pos = y.pos + x.k GROUP BY x.k)
   SELECT k AS lag, ck / c0 AS autocorrelation, n * (n + 2) * sum((ck / c0) * (ck / c0) / (n - k)) OVER (ORDER BY k) AS q_stat FROM l, c0)"""


@query("ljung_box", "G20", "lag autocorrelation:6 q_stat:5", f"SELECT lag::INT AS lag, autocorrelation, q_stat FROM {LJUNG}")
def ljung_box(t: Tables) -> DataFrame:
    o, n = ordered_events(t)
    return temporal.ljung_box(o, n)


@query(
    "rolling_drift", "G21", "n r:6",
    f"""WITH r AS (SELECT pos, avg(e) OVER (ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM {ORDERED}), f AS (SELECT * FROM r WHERE pos >= 49),
      k AS (SELECT pos, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv FROM f) SELECT count(*) AS n, corr(pos, rv) AS r FROM k""",
)
def rolling_drift(t: Tables) -> DataFrame:
    o, n = ordered_events(t)
    return temporal.rolling_drift(o, n)


@query(
    "temporal_skip", "G22", "time_column n_valid skip_reason",
    """SELECT 'ts' AS time_column, count(ts) AS n_valid, CASE WHEN count(ts) < 20 THEN 'few_valid' WHEN min(ts) = max(ts) THEN 'constant_time' ELSE 'none' END AS skip_reason FROM events
       UNION ALL SELECT 'event_type', count(TRY_CAST(event_type AS TIMESTAMP)), 'few_valid' FROM events
       UNION ALL SELECT 'same', count(*), 'constant_time' FROM events""",
)
def temporal_skip(t: Tables) -> DataFrame:
    df = t.events.withColumn("same", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    out = None
    for c in ("ts", "event_type", "same"):
        part = temporal.skip_reason(df, c).withColumn("time_column", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query("temporal_patterns", "G18 G19 G20 G21 G22", "column_name pattern_type detail effect_size:4")
def temporal_patterns(t: Tables) -> DataFrame:
    hours = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0 - 473_352).cast("double")
    drifting = t.event_frame().withColumn("residual", F.col("residual") + hours)
    return temporal.temporal_patterns(drifting, "ts", "event_id", "residual")


REGIME = "(SELECT event_id, value, user_id::DOUBLE AS user_no, hour(ts)::DOUBLE AS hr, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * value * (1 + user_id / 10.0) AS residual FROM events)"


def regime_events(t: Tables) -> DataFrame:
    """Residuals whose spread grows with the user number."""
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return t.events.select(
        "event_id", "value", F.col("user_id").cast("double").alias("user_no"), F.hour("ts").cast("double").alias("hr"),
        (sign * F.col("value") * (1 + F.col("user_id") / 10.0)).alias("residual"),
    )


def _lr_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, count(*) AS n, regr_slope(abs(residual), {c}) AS slope, -count(*) * ln(1 - pow(corr({c}, abs(residual)), 2)) AS lr_stat FROM {REGIME}"


def _spread_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, count(*) AS bins, max(m) / min(m) AS spread_ratio FROM (SELECT ({c} >= e1)::INT + ({c} >= e2)::INT + ({c} >= e3)::INT + ({c} >= e4)::INT AS b, avg(abs(residual)) AS m, count(*) AS k
      FROM {REGIME}, (SELECT quantile_cont({c}, 0.2) AS e1, quantile_cont({c}, 0.4) AS e2, quantile_cont({c}, 0.6) AS e3, quantile_cont({c}, 0.8) AS e4 FROM {REGIME}) GROUP BY b HAVING count(*) >= 2)"""


@query(
    "variance_lr", "G23", "feature n slope:6 lr_stat:4 significant",
    f"SELECT *, lr_stat > 3.841458820694124 AS significant FROM ({_lr_sql('user_no')} UNION ALL {_lr_sql('hr')})",
)
def variance_lr(t: Tables) -> DataFrame:
    return regime.likelihood_ratios(regime_events(t), ["user_no", "hr"], "residual")


@query("spread_ratio", "G24", "feature bins spread_ratio:6", f"{_spread_sql('user_no')} UNION ALL {_spread_sql('hr')}")
def spread_ratio(t: Tables) -> DataFrame:
    return regime.spread_ratios(regime_events(t), ["user_no", "hr"], "residual")


@query(
    "variance_regimes", "G23 G24", "pattern_type column_name lr_stat:4 spread_ratio:6 n",
    f"SELECT 'variance_regime' AS pattern_type, l.feature AS column_name, lr_stat, spread_ratio, n FROM ({_lr_sql('user_no')}) l JOIN ({_spread_sql('user_no')}) s ON l.feature = s.feature WHERE lr_stat > 3.84 AND spread_ratio >= 2",
)
def variance_regimes(t: Tables) -> DataFrame:
    return regime.variance_regimes(regime_events(t), ["user_no", "hr"], "residual")


@query(
    "bounded_features", "G25", "feature importance:6",
    "SELECT p_name AS feature, avg(p_retailprice) AS importance FROM part GROUP BY p_name ORDER BY importance DESC, feature LIMIT 20",
)
def bounded_features(t: Tables) -> DataFrame:
    return regime.bounded_features(t.part.groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_retailprice").alias("importance")))


LINE_PAIRS = ["l_quantity", "l_extendedprice", "l_discount"]


def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a} * {b}, l_tax + l_quantity * l_discount / 50) AS r, count(*) AS n FROM lineitem"""


@query(
    "interaction_correlation", "G26", "feature_a feature_b r:6 n significant",
    "SELECT *, abs(r) > 0.1 AS significant FROM (" + " UNION ALL ".join(_pair_sql(a, b) for i, a in enumerate(LINE_PAIRS) for b in LINE_PAIRS[i + 1 :]) + ")",
)
def interaction_correlation(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("e", F.col("l_tax") + F.col("l_quantity") * F.col("l_discount") / 50)
    return regime.interaction_correlations(df, LINE_PAIRS, "e")


MODEL_PATTERNS = """(SELECT CASE WHEN c_acctbal > 4500 THEN 'trees' ELSE 'linear' END AS model, c_mktsegment AS column_name, 'subgroup' AS pattern_type, c_nationkey::VARCHAR AS bin_value,
   avg(c_acctbal) / 1000 AS effect_size FROM customer GROUP BY ALL)"""


@query(
    "model_agreement", "G27", "column_name pattern_type bin_value effect_size:6 agreement_models agreement_ratio:3 agreement confidence:2",
    f"""WITH g AS (SELECT column_name, pattern_type, bin_value, max(abs(effect_size)) AS effect_size, string_agg(DISTINCT model, ',' ORDER BY model) AS agreement_models, count(DISTINCT model) AS k FROM {MODEL_PATTERNS} GROUP BY ALL)
        SELECT *, k / 2 AS agreement_ratio, CASE WHEN k = 2 THEN 'consensus' ELSE agreement_models || '_only' END AS agreement, CASE WHEN k = 2 THEN 1.5 WHEN agreement_models = 'linear' THEN 0.8 ELSE 1.0 END AS confidence FROM g""",
)
def model_agreement(t: Tables) -> DataFrame:
    model = F.when(F.col("c_acctbal") > 4500, "trees").otherwise("linear")
    found = t.customer.groupBy(
        model.alias("model"), F.col("c_mktsegment").alias("column_name"), F.lit("subgroup").alias("pattern_type"),
        F.col("c_nationkey").cast("string").alias("bin_value"),
    ).agg((F.avg("c_acctbal") / 1000).alias("effect_size"))
    return patterns.model_agreement(found, ["trees", "linear"])


SCORED_SQL = f"""(SELECT *, 0.6 * abs(effect_size) + 0.4 * sample_count / (SELECT count(*) / 1000 FROM events) AS composite_score, sample_count / (SELECT count(*) / 1000 FROM events) AS coverage,
   CASE WHEN pattern_type = 'click' THEN 'subgroup' ELSE 'cluster' END AS source FROM {EVENT_PATTERNS} WHERE sample_count >= 5 AND abs(effect_size) >= 0.2 AND sample_count / (SELECT count(*) / 1000 FROM events) >= 0.03)"""


def scored_patterns(t: Tables) -> DataFrame:
    n = t.events.count() / 1000
    found = event_patterns(t).withColumn("pattern_type", F.when(F.col("pattern_type") == "click", "subgroup").otherwise(F.col("pattern_type")))
    return patterns.score(found, F.lit(n)).withColumn("bin_value", F.col("run_id").cast("string"))


@query("pattern_scores", "G28", "run_id column_name coverage:9 composite_score:9 source", f"SELECT * FROM {SCORED_SQL}")
def pattern_scores(t: Tables) -> DataFrame:
    return scored_patterns(t)


@query(
    "pattern_dedup", "G29", "run_id column_name source composite_score:6",
    f"SELECT * FROM {SCORED_SQL} QUALIFY row_number() OVER (PARTITION BY column_name, source ORDER BY composite_score DESC, run_id::VARCHAR) = 1",
)
def pattern_dedup(t: Tables) -> DataFrame:
    return patterns.dedup_by_column(scored_patterns(t))


MASKS = {
    "cheap": ("o_totalprice < 100000", lambda: F.col("o_totalprice") < 100000),
    "cheaper": ("o_totalprice < 95000", lambda: F.col("o_totalprice") < 95000),
    "urgent": ("o_orderpriority = '1-URGENT'", lambda: F.col("o_orderpriority") == "1-URGENT"),
    "open": ("o_orderstatus = 'O'", lambda: F.col("o_orderstatus") == "O"),
}


@query(
    "jaccard_pairs", "G29", "pattern_a pattern_b intersection union_rows jaccard:6",
    " UNION ALL ".join(
        f"SELECT '{a}' AS pattern_a, '{b}' AS pattern_b, count(*) FILTER ({MASKS[a][0]} AND {MASKS[b][0]}) AS intersection, count(*) FILTER ({MASKS[a][0]} OR {MASKS[b][0]}) AS union_rows, "
        f"count(*) FILTER ({MASKS[a][0]} AND {MASKS[b][0]}) / count(*) FILTER ({MASKS[a][0]} OR {MASKS[b][0]}) AS jaccard FROM orders"
        for i, a in enumerate(MASKS) for b in list(MASKS)[i + 1 :]
    ),
)
def jaccard_pairs(t: Tables) -> DataFrame:
    return patterns.jaccard_table(t.orders, list(MASKS), [m() for _, m in MASKS.values()])


def _greedy_sql() -> str:
    """The greedy pass written out: mask i stays unless it overlaps an earlier one that stays by more than 0.9."""
    names = list(MASKS)
    overlap = lambda i, j: (
        f"(SELECT count(*) FILTER (({MASKS[names[i]][0]}) AND ({MASKS[names[j]][0]})) / nullif(count(*) FILTER (({MASKS[names[i]][0]}) OR ({MASKS[names[j]][0]})), 0) FROM orders)"
    )
    steps = []
    for i in range(len(names)):
        covered = " OR ".join([f"((SELECT keep FROM k{j}) AND coalesce({overlap(i, j)}, 0) > 0.9)" for j in range(i)]) or "false"
        steps.append(f"k{i} AS (SELECT NOT ({covered}) AS keep)")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {1.0 - i / 10} AS composite_score FROM k{i} WHERE keep" for i, n in enumerate(names))
    return f"WITH {', '.join(steps)} {rows}"


@query("mask_dedup", "G29", "name composite_score:2", _greedy_sql())
def mask_dedup(t: Tables) -> DataFrame:
    scored = [{"name": n, "composite_score": 1.0 - i / 10} for i, n in enumerate(MASKS)]
    kept = patterns.dedup_by_mask(t.orders, scored, [m() for _, m in MASKS.values()])
    return t.spark.createDataFrame([(k["name"], k["composite_score"]) for k in kept], "name string, composite_score double")


@query(
    "regime_bypass", "G30", "pattern_type n",
    f"""SELECT 'scored' AS pattern_type, count(*) AS n FROM {SCORED_SQL} UNION ALL SELECT 'variance_regime', 1
        FROM ({_lr_sql('user_no')}) l JOIN ({_spread_sql('user_no')}) s ON l.feature = s.feature WHERE lr_stat > 3.84 AND spread_ratio >= 2""",
)
def regime_bypass(t: Tables) -> DataFrame:
    scored = scored_patterns(t).withColumn("pattern_type", F.lit("scored"))
    both = patterns.with_bypass(scored, regime.variance_regimes(regime_events(t), ["user_no", "hr"], "residual"))
    return both.groupBy("pattern_type").agg(F.count("*").alias("n"))


@query(
    "derived_columns", "G31", "is_derived n",
    """SELECT starts_with(CASE WHEN event_type = 'click' THEN '__ix__' || event_type ELSE event_type END, '__ix__') AS is_derived, count(*) AS n FROM events GROUP BY 1""",
)
def derived_columns(t: Tables) -> DataFrame:
    named = F.when(F.col("event_type") == "click", F.concat(F.lit(prep.IX_PREFIX), F.col("event_type"))).otherwise(F.col("event_type"))
    return t.events.groupBy(prep.is_interaction(named).alias("is_derived")).agg(F.count("*").alias("n"))


@query(
    "patterns_by_effect", "G32", "place:int run_id column_name effect_size:6",
    f"SELECT row_number() OVER (ORDER BY abs(effect_size) DESC, column_name, run_id::VARCHAR) AS place, run_id, column_name, effect_size FROM {EVENT_PATTERNS}",
)
def patterns_by_effect(t: Tables) -> DataFrame:
    named = event_patterns(t).withColumn("bin_value", F.col("run_id").cast("string")).withColumn("__size", -F.abs("effect_size"))
    return with_position(named, ["__size", "column_name", "bin_value"]).withColumn("place", F.col("pos") + 1)
