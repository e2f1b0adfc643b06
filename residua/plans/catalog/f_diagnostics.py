"""Residual diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import diagnostics, models
from residua.plans.catalog.a_sources import RIDGE_OOF
from residua.plans.catalog.registry import EVENT_FRAME, Tables, query


@query(
    "residual_moments", "F1", "n mean:6 std:6 skewness:6 kurtosis:6 max_abs:4",
    f"""WITH m AS (SELECT count(*) AS n, avg(residual) AS a, stddev_pop(residual) AS s FROM {EVENT_FRAME})
        SELECT max(n) AS n, max(a) AS mean, max(s) AS std, avg(pow((residual - a) / s, 3)) AS skewness, avg(pow((residual - a) / s, 4)) - 3 AS kurtosis, max(abs(residual)) AS max_abs
        FROM {EVENT_FRAME}, m""",
)
def residual_moments(t: Tables) -> DataFrame:
    return diagnostics.residual_moments(t.event_frame(), "residual")


@query(
    "large_residual_share", "F2", "pct_large:6",
    f"SELECT avg((abs(residual) > 2 * s)::INT) * 100 AS pct_large FROM {EVENT_FRAME}, (SELECT stddev_pop(residual) AS s FROM {EVENT_FRAME})",
)
def large_residual_share(t: Tables) -> DataFrame:
    return diagnostics.large_share(t.event_frame(), "residual")


@query(
    "outlier_profile", "F3", "p01:6 p99:6 outlier_fraction:6 winsorized_std:6",
    f"""SELECT max(lo) AS p01, max(hi) AS p99, avg((residual < lo OR residual > hi)::INT) AS outlier_fraction, stddev_pop(least(greatest(residual, lo), hi)) AS winsorized_std
        FROM {EVENT_FRAME}, (SELECT quantile_cont(residual, 0.01) AS lo, quantile_cont(residual, 0.99) AS hi FROM {EVENT_FRAME})""",
)
def outlier_profile(t: Tables) -> DataFrame:
    return diagnostics.outlier_profile(t.event_frame(), "residual")


SHAPE_SQL = f"""(WITH m AS (SELECT count(*) AS n, avg(residual) AS a, stddev_pop(residual) AS s FROM {EVENT_FRAME})
  SELECT max(n) AS n, avg(pow((residual - a) / s, 3)) AS g1, avg(pow((residual - a) / s, 4)) - 3 AS g2 FROM {EVENT_FRAME}, m)"""


@query("normality_test", "F4", "n jb:3 p_value:9 normal", f"SELECT n, n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb, exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4)) / 2) AS p_value, exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4)) / 2) > 0.05 AS normal FROM {SHAPE_SQL}")
def normality_test(t: Tables) -> DataFrame:
    return diagnostics.jarque_bera(t.event_frame(), "residual")


@query("bimodality", "F5", "n coefficient:6", f"SELECT n, (g1 * g1 + 1) / (g2 + 3) AS coefficient FROM {SHAPE_SQL}")
def bimodality(t: Tables) -> DataFrame:
    return diagnostics.bimodality(t.event_frame(), "residual")


@query("mixture_evidence", "F5", "n multimodal")
def mixture_evidence(t: Tables) -> DataFrame:
    return diagnostics.mixture_evidence(t.event_frame(), "residual")


@query(
    "breusch_pagan", "F6", "n lm:4",
    f"""WITH {RIDGE_OOF} SELECT count(*) AS n, count(*) * regr_r2(residual * residual, x) AS lm FROM oof""",
)
def breusch_pagan(t: Tables) -> DataFrame:
    from residua.plans.catalog.e_models import folded_orders

    return diagnostics.breusch_pagan(models.ridge_oof(folded_orders(t), ["c_acctbal"], "y").table, "residual", ["c_acctbal"])


@query(
    "durbin_watson", "F7", "n durbin_watson:6",
    f"""SELECT count(*) AS n, sum(d * d) / sum(residual * residual) AS durbin_watson
        FROM (SELECT residual, residual - lag(residual) OVER (ORDER BY ts, event_id) AS d FROM {EVENT_FRAME})""",
)
def durbin_watson(t: Tables) -> DataFrame:
    return diagnostics.durbin_watson(t.event_frame(), "residual", ["ts", "event_id"])


@query(
    "residual_report", "F8 F1 F2 F3 F4 F6 F7", "n pct_large:6 jb:3 lm:3 durbin_watson:6 warnings",
    f"""WITH s AS (SELECT * FROM {SHAPE_SQL}), l AS (SELECT avg((abs(residual) > 2 * s)::INT) * 100 AS pct_large FROM {EVENT_FRAME}, (SELECT stddev_pop(residual) AS s FROM {EVENT_FRAME})),
         b AS (SELECT count(*) * regr_r2(residual * residual, user_id) AS lm FROM {EVENT_FRAME}),
         w AS (SELECT sum(d * d) / sum(residual * residual) AS dw FROM (SELECT residual, residual - lag(residual) OVER (ORDER BY ts, event_id) AS d FROM {EVENT_FRAME})),
         a AS (SELECT n, pct_large, n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb, lm, dw FROM s, l, b, w)
        SELECT n, pct_large, jb, lm, dw AS durbin_watson, concat_ws(',', CASE WHEN pct_large > 10 THEN 'large_residuals' END, CASE WHEN lm > 3.841458820694124 THEN 'heteroscedastic' END,
          CASE WHEN exp(-jb / 2) <= 0.05 THEN 'non_normal' END, CASE WHEN dw < 1.5 OR dw > 2.5 THEN 'autocorrelated' END) AS warnings FROM a""",
)
def residual_report(t: Tables) -> DataFrame:
    return diagnostics.residual_report(t.event_frame(), "residual", ["user_id"], ["ts", "event_id"])


@query(
    "density_histogram", "F9", "bin count density:9 normal_density:9",
    f"""WITH m AS (SELECT min(residual) AS lo, max(residual) AS hi, avg(residual) AS a, stddev_pop(residual) AS s, count(*) AS n FROM {EVENT_FRAME}),
          b AS (SELECT least(floor((residual - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS count FROM {EVENT_FRAME}, m GROUP BY 1)
        SELECT bin, count, count / (n * (hi - lo) / 50) AS density, exp(-pow((lo + (bin + 0.5) * (hi - lo) / 50 - a) / s, 2) / 2) / (s * sqrt(2 * pi())) AS normal_density FROM b, m""",
)
def density_histogram(t: Tables) -> DataFrame:
    return diagnostics.density_histogram(t.event_frame(), "residual")


@query(
    "top_importances", "F10", "feature importance:6 rank:int",
    """SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM (SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY p_brand)
       QUALIFY row_number() OVER (ORDER BY importance DESC, feature) <= 20""",
)
def top_importances(t: Tables) -> DataFrame:
    return diagnostics.top_importances(t.part.select(F.col("p_brand").alias("feature"), F.col("p_retailprice").alias("importance")))
