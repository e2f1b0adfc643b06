"""Result lists, comparisons and narrative tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.operators import narrative, results
from residua.plans.catalog.a_sources import CUSTOMER_VARIABLES, RIDGE_OOF, customer_variables, ridge_records
from residua.plans.catalog.registry import Tables, query


@query(
    "paged_list", "I1", "o_orderkey o_totalprice:2 total",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200""",
)
def paged_list(t: Tables) -> DataFrame:
    where = F.col("o_orderstatus") == "F"
    rows = results.page(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 200, 100, where)
    return rows.join(F.broadcast(results.total_count(t.orders, where)))


@query("name_search", "I2", "p_partkey p_name", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED W%'")
def name_search(t: Tables) -> DataFrame:
    return results.search_name(t.part, "p_name", "RED W")


@query(
    "recent_rows", "I3", "event_id event_type",
    "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25",
)
def recent_rows(t: Tables) -> DataFrame:
    return results.most_recent(t.events, "ts", "event_id", 25, F.col("event_type") == "error")


@query(
    "residual_page", "I4", "o_orderkey residual:3",
    f"WITH {RIDGE_OOF} SELECT o_orderkey, residual FROM oof ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
def residual_page(t: Tables) -> DataFrame:
    return results.residual_page(ridge_records(t), "linear", "o_orderkey", 100, 50)


@query("variables_by_status", "I5", "name importance:6 status", f"SELECT name, importance, status FROM {CUSTOMER_VARIABLES} WHERE status = 'validated'")
def variables_by_status(t: Tables) -> DataFrame:
    return results.variables_by_status(customer_variables(t), "validated")


@query(
    "events_in_order", "I6", "place:int event_id",
    "SELECT row_number() OVER (ORDER BY ts, event_id) AS place, event_id FROM events ORDER BY ts, event_id LIMIT 200",
)
def events_in_order(t: Tables) -> DataFrame:
    first = results.events_in_order(t.events, "ts", "event_id").limit(200)
    return first.withColumn("place", F.row_number().over(Window.orderBy("ts", "event_id")))


@query(
    "compare_runs", "I7", "run_id total validated rejected candidates",
    f"SELECT run_id, count(*) AS total, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'candidate') AS candidates FROM {CUSTOMER_VARIABLES} GROUP BY run_id",
)
def compare_runs(t: Tables) -> DataFrame:
    return results.compare_runs(customer_variables(t))


@query(
    "config_diff", "I8", "setting first_value second_value",
    """SELECT coalesce(a.setting, b.setting) AS setting, a.v AS first_value, b.v AS second_value
       FROM (SELECT p_brand AS setting, count(*)::VARCHAR AS v FROM part WHERE p_type <> 'SMALL' GROUP BY 1) a FULL JOIN (SELECT p_brand AS setting, count(*)::VARCHAR AS v FROM part WHERE p_size < 48 GROUP BY 1) b ON a.setting = b.setting
       WHERE a.v IS DISTINCT FROM b.v""",
)
def config_diff(t: Tables) -> DataFrame:
    def settings(cond):
        return t.part.where(cond).groupBy(F.col("p_brand").alias("setting")).agg(F.count("*").cast("string").alias("value"))

    return results.config_diff(settings(F.col("p_type") != "SMALL"), settings(F.col("p_size") < 48))


@query(
    "variable_overlap", "I9", "name side",
    """WITH a AS (SELECT DISTINCT user_id::VARCHAR AS name FROM events WHERE event_type = 'error' AND value > 50), b AS (SELECT DISTINCT user_id::VARCHAR AS name FROM events WHERE event_type = 'purchase' AND value > 100)
       SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'common' WHEN a.name IS NOT NULL THEN 'only_first' ELSE 'only_second' END AS side FROM a FULL JOIN b ON a.name = b.name""",
)
def variable_overlap(t: Tables) -> DataFrame:
    def names(kind: str, low: float):
        return t.events.where((F.col("event_type") == kind) & (F.col("value") > low)).select(F.col("user_id").cast("string").alias("name"))

    return results.overlap(names("error", 50), names("purchase", 100))


TYPED_PATTERNS = """(SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'subgroup' WHEN 'error' THEN 'cluster' WHEN 'purchase' THEN 'interaction' WHEN 'view' THEN 'temporal' ELSE 'variance_regime' END AS pattern_type,
   avg(value) / 50 AS effect_size FROM events WHERE value > 40 GROUP BY user_id, event_type)"""
TYPED_VARIABLES = """(SELECT user_id AS run_id, 'lv_' || event_id AS name, CASE WHEN value > 120 THEN 'validated' WHEN value < 20 THEN 'rejected' ELSE 'candidate' END AS status,
   round(value / 100, 4) AS improvement_pct, value / 50 AS effect_size, round(least(1.0, value / 200), 4) AS stability_score FROM events WHERE event_type = 'signup')"""


def typed_patterns(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    pattern = (
        F.when(kind == "click", "subgroup").when(kind == "error", "cluster").when(kind == "purchase", "interaction")
        .when(kind == "view", "temporal").otherwise("variance_regime")
    )
    return t.events.where(F.col("value") > 40).groupBy(F.col("user_id").alias("run_id"), pattern.alias("pattern_type")).agg(
        (F.avg("value") / 50).alias("effect_size")
    )


def typed_variables(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("lv_"), F.col("event_id").cast("string")).alias("name"),
        F.when(v > 120, "validated").when(v < 20, "rejected").otherwise("candidate").alias("status"),
        F.round(v / 100, 4).alias("improvement_pct"), (v / 50).alias("effect_size"), F.round(F.least(F.lit(1.0), v / 200), 4).alias("stability_score"),
    )


@query("type_breakdown", "I10", "pattern_type patterns", f"SELECT pattern_type, count(*) AS patterns FROM {TYPED_PATTERNS} GROUP BY 1")
def type_breakdown(t: Tables) -> DataFrame:
    return results.type_breakdown(typed_patterns(t))


@query(
    "impact_rank", "I10", "run_id name rank:int",
    f"SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY improvement_pct DESC, abs(effect_size) DESC, stability_score DESC, name) AS rank FROM {TYPED_VARIABLES} WHERE status = 'validated'",
)
def impact_rank(t: Tables) -> DataFrame:
    return results.impact_rank(typed_variables(t), ["run_id"])


SUMMARY_SQL = f"""WITH p AS (SELECT run_id, count(*) AS patterns_found, count(*) FILTER (pattern_type = 'subgroup') AS n_subgroup, count(*) FILTER (pattern_type = 'cluster') AS n_cluster,
      count(*) FILTER (pattern_type = 'interaction') AS n_interaction, count(*) FILTER (pattern_type = 'temporal') AS n_temporal FROM {TYPED_PATTERNS} GROUP BY run_id),
   v AS (SELECT run_id, count(*) FILTER (status = 'validated') AS validated_variables, count(*) FILTER (status = 'rejected') AS rejected_variables, max(improvement_pct) FILTER (status = 'validated') AS best_improvement FROM {TYPED_VARIABLES} GROUP BY run_id),
   r AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY improvement_pct DESC, abs(effect_size) DESC, stability_score DESC, name) AS rk FROM {TYPED_VARIABLES} WHERE status = 'validated'),
   f AS (SELECT run_id, string_agg(name, ',' ORDER BY rk) AS top FROM r WHERE rk <= 5 GROUP BY run_id),
   j AS (SELECT coalesce(p.run_id, v.run_id) AS run_id, coalesce(patterns_found, 0) AS patterns_found, coalesce(n_subgroup, 0) AS n_subgroup, coalesce(n_cluster, 0) AS n_cluster, coalesce(n_interaction, 0) AS n_interaction,
      coalesce(n_temporal, 0) AS n_temporal, coalesce(validated_variables, 0) AS validated_variables, coalesce(rejected_variables, 0) AS rejected_variables, best_improvement FROM p FULL JOIN v ON p.run_id = v.run_id)
   SELECT j.*, CASE WHEN validated_variables > 0 AND best_improvement > 1 THEN 'factors_explain_error' WHEN validated_variables > 0 THEN 'variables_discovered' WHEN patterns_found > 0 THEN 'patterns_not_stable' ELSE 'nothing_detected' END AS headline_tier,
     CASE WHEN n_interaction > n_subgroup AND n_interaction > n_cluster THEN 'interaction' WHEN n_cluster > n_subgroup THEN 'cluster' ELSE 'subgroup' END AS dominant_type, coalesce(top, '') AS top_findings,
     CASE WHEN validated_variables > 0 THEN 'add_variables,investigate_cause,monitor_drift' WHEN patterns_found > 0 THEN 'use_larger_dataset,try_production_mode' ELSE 'no_action,expand_features' END AS next_steps
   FROM j LEFT JOIN f ON j.run_id = f.run_id"""


@query(
    "run_summary", "I11", "run_id headline_tier patterns_found n_subgroup n_cluster n_interaction n_temporal validated_variables rejected_variables best_improvement:4 dominant_type top_findings next_steps",
    SUMMARY_SQL,
)
def run_summary(t: Tables) -> DataFrame:
    return narrative.summarise(typed_patterns(t), typed_variables(t))


@query(
    "fallback_summary", "I12", "run_id patterns_found validated_variables rejected_variables headline",
    f"""WITH s AS ({SUMMARY_SQL}) SELECT run_id, patterns_found, validated_variables, rejected_variables,
        CASE WHEN validated_variables > 0 THEN validated_variables || CASE WHEN validated_variables = 1 THEN ' hidden variable confirmed' ELSE ' hidden variables confirmed' END
             WHEN patterns_found > 0 THEN patterns_found || ' patterns found but none passed stability validation' ELSE 'No significant patterns detected' END AS headline FROM s""",
)
def fallback_summary(t: Tables) -> DataFrame:
    return narrative.fallback_summary(typed_patterns(t), typed_variables(t))


LABELLED_SQL = """(SELECT event_id, user_id, event_type, value / 100 AS effect_size, 1 / (1 + value * 2) AS p_value, least(1.0, value / 150) AS presence_rate FROM events)"""


@query(
    "finding_labels", "I13", "event_id effect p_text stability",
    f"""SELECT event_id, CASE WHEN abs(effect_size) >= 0.8 THEN 'large' WHEN abs(effect_size) >= 0.5 THEN 'medium' WHEN abs(effect_size) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect,
        CASE WHEN p_value < 0.001 THEN 'highly significant' WHEN p_value < 0.01 THEN 'significant' WHEN p_value < 0.05 THEN 'moderately significant' ELSE 'not statistically significant' END AS p_text,
        CASE WHEN presence_rate >= 0.8 THEN 'Very stable' WHEN presence_rate >= 0.6 THEN 'Stable' ELSE 'Unstable' END AS stability FROM {LABELLED_SQL}""",
)
def finding_labels(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", narrative.effect_label(v / 100).alias("effect"), narrative.p_label(F.lit(1) / (1 + v * 2)).alias("p_text"),
        narrative.stability_label(F.least(F.lit(1.0), v / 150)).alias("stability"),
    )


@query(
    "finding_sentences", "I13", "run_id column_name sentence advice",
    """WITH g AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL)
       SELECT user_id AS run_id, 'event_kind_' || event_type AS column_name,
         CASE WHEN n > 10 THEN 'Errors differ (' || CASE WHEN abs(n / 100.0) >= 0.8 THEN 'large' WHEN abs(n / 100.0) >= 0.5 THEN 'medium' WHEN abs(n / 100.0) >= 0.2 THEN 'small' ELSE 'negligible' END || ' effect, ' || printf('%.2f', n / 100.0) || ') where event kind ' || event_type || ' is 1.5–2.5 (' || n
           || ' rows); ' || CASE WHEN 1.0 / n < 0.001 THEN 'highly significant' WHEN 1.0 / n < 0.01 THEN 'significant' WHEN 1.0 / n < 0.05 THEN 'moderately significant' ELSE 'not statistically significant' END || '; mean error ' || printf('%.3f', n / 8.0) || ', higher than average.'
           ELSE 'A dense group of ' || n || ' high-error rows was found.' END AS sentence,
         CASE WHEN n > 20 THEN 'No action: too few rows showed the pattern.' WHEN n > 10 THEN 'Look for an unrecorded condition related to event kind ' || event_type || '.' ELSE 'Check whether this combination of values is a hidden condition.' END AS advice FROM g""",
)
def finding_sentences(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = g.select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("event_kind_"), F.col("event_type")).alias("column_name"), F.lit("(1.5, 2.5]").alias("bin_value"),
        (F.col("n") / 100.0).alias("effect_size"), (F.lit(1.0) / F.col("n")).alias("p_value"), F.col("n").alias("sample_count"), (F.col("n") / 8.0).alias("mean_residual"),
        F.when(F.col("n") > 10, "subgroup").otherwise("cluster").alias("pattern_type"), F.when(F.col("n") > 20, "rejected").otherwise("validated").alias("status"),
        F.lit("support_too_sparse").alias("rejection_reason"),
    )
    return rows.withColumn("sentence", narrative.pattern_sentence()).withColumn("advice", narrative.recommendation())


@query(
    "variable_sentences", "I13", "name explanation",
    f"""SELECT name, CASE WHEN status = 'rejected' THEN name || ' was recovered in ' || floor(presence_rate * 100)::INT || '% of resamples and rejected: its score hardly varied across resamples.'
        ELSE name || ' was recovered in ' || floor(presence_rate * 100)::INT || '% of resamples; reliability is ' || CASE WHEN stability_score >= 0.8 THEN 'strong' ELSE 'moderate' END || '.' END AS explanation FROM {CUSTOMER_VARIABLES}""",
)
def variable_sentences(t: Tables) -> DataFrame:
    rows = customer_variables(t).withColumn("rejection_reason", F.lit("low_variance"))
    return rows.select("name", narrative.variable_sentence().alias("explanation"))


@query(
    "evidence_cards", "I14", "name headline confidence_level n_stats first_value affected_segment",
    """SELECT name, CASE WHEN imp <> 0 THEN name || ': improves predictions by +' || printf('%.1f', imp::DOUBLE) || '%' ELSE name || ': hidden factor detected with ' || tier || ' confidence' END AS headline, tier AS confidence_level,
         (e > 0)::INT + (p < 1)::INT + 1 + (imp <> 0)::INT + 1 AS n_stats, CASE WHEN e > 0 THEN printf('%.2f', e::DOUBLE) ELSE printf('p = %.4f', p::DOUBLE) END AS first_value, replace(seg, '_', ' ') || ' in range 1–2' AS affected_segment
       FROM (SELECT *, CASE WHEN st >= 0.8 AND hold THEN 'high' WHEN st >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM (
         SELECT c_name AS name, c_nationkey AS e, 0.25 AS p, c_custkey % 4 AS imp, (c_nationkey + 1) / 25 AS st, c_acctbal > 0 AS hold, 'seg_' || c_mktsegment AS seg FROM customer))""",
)
def evidence_cards(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("double").alias("effect_size"), F.lit(0.25).alias("p_value"),
        (F.col("c_custkey") % 4).cast("double").alias("improvement_pct"), ((F.col("c_nationkey") + 1) / 25).alias("stability_score"),
        ((F.col("c_nationkey") + 1) / 25).alias("presence_rate"), (F.col("c_acctbal") > 0).alias("holdout_validated"),
        F.concat(F.lit("seg_"), F.col("c_mktsegment")).alias("column_name"), F.lit("(1, 2]").alias("bin_value"), F.lit("subgroup").alias("pattern_type"),
        F.lit("validated").alias("status"), F.lit("").alias("rejection_reason"), F.lit(10).alias("sample_count"),
    )
    cards = narrative.evidence_card(rows)
    return cards.withColumn("n_stats", F.size("key_stats")).withColumn("first_value", F.element_at("key_stats", 1)["value"])


@query("access_counts", "I15", "user_id accesses", "SELECT user_id, count(*) AS accesses FROM events GROUP BY user_id")
def access_counts(t: Tables) -> DataFrame:
    return results.access_counts(t.events, "user_id")


SCORECARD_SQL = f"""(WITH k AS (SELECT run_id, pattern_type, count(*) AS c FROM {TYPED_PATTERNS} WHERE effect_size > 2 GROUP BY ALL),
   p AS (SELECT run_id, sum(c)::BIGINT AS patterns, arg_min(pattern_type, (-c, pattern_type)) AS top_type FROM k GROUP BY run_id),
   v AS (SELECT run_id, count(*) AS candidates, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'rejected') AS rejected FROM {TYPED_VARIABLES} GROUP BY run_id)
   SELECT coalesce(p.run_id, v.run_id) AS run_id, coalesce(patterns, 0) AS patterns, coalesce(candidates, 0) AS candidates, coalesce(validated, 0) AS validated, coalesce(rejected, 0) AS rejected, top_type,
     coalesce(patterns, 0) = 0 AS no_patterns, coalesce(candidates, 0) > 0 AND coalesce(validated, 0) = 0 AS all_unstable FROM p FULL JOIN v ON p.run_id = v.run_id)"""


def scorecard(t: Tables) -> DataFrame:
    return results.recovery_scorecard(typed_patterns(t).where(F.col("effect_size") > 2), typed_variables(t))


@query("recovery_scorecard", "I16", "run_id patterns candidates validated rejected top_type no_patterns all_unstable", f"SELECT * FROM {SCORECARD_SQL}")
def recovery_scorecard(t: Tables) -> DataFrame:
    return scorecard(t)


@query("best_run", "I16", "run_id validated", f"SELECT run_id, validated FROM {SCORECARD_SQL} ORDER BY validated DESC, patterns DESC, run_id LIMIT 1")
def best_run(t: Tables) -> DataFrame:
    return results.best_run(scorecard(t))


@query(
    "timing_summary", "I17", "runs fastest slowest mean_total_s:4 mean_model_s:4 mean_detect_s:4 sum_total_s:2",
    """WITH r AS (SELECT user_id AS run_id, sum(value) AS total_s, sum(value) FILTER (event_type = 'view') AS model_s, sum(value) FILTER (event_type = 'click') AS detect_s FROM events GROUP BY user_id)
       SELECT count(*) AS runs, arg_min(run_id, total_s) AS fastest, arg_max(run_id, total_s) AS slowest, avg(total_s) AS mean_total_s, avg(model_s) AS mean_model_s, avg(detect_s) AS mean_detect_s, sum(total_s) AS sum_total_s FROM r""",
)
def timing_summary(t: Tables) -> DataFrame:
    v = F.col("value")
    runs = t.events.groupBy(F.col("user_id").alias("run_id")).agg(
        F.sum(v).alias("total_s"), F.sum(F.when(F.col("event_type") == "view", v)).alias("model_s"),
        F.sum(F.when(F.col("event_type") == "click", v)).alias("detect_s"),
    )
    return results.timing_summary(runs)
