"""Folds, models, stacking and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import attribution, cv, models, regime
from residua.plans.catalog.a_sources import RIDGE_OOF, ridge_records
from residua.plans.catalog.b_profile import LABEL_DOCS, label_docs
from residua.plans.catalog.registry import ORDER_FRAME, Tables, fold_sql, query, uniform_sql
from residua.session import durable


def folded_orders(t: Tables) -> DataFrame:
    return cv.kfold(t.order_frame(), "o_orderkey").withColumn("y", F.col("o_totalprice"))


@query(
    "cv_strategy", "E1", "target n_unique strategy",
    """SELECT target, n_unique, CASE WHEN whole AND n_unique BETWEEN 2 AND 10 AND n / n_unique >= 30 THEN 'stratified' ELSE 'kfold' END AS strategy FROM (
         SELECT 'quality' AS target, count(*) AS n, count(DISTINCT quality) AS n_unique, true AS whole FROM labels
         UNION ALL SELECT 'o_totalprice', count(*), count(DISTINCT o_totalprice), false FROM orders
         UNION ALL SELECT 'l_linenumber', count(*), count(DISTINCT l_linenumber), true FROM lineitem
         UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), true FROM orders)
       UNION ALL SELECT 'by_time', count(DISTINCT value), 'timeseries' FROM events UNION ALL SELECT 'by_user', count(DISTINCT value), 'group' FROM events""",
)
def cv_strategy(t: Tables) -> DataFrame:
    cases = [
        ("quality", t.labels, "quality", {}), ("o_totalprice", t.orders, "o_totalprice", {}),
        ("l_linenumber", t.lineitem, "l_linenumber", {}), ("o_custkey", t.orders, "o_custkey", {}),
        ("by_time", t.events, "value", {"time_column": "ts"}), ("by_user", t.events, "value", {"group_column": "user_id"}),
    ]
    out = None
    for name, df, target, more in cases:
        chosen = cv.resolve_strategy(df, target, **more)
        part = df.agg(F.lit(name).alias("target"), F.count_distinct(target).alias("n_unique"), F.lit(chosen).alias("strategy"))
        out = part if out is None else out.unionByName(part)
    return out


@query("kfold_assignment", "E2", "o_orderkey fold", f"SELECT o_orderkey, {fold_sql('o_orderkey')} AS fold FROM orders")
def kfold_assignment(t: Tables) -> DataFrame:
    return cv.kfold(t.orders.select("o_orderkey"), "o_orderkey")


@query(
    "stratified_folds", "E3", "o_orderkey fold",
    "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':fold42'), o_orderkey) - 1) % 5)::INT AS fold FROM orders",
)
def stratified_folds(t: Tables) -> DataFrame:
    return cv.stratified_kfold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


TS_SQL = """(SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN -1 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) END AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events))"""


@query("timeseries_folds", "E4", "event_id fold", f"SELECT event_id, fold::INT AS fold FROM {TS_SQL}")
def timeseries_folds(t: Tables) -> DataFrame:
    return cv.timeseries_folds(t.events.select("ts", "event_id"), "ts", "event_id", 5)


@query(
    "timeseries_oof", "E4 E6", "fold n n_train prediction_sum:2",
    f"""WITH s AS (SELECT *, user_id::DOUBLE AS x FROM {TS_SQL}), f AS (SELECT DISTINCT fold, n - 5 * (n // 6) + fold * (n // 6) - 100 AS cut FROM s WHERE fold >= 0),
         tr AS (SELECT f.fold, count(*) AS n_train, avg(x) AS mx, avg(value) AS my, covar_pop(x, value) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
                FROM f JOIN s ON s.pos < f.cut GROUP BY f.fold)
        SELECT s.fold::INT AS fold, count(*) AS n, max(n_train) AS n_train, sum(my + sxy / (sxx + 1.0) * (x - mx)) AS prediction_sum
        FROM s JOIN tr ON s.fold = tr.fold GROUP BY s.fold""",
)
def timeseries_oof(t: Tables) -> DataFrame:
    base = cv.timeseries_folds(t.events.select("ts", "event_id", "user_id", "value"), "ts", "event_id", 5)
    n = base.count()
    size, first = cv.timeseries_bounds(n, 5)
    got = models.ridge_timeseries_oof(base, ["user_id"], "value", n, 5, gap=100)
    n_train = F.lit(first) + F.col("fold") * F.lit(size) - F.lit(100)
    return got.table.where(F.col("fold") >= 0).groupBy("fold").agg(
        F.count("*").alias("n"), F.max(n_train).cast("long").alias("n_train"), F.sum("prediction").alias("prediction_sum")
    )


@query(
    "timeseries_train_rows", "E6", "fold n n_train:int last_train",
    f"""WITH s AS {TS_SQL}, b AS (SELECT count(*) AS n, count(*) // 6 AS size FROM s),
         r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
       SELECT f.fold::INT AS fold, b.size AS n, count(*) AS n_train, max(r.pos) AS last_train
       FROM (SELECT unnest(range(0, 5)) AS fold) f, b, r WHERE r.pos < b.n - 5 * b.size + f.fold * b.size - 100 GROUP BY f.fold, b.size""",
)
def timeseries_train_rows(t: Tables) -> DataFrame:
    """What a model of each time fold is fitted on, as seen by the model itself."""
    base = cv.timeseries_folds(t.events.select("ts", "event_id", "user_id", "value"), "ts", "event_id", 5)
    seen: list[DataFrame] = []

    class Probe:
        def fit(self, df, features, target):
            seen.append(df.agg(F.count("*").alias("n_train"), F.max("pos").alias("last_train")).withColumn("fold", F.lit(len(seen))))
            return self

        def predict(self, df):
            return df.withColumn("prediction", F.lit(0.0))

        def importance(self):
            return {}

    table, _ = models.cross_fit(base, Probe, ["user_id"], "value", 5, base.count(), 100)
    trained = seen[0]
    for more in seen[1:]:
        trained = trained.unionByName(more)
    return table.groupBy("fold").agg(F.count("*").alias("n")).join(trained, "fold").select("fold", "n", "n_train", "last_train")


@query("group_folds", "E5", "event_id fold", f"SELECT event_id, floor({uniform_sql('user_id', 'group')} * 5)::INT AS fold FROM events")
def group_folds(t: Tables) -> DataFrame:
    return cv.group_kfold(t.events.select("event_id", "user_id"), "user_id")


@query("group_folds_balanced", "E5", "fold groups rows")
def group_folds_balanced(t: Tables) -> DataFrame:
    got = cv.group_kfold(t.events.select("event_id", "user_id"), "user_id", balance=True)
    return got.groupBy("fold").agg(F.count_distinct("user_id").alias("groups"), F.count("*").alias("rows"))


@query("ridge_oof", "E6 E10", "o_orderkey fold prediction:3 residual:3", f"WITH {RIDGE_OOF} SELECT o_orderkey, fold, prediction, residual FROM oof")
def ridge_oof(t: Tables) -> DataFrame:
    return models.ridge_oof(folded_orders(t), ["c_acctbal"], "y").table


@query(
    "fold_scores", "E7 E8", "fold n r2:6 rmse:3",
    f"""WITH {RIDGE_OOF} SELECT fold, count(*) AS n, 1 - sum(residual * residual) / (var_pop(y) * count(*)) AS r2, sqrt(avg(residual * residual)) AS rmse FROM oof GROUP BY fold""",
)
def fold_scores(t: Tables) -> DataFrame:
    return cv.fold_scores(models.ridge_oof(folded_orders(t), ["c_acctbal"], "y").table)


@query(
    "score_summary", "E7", "mean_score:6 std_score:6",
    f"""WITH {RIDGE_OOF}, s AS (SELECT fold, 1 - sum(residual * residual) / (var_pop(y) * count(*)) AS r2 FROM oof GROUP BY fold)
        SELECT avg(r2) AS mean_score, stddev_pop(r2) AS std_score FROM s""",
)
def score_summary(t: Tables) -> DataFrame:
    return cv.score_summary(cv.fold_scores(models.ridge_oof(folded_orders(t), ["c_acctbal"], "y").table), "r2")


AUC_SQL = f"""(SELECT doc_id, {fold_sql('doc_id')} AS fold, quality AS y, round(length(text) / 100.0) AS prediction FROM {LABEL_DOCS})"""


def scored_labels(t: Tables) -> DataFrame:
    df = cv.kfold(label_docs(t), "doc_id")
    return df.select("doc_id", "fold", F.col("quality").alias("y"), F.round(F.length("text") / 100.0).alias("prediction"))


@query(
    "fold_auc", "E7", "fold n auc:6",
    f"""WITH s AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY prediction) + (count(*) OVER (PARTITION BY fold, prediction) - 1) / 2.0 AS r FROM {AUC_SQL})
        SELECT fold, count(*) AS n, coalesce((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
          / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0), 0.0) AS auc FROM s GROUP BY fold""",
)
def fold_auc(t: Tables) -> DataFrame:
    return cv.fold_auc(scored_labels(t))


@query(
    "fold_accuracy", "E7", "fold accuracy:6",
    f"SELECT fold, avg((round(least(1.0, prediction / 20)) = y)::INT) AS accuracy FROM {AUC_SQL} GROUP BY fold",
)
def fold_accuracy(t: Tables) -> DataFrame:
    return cv.fold_accuracy(scored_labels(t).withColumn("prediction", F.least(F.lit(1.0), F.col("prediction") / 20)))


@query(
    "nan_predictions", "E6", "fold n total:3",
    f"""WITH s AS (SELECT fold, CASE WHEN y = 1 THEN prediction END AS p FROM {AUC_SQL}), m AS (SELECT fold, avg(p) AS m FROM s GROUP BY fold)
        SELECT s.fold, count(*) AS n, sum(coalesce(p, m)) AS total FROM s JOIN m ON s.fold = m.fold GROUP BY s.fold""",
)
def nan_predictions(t: Tables) -> DataFrame:
    holes = scored_labels(t).withColumn("prediction", F.when(F.col("y") == 1, F.col("prediction")).otherwise(F.lit(float("nan"))))
    return cv.fill_missing_predictions(holes).groupBy("fold").agg(F.count("*").alias("n"), F.sum("prediction").alias("total"))


@query(
    "importance_stability", "E9", "feature mean_importance:6 cv:3 unstable",
    """WITH k AS (SELECT event_type AS feature, user_id AS fold, sum(value) AS v FROM events GROUP BY ALL), t AS (SELECT fold, sum(v) AS s FROM k GROUP BY fold),
         i AS (SELECT feature, v / s AS imp FROM k JOIN t ON k.fold = t.fold), n AS (SELECT count(DISTINCT user_id) AS n FROM events),
         a AS (SELECT feature, sum(imp) / max(n) AS m, sqrt(greatest(0, sum(imp * imp) / max(n) - (sum(imp) / max(n)) * (sum(imp) / max(n)))) AS s FROM i, n GROUP BY feature)
       SELECT feature, m AS mean_importance, round(s / m, 4) AS cv, round(s / m, 4) > 0.5 AS unstable FROM a""",
)
def importance_stability(t: Tables) -> DataFrame:
    by_user = t.events.groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("fold")).agg(F.sum("value").alias("v"))
    totals = by_user.groupBy("fold").agg(F.sum("v").alias("s"))
    shares = by_user.join(totals, "fold").withColumn("importance", F.col("v") / F.col("s"))
    folds = t.events.agg(F.count_distinct("user_id")).first()[0]
    return cv.importance_stability(shares, folds)


@query(
    "ridge_model", "E10", "feature slope:9 intercept:3 importance:6",
    f"""WITH m AS (SELECT covar_pop(c_acctbal, o_totalprice) * count(*) AS sxy, var_pop(c_acctbal) * count(*) AS sxx, avg(c_acctbal) AS mx, avg(o_totalprice) AS my FROM {ORDER_FRAME})
        SELECT 'c_acctbal' AS feature, sxy / (sxx + 1) AS slope, my - mx * sxy / (sxx + 1) AS intercept, 1.0 AS importance FROM m""",
)
def ridge_model(t: Tables) -> DataFrame:
    m = models.RidgeModel().fit(t.order_frame(), ["c_acctbal"], "o_totalprice")
    rows = [(f, float(b), m.intercept, m.importance()[f]) for f, b in zip(m.features, m.beta)]
    return t.spark.createDataFrame(rows, "feature string, slope double, intercept double, importance double")


@query("logistic_oof", "E11 E15", "fold n mean_p:3 deviance:2")
def logistic_oof(t: Tables) -> DataFrame:
    base = cv.kfold(label_docs(t), "doc_id", 3).select("doc_id", "fold", "quality", (F.length("text") / 1000.0).alias("kchars"), "toxic")
    table, _ = models.cross_fit(base, lambda: models.choose_model("linear", "binary"), ["kchars", "toxic"], "quality", 3)
    d = cv.deviance_residual(F.col("quality"), F.col("prediction"))
    return table.groupBy("fold").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_p"), F.sum(d * d).alias("deviance"))


def tree_frame(t: Tables) -> DataFrame:
    """Orders with a price that depends on two features and their interaction."""
    x1, x2 = F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")
    y = F.col("o_totalprice") / 1e6 + x1 * 2 + F.when((x1 > 5) & (x2 > 12), 10.0).otherwise(0.0)
    return t.order_frame().select("o_orderkey", x1.alias("x1"), x2.alias("x2"), F.col("o_custkey").cast("double").alias("x3"), y.alias("y"))


FEATURES = ["x1", "x2", "x3"]
FOLD_ROWS = f"SELECT {fold_sql('o_orderkey')} AS fold, count(*) AS n, true AS good FROM {ORDER_FRAME} GROUP BY 1"


@query("boosted_trees_oof", "E12", "fold n good", FOLD_ROWS)
def boosted_trees_oof(t: Tables) -> DataFrame:
    """Five folds of 200 trees of depth 6; the planted structure is found in each."""
    table, _ = models.cross_fit(cv.kfold(tree_frame(t), "o_orderkey", 5), models.boosted_regressor, FEATURES, "y", 5)
    return cv.fold_scores(table).select("fold", "n", (F.col("r2") > 0.9).alias("good"))


@query("boosted_classifier_oof", "E13", "fold n good", FOLD_ROWS)
def boosted_classifier_oof(t: Tables) -> DataFrame:
    base = cv.kfold(tree_frame(t).withColumn("y", (F.col("y") > 12).cast("int")), "o_orderkey", 5)
    table, _ = models.cross_fit(base, lambda: models.choose_model("trees", "binary"), FEATURES, "y", 5)
    return cv.fold_auc(table).select("fold", "n", (F.col("auc") > 0.95).alias("good"))


@query("boosted_multiclass_oof", "E13", "fold n good", FOLD_ROWS)
def boosted_multiclass_oof(t: Tables) -> DataFrame:
    """Three classes by softmax; probabilities add up to one."""
    level = F.when(F.col("y") > 18, 2).when(F.col("y") > 8, 1).otherwise(0)
    base = cv.kfold(tree_frame(t).withColumn("y", level), "o_orderkey", 5)
    table, _ = models.cross_fit(base, lambda: models.choose_model("trees", "multiclass"), FEATURES, "y", 5)
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s + p)
    right = F.when((F.col("prediction") == F.col("y")) & (F.abs(total - 1) < 1e-9), 1.0).otherwise(0.0)
    return table.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), (F.avg(right) > 0.9).alias("good"))


@query(
    "logistic_balance", "E11", "fold n good",
    f"WITH b AS (SELECT {fold_sql('o_orderkey')} AS fold FROM {ORDER_FRAME}) SELECT fold, (SELECT count(*) FROM b) - count(*) AS n, true AS good FROM b GROUP BY fold",
)
def logistic_balance(t: Tables) -> DataFrame:
    """The intercept is free, so on the rows a fold's model is fitted on its probabilities add up to the ones."""
    base = durable(cv.kfold(tree_frame(t).withColumn("y", (F.col("y") > 12).cast("int")), "o_orderkey", 5))
    fitted = models.LogisticModel().fit_all(base, FEATURES, "y", [F.col("fold") != f for f in range(5)])
    out = None
    for f, m in enumerate(fitted):
        part = base.where(F.col("fold") != f).agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"), (F.abs(F.sum(m.column() - F.col("y"))) < 1e-4).alias("good"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stacked_binary", "E19", "fold n good", FOLD_ROWS)
def stacked_binary(t: Tables) -> DataFrame:
    """A logistic meta-model over two logistic bases, better than the worse of them."""
    base = durable(cv.kfold(tree_frame(t).withColumn("y", (F.col("y") > 12).cast("int")), "o_orderkey", 5))
    tables = {c: models.cross_fit(base, models.LogisticModel, [c], "y", 5)[0] for c in ("x1", "x2")}
    table, _ = models.stack_oof(tables, "o_orderkey", problem="binary")
    weak = cv.fold_auc(tables["x2"]).select("fold", F.col("auc").alias("weak"))
    return cv.fold_auc(table).join(F.broadcast(weak), "fold").select("fold", "n", (F.col("auc") > F.col("weak")).alias("good"))


@query(
    "deviance_residual", "E15", "doc_id residual:6",
    f"""SELECT doc_id, sign(y - p) * sqrt(-2 * (y * ln(p) + (1 - y) * ln(1 - p))) AS residual
        FROM (SELECT doc_id, quality AS y, least(greatest(length(text) / 4000.0, 1e-7), 1 - 1e-7) AS p FROM {LABEL_DOCS})""",
)
def deviance_residual(t: Tables) -> DataFrame:
    return label_docs(t).select("doc_id", cv.deviance_residual(F.col("quality"), F.length("text") / 4000.0).alias("residual"))


@query(
    "residual_records", "E16", "model o_orderkey fold actual:2 predicted:3 residual:3 abs_residual:3 feature_vector",
    f"""WITH {RIDGE_OOF} SELECT 'linear' AS model, o_orderkey, fold, y AS actual, prediction AS predicted, residual, abs(residual) AS abs_residual,
        '{{"c_acctbal":' || c_acctbal::VARCHAR || '}}' AS feature_vector FROM oof""",
)
def residual_records(t: Tables) -> DataFrame:
    return ridge_records(t)


@query(
    "alpha_sweep", "E17", "alpha mse:1",
    f"""WITH {RIDGE_OOF}, a AS (SELECT unnest([0.001, 1.0, 1e6, 1e9, 1e12]) AS alpha),
        c2 AS (SELECT a.alpha, fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + a.alpha) AS b, sx / n AS mx, sy / n AS my FROM tr, a)
        SELECT alpha, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS mse FROM f JOIN c2 ON f.fold = c2.fold GROUP BY alpha""",
)
def alpha_sweep(t: Tables) -> DataFrame:
    rows = models.alpha_sweep(folded_orders(t), ["c_acctbal"], "y", [0.001, 1.0, 1e6, 1e9, 1e12])
    return t.spark.createDataFrame(rows, "alpha double, mse double")


@query("tree_grid_search", "E17", "depth trees r2:4 best")
def tree_grid_search(t: Tables) -> DataFrame:
    base = cv.kfold(tree_frame(t), "o_orderkey", 2)
    rows, names, best = models.tune_trees(base, FEATURES, "y", {"depth": [2, 3], "trees": [3, 20]}, 2)
    rows = [(*r, i == best) for i, r in enumerate(rows)]
    return t.spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", r2 double, best boolean")


@query("ridge_search", "E17", "trial:int rising inside", "SELECT unnest(range(0, 30))::INT AS trial, true AS rising, true AS inside")
def ridge_search(t: Tables) -> DataFrame:
    """Thirty trials of the sequential search over the ridge penalty: the best so far never falls."""
    from residua.operators import search

    found = search.tune(durable(folded_orders(t).select("fold", "c_acctbal", "y")), ["c_acctbal"], "y", "linear", 5)
    low, high, _ = models.SPACES["linear"]["alpha"]
    before = [float("-inf"), *[x.best for x in found.trials]]
    rows = [(x.number, bool(x.best >= b), bool(low <= x.params["alpha"] <= high)) for x, b in zip(found.trials, before)]
    return t.spark.createDataFrame(rows, "trial int, rising boolean, inside boolean")


def base_tables(t: Tables) -> dict[str, DataFrame]:
    base = folded_orders(t)
    return {
        "balance": models.ridge_oof(base, ["c_acctbal"], "y").table,
        "customer": models.ridge_oof(base, ["c_custkey"], "y").table,
    }


def _base_sql() -> str:
    parts = []
    for name, x in (("balance", "c_acctbal"), ("customer", "c_custkey")):
        parts.append(
            f"""{name}_t AS (SELECT k.fold, avg(b.{x}) AS mx, avg(b.o_totalprice) AS my, covar_pop(b.{x}::DOUBLE, b.o_totalprice) * count(*) AS sxy, var_pop(b.{x}) * count(*) AS sxx
             FROM (SELECT DISTINCT fold FROM base) k JOIN base b ON b.fold <> k.fold GROUP BY k.fold)"""
        )
    return f"""base AS (SELECT *, {fold_sql('o_orderkey')} AS fold FROM {ORDER_FRAME}), {', '.join(parts)},
      both AS (SELECT o_orderkey, base.fold, o_totalprice AS y, b.my + b.sxy / (b.sxx + 1) * (c_acctbal - b.mx) AS p1, c.my + c.sxy / (c.sxx + 1) * (c_custkey - c.mx) AS p2
        FROM base JOIN balance_t b ON base.fold = b.fold JOIN customer_t c ON base.fold = c.fold)""".replace("both AS", "bp AS")


def _meta_sql(group: str) -> str:
    """2 x 2 ridge solve from grouped moments."""
    return f"""(SELECT {group} m1, m2, my, (s1y * (s22 + 1) - s2y * s12) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1,
      (s2y * (s11 + 1) - s1y * s12) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2"""


_SUMS = """avg(p1) AS m1, avg(p2) AS m2, avg(y) AS my, var_pop(p1) * count(*) AS s11, var_pop(p2) * count(*) AS s22, covar_pop(p1, p2) * count(*) AS s12,
  covar_pop(p1, y) * count(*) AS s1y, covar_pop(p2, y) * count(*) AS s2y"""


@query(
    "stacked_oof", "E19", "o_orderkey fold prediction:2",
    f"""WITH {_base_sql()}, g AS (SELECT k.fold, {_SUMS} FROM (SELECT DISTINCT fold FROM bp) k JOIN bp ON bp.fold <> k.fold GROUP BY k.fold), c AS {_meta_sql('fold,')} FROM g)
        SELECT o_orderkey, bp.fold, my + b1 * (p1 - m1) + b2 * (p2 - m2) AS prediction FROM bp JOIN c ON bp.fold = c.fold""",
)
def stacked_oof(t: Tables) -> DataFrame:
    return models.stack_oof(base_tables(t), "o_orderkey")[0]


@query(
    "blend_weights", "E20", "base weight:5",
    f"""WITH {_base_sql()}, g AS (SELECT {_SUMS} FROM bp), c AS {_meta_sql('')} FROM g)
        SELECT 'balance' AS base, abs(b1) / (abs(b1) + abs(b2)) AS weight FROM c UNION ALL SELECT 'customer', abs(b2) / (abs(b1) + abs(b2)) FROM c""",
)
def blend_weights(t: Tables) -> DataFrame:
    _, stack = models.stack_oof(base_tables(t), "o_orderkey")
    return t.spark.createDataFrame(list(stack.weights().items()), "base string, weight double")


@query(
    "stack_predict", "E21", "o_orderkey prediction:0",
    f"""WITH {_base_sql()}, g AS (SELECT {_SUMS} FROM bp), c AS {_meta_sql('')} FROM g)
        SELECT o_orderkey, my + b1 * (o_totalprice - m1) + b2 * (c_acctbal - m2) AS prediction FROM {ORDER_FRAME}, c""",
)
def stack_predict(t: Tables) -> DataFrame:
    _, stack = models.stack_oof(base_tables(t), "o_orderkey")
    fresh = t.order_frame().select("o_orderkey", F.col("o_totalprice").alias("balance"), F.col("c_acctbal").alias("customer"))
    return stack.predict(fresh)


@query(
    "linear_contributions", "E22", "o_orderkey shap_c_acctbal:4",
    f"""WITH m AS (SELECT covar_pop(c_acctbal, o_totalprice) * count(*) / (var_pop(c_acctbal) * count(*) + 1) AS b, avg(c_acctbal) AS mx FROM {ORDER_FRAME})
        SELECT o_orderkey, (c_acctbal - mx) * b AS shap_c_acctbal FROM {ORDER_FRAME}, m""",
)
def linear_contributions(t: Tables) -> DataFrame:
    df = t.order_frame()
    return attribution.linear_contributions(df, models.RidgeModel().fit(df, ["c_acctbal"], "o_totalprice"), ["o_orderkey"])


@query(
    "mean_abs_contribution", "E24 F10", "feature importance:4",
    f"""WITH m AS (SELECT covar_pop(c_acctbal, o_totalprice) * count(*) / (var_pop(c_acctbal) * count(*) + 1) AS b, avg(c_acctbal) AS mx FROM {ORDER_FRAME})
        SELECT 'c_acctbal' AS feature, avg(abs((c_acctbal - mx) * b)) AS importance FROM {ORDER_FRAME}, m""",
)
def mean_abs_contribution(t: Tables) -> DataFrame:
    return attribution.mean_abs(linear_contributions(t))


@query("tree_contributions", "E23 E24", "feature importance:4 largest_gap:6")
def tree_contributions(t: Tables) -> DataFrame:
    df = tree_frame(t)
    model = models.boosted_regressor().fit(df, FEATURES, "y")
    parts = attribution.tree_contributions(df, model, "o_orderkey")
    gap = _gaps(df, parts, model).agg(F.max("gap").alias("largest_gap"))
    return attribution.mean_abs(parts).join(F.broadcast(gap))


def _gaps(df: DataFrame, parts: DataFrame, model: models.BoostedModel) -> DataFrame:
    total = F.col("base_value") + F.col("shap_x1") + F.col("shap_x2") + F.col("shap_x3")
    return parts.join(model.predict(df).select("o_orderkey", "prediction"), "o_orderkey").select(F.abs(total - F.col("prediction")).alias("gap"))


@query("tree_contribution_sums", "E23", "rows exact", f"SELECT count(*) AS rows, count(*) AS exact FROM {ORDER_FRAME}")
def tree_contribution_sums(t: Tables) -> DataFrame:
    """For every row the contributions and the base value add up to the prediction."""
    df = tree_frame(t)
    model = models.boosted_regressor(trees=20).fit(df, FEATURES, "y")
    gaps = _gaps(df, attribution.tree_contributions(df, model, "o_orderkey"), model)
    return gaps.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("gap") < 1e-6).alias("exact"))


@query("tree_interactions", "E23 E25", "feature_a feature_b strength:6")
def tree_interactions(t: Tables) -> DataFrame:
    df = tree_frame(t)
    return regime.rank_interactions(attribution.tree_interactions(df, models.boosted_regressor().fit(df, FEATURES, "y")), 10)


@query(
    "interaction_strength", "E26", "feature_a feature_b strength:9",
    """WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp, avg(l_tax) AS mt FROM lineitem),
         d AS (SELECT l_quantity - mq AS q, l_extendedprice - mp AS p, (l_quantity - mq) * (l_extendedprice - mp) AS z, l_tax - mt + CASE WHEN l_quantity > 25 AND l_extendedprice > 50000 THEN 1 ELSE 0 END AS e FROM lineitem, m),
         c AS (SELECT corr(z, e) AS ze, corr(z, q) AS zq, corr(z, p) AS zp, corr(e, q) AS eq, corr(e, p) AS ep, corr(q, p) AS qp FROM d),
         s AS (SELECT (ze - zq * eq) / sqrt((1 - zq * zq) * (1 - eq * eq)) AS ze_q, (zp - zq * qp) / sqrt((1 - zq * zq) * (1 - qp * qp)) AS zp_q, (ep - eq * qp) / sqrt((1 - eq * eq) * (1 - qp * qp)) AS ep_q FROM c)
       SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, pow((ze_q - zp_q * ep_q) / sqrt((1 - zp_q * zp_q) * (1 - ep_q * ep_q)), 2) AS strength FROM s""",
)
def interaction_strength(t: Tables) -> DataFrame:
    bump = F.when((F.col("l_quantity") > 25) & (F.col("l_extendedprice") > 50000), 1).otherwise(0)
    df = t.lineitem.withColumn("e", F.col("l_tax") + bump)
    return regime.interaction_strengths(df, ["l_quantity", "l_extendedprice"], "e")


