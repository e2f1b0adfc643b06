"""The whole analysis as one driver function over lazy tables.

Only small summary tables reach the driver: column facts, fold statistics, patterns, rules
and bootstrap results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.config import Options
from residua.functions import derive, expr
from residua.operators import bootstrap, causal, cluster, cv, models, patterns, prep, regime, rules, scan, selection, sparse, temporal
from residua.operators.profile import column_facts, problem_type, target_facts
from residua.session import durable
from residua.sources import sinks

PATTERN_SCHEMA = (
    "pattern_type string, column_name string, bin_value string, effect_size double, p_value double, adjusted_p_value double, "
    "sample_count long, mean_residual double, std_residual double, confidence double, models string, definition string"
)


@dataclass
class Result:
    """What a run found."""

    oof: DataFrame
    scores: DataFrame
    patterns: list[dict]
    rules: list[rules.Rule]
    variables: DataFrame
    selection: list[dict]
    problem: str
    events: list[tuple[str, str]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    key: str = "row_key"

    def validated_rules(self) -> list[rules.Rule]:
        good = {r["name"] for r in self.variables.where(F.col("status") == "validated").select("name").collect()}
        return [r for r in self.rules if r.name in good]

    def pattern_table(self) -> DataFrame:
        """The patterns as rows; the definition holds derived columns and cluster centres as JSON."""
        number = lambda v: None if v is None else float(v)
        rows = [
            (
                p["pattern_type"], p.get("column_name"), p.get("bin_value"), number(p.get("effect_size")), number(p.get("p_value")), number(p.get("adjusted_p_value")),
                p.get("sample_count"), number(p.get("mean_residual")), number(p.get("std_residual")), number(p.get("confidence")), ",".join(p.get("models", [])),
                json.dumps({k: p[k] for k in ("derived", "cluster_center", "feature_a", "feature_b") if p.get(k)}, sort_keys=True),
            )
            for p in self.patterns
        ]
        return self.oof.sparkSession.createDataFrame(rows, PATTERN_SCHEMA)

    def save(self, root: str, run_id: str) -> None:
        """Residuals of every model, patterns, variables, fold metrics and events below ``root``, by run."""
        spark = self.oof.sparkSession
        for kind, table in self.tables.items():
            sinks.write_residuals(cv.residual_records(table, self.key, model=kind), root, run_id)
        sinks.write_patterns(self.pattern_table(), root, run_id)
        sinks.write_variables(self.variables, root, run_id)
        sinks.write_fold_metrics(self.scores, root, run_id)
        sinks.write_events(spark.createDataFrame(self.events, "phase string, message string"), root, run_id)


def _prepare(df: DataFrame, o: Options) -> tuple[list[str], list[str], str]:
    """(model features, scan features, problem type) by semantic column type."""
    facts = column_facts(df).collect()
    # a measured (floating-point) column is a feature even when its name looks like an id
    types = {
        r["column_name"]: "numeric" if r["detected_type"] == "id" and r["kind"] == "float" else r["detected_type"]
        for r in facts
    } | o.column_types
    features = prep.usable_features(df, o.target, types, o.time_column, (o.key,))
    flat = set(prep.zero_variance(df, [c for c in features if expr.is_numeric(df.schema[c])]))
    features = [c for c in features if c not in flat]
    problem = problem_type(target_facts(df, o.target), o.problem_type).first()["problem"]
    return features, [c for c in features if expr.is_numeric(df.schema[c])], problem


def cross_fitted(train: DataFrame, features: list[str], o: Options, problem: str) -> dict[str, DataFrame]:
    """Out-of-fold tables (key, fold, y, prediction, residual) per model.  Columns of very many values have a
    coefficient per value in the ridge model; other models and time-ordered runs see how frequent a value is."""
    encoder = prep.Preprocessor().fit(train, features)
    strategy = cv.resolve_strategy(train, o.target, o.cv_strategy, o.time_column, o.group_column)
    folded = cv.assign_folds(train, strategy, o.key, o.target, o.cv_folds, o.seed, o.time_column, o.group_column)
    ordered = strategy == "timeseries"
    keep = [o.key, "fold", *(["pos"] if ordered else [])]
    matrix = durable(encoder.transform(folded.withColumn("y", expr.col(o.target).cast("double")), [*keep, "y"]))
    names = [c for c in matrix.columns if c not in (*keep, "y", *encoder.wide)]
    if encoder.wide:
        matrix = durable(prep.with_frequencies(matrix, encoder.wide))
    numbers = [*names, *[f"{c}_frequency" for c in encoder.wide]]
    out = {}
    for kind in o.models:
        if kind == "linear" and problem == "regression" and encoder.wide and not ordered:
            table, _ = sparse.sparse_oof(matrix, names, encoder.wide, "y", o.cv_folds, o.ridge_alpha)
        elif kind == "linear" and problem == "regression":
            if ordered:
                n = matrix.count()
                got = models.ridge_timeseries_oof(matrix, numbers, "y", n, o.cv_folds, o.cv_gap, o.ridge_alpha)
            else:
                got = models.ridge_oof(matrix, names, "y", o.ridge_alpha)
            table = got.table
        else:
            table, _ = models.cross_fit(
                matrix, lambda kind=kind: models.choose_model(kind, problem, **({} if kind == "linear" else {"seed": o.seed})), numbers, "y", o.cv_folds,
                matrix.count() if ordered else None, o.cv_gap,
            )
            if problem == "binary":
                table = table.withColumn("residual", cv.deviance_residual(F.col("y"), F.col("prediction")))
        out[kind] = durable(table.select(o.key, "fold", "y", "prediction", "residual"))
    return out


def _as_dicts(df: DataFrame, kind: str) -> list[dict]:
    return [{**r.asDict(), "pattern_type": kind} for r in df.collect()]


def detect(
    scored: DataFrame, features: list[str], numeric: list[str], o: Options, middles: dict[str, float | None] | None = None
) -> tuple[list[dict], DataFrame | None]:
    """Pattern records of one residual column (``residual``), and the rows labelled by cluster.  ``middles``: medians of
    the numeric features, which derived columns are cut at; they are stored with the patterns."""
    found: list[dict] = []
    labelled = None
    strengths = regime.interaction_strengths(scored, numeric, "residual") if len(numeric) > 1 else None
    scan_frame, scan_features, trees = scored, list(features), {}
    if strengths is not None:
        middles = middles or prep.medians(scored, numeric)
        best = [(r["feature_a"], r["feature_b"]) for r in prep.top_pairs(strengths, o.top_interactions).collect()]
        trees = prep.interaction_trees([(a, b) for a, b in best if middles[a] is not None and middles[b] is not None], middles)
        scan_frame = scored.withColumns({n: derive.compiled(t) for n, t in trees.items()}) if trees else scored
        scan_features += list(trees)
    gates = o.gates
    found += _as_dicts(
        scan.subgroup_patterns(scan_frame, scan_features, "residual", o.n_bins, gates["min_bin_rows"], gates["min_effect"], o.fdr_alpha),
        "subgroup",
    )
    for p in found:
        if p["column_name"] in trees:
            p["derived"] = trees[p["column_name"]]
    if o.cluster and numeric:
        labelled, accepted = cluster.cluster_patterns(scored, numeric, "residual")
        for r in cluster.with_effect(accepted, labelled).collect():
            row = r.asDict()
            row["cluster_center"] = {c: row.pop(f"center_{c}") for c in numeric}
            row.update(pattern_type="cluster", column_name=None, bin_value=str(row["cluster"]), p_value=None)
            found.append(row)
    if o.time_column:
        found += [
            {**r.asDict(), "bin_value": r["detail"], "sample_count": None}
            for r in temporal.temporal_patterns(scored, o.time_column, o.key, "residual").collect()
        ]
    if strengths is not None:
        top = [(r["feature_a"], r["feature_b"]) for r in regime.rank_interactions(strengths, 10).collect()]
        if top:
            for r in regime.interaction_correlations(scored, numeric, "residual", top).where("significant").collect():
                found.append({**r.asDict(), "pattern_type": "interaction", "column_name": None, "bin_value": f"{r['feature_a']}*{r['feature_b']}", "effect_size": abs(r["r"]), "sample_count": r["n"]})
    if o.variance_regimes and numeric:
        for r in regime.variance_regimes(scored, numeric, "residual").collect():
            found.append({**r.asDict(), "bin_value": None, "effect_size": None, "sample_count": r["n"]})
    return found, labelled


def fold_metrics(table: DataFrame, problem: str) -> DataFrame:
    """Scores of each fold: R-squared and RMSE, or accuracy (and for binary targets ROC-AUC)."""
    if problem == "regression":
        return cv.fold_scores(table)
    accuracy = cv.fold_accuracy(table)
    if problem == "binary":
        return cv.fold_auc(table).join(F.broadcast(accuracy), "fold")  # a row a fold
    return accuracy


def score_patterns(found: list[dict], n_rows: int, k: int) -> list[dict]:
    """Composite score, gates and per-column de-duplication; variance regimes bypass it, time
    patterns make no rule."""
    scored, bypass = [], []
    for p in found:
        if p["pattern_type"] == "variance_regime":
            bypass.append(p)
        elif p["pattern_type"] in ("subgroup", "cluster", "interaction"):
            effect, coverage = abs(p["effect_size"]), p["sample_count"] / n_rows
            gate = p["pattern_type"] == "interaction" or (effect >= patterns.MIN_EFFECT and coverage >= patterns.MIN_COVERAGE)
            if gate and p["sample_count"] >= patterns.MIN_SAMPLES:
                score = patterns.EFFECT_WEIGHT * effect + patterns.COVERAGE_WEIGHT * coverage
                scored.append({**p, "composite_score": score})
    scored.sort(key=lambda p: -p["composite_score"])
    seen, kept = set(), []
    for p in scored:
        slot = (p.get("slot") or p.get("column_name") or p["bin_value"], p["pattern_type"])
        if slot not in seen:
            seen.add(slot)
            kept.append(p)
    return kept[:k] + bypass


VARIABLE_SCHEMA = (
    "name string, pattern_type string, column_name string, bin_value string, status string, presence_rate double, "
    "stability_score double, importance double, penalty double, causal_warnings string, rejection_reason string, "
    "holdout_validated boolean, effect_size double, sample_count long, improvement_pct double, rule string"
)


def discover(df: DataFrame, o: Options) -> Result:
    """Profile, cross-fit, scan, construct, check and rank."""
    clash = {"fold", "pos", "y", "prediction", "residual", "is_holdout"} & (set(df.columns) - {o.target})
    if clash:
        raise ValueError(f"column names used by the run itself: {sorted(clash)}")
    df = durable(df)  # dozens of passes read it: what it was joined from is read and broadcast once
    features, numeric, problem = _prepare(df, o)
    n_rows = df.count()
    if o.time_column and prep.split_allowed(n_rows, o.test_size):
        split = prep.with_temporal_holdout(df, o.time_column, o.key, o.test_size)
        split = split.drop("pos")
    elif prep.split_allowed(n_rows, o.test_size):
        split = prep.with_holdout(df, o.key, o.test_size, o.seed)
    else:
        split = df.withColumn("is_holdout", F.lit(False))
    train, holdout = split.where(~F.col("is_holdout")).drop("is_holdout"), split.where("is_holdout").drop("is_holdout")
    events = [("profile", f"{len(features)} features, {problem} target"), ("split", f"{n_rows} rows")]
    tables = cross_fitted(train, features, o, problem)
    events += [("cross_fit", kind) for kind in tables]
    middles = prep.medians(train, numeric) if len(numeric) > 1 else None
    found: list[dict] = []
    merged: dict[tuple, dict] = {}
    labels: dict[str, DataFrame] = {}
    for kind, table in tables.items():
        scored = durable(train.join(table.select(o.key, "residual"), o.key).where(F.col("residual").isNotNull()))
        patterns_of, labelled = detect(scored, features, numeric, o, middles)
        alike = {}
        if labelled is not None:
            labels[kind] = durable(labelled.where("cluster >= 0").select(o.key, "cluster"))
            for other in list(labels)[:-1]:
                alike |= {mine: (other, theirs) for mine, theirs in cluster.matching(labels[kind], labels[other], o.key)}
        for p in patterns_of:
            slot = (p["pattern_type"], p.get("column_name"), p.get("bin_value"))
            if p["pattern_type"] == "cluster":  # numbers of clusters say nothing across models
                p["slot"] = "{}:{}".format(*alike.get(p["cluster"], (kind, p["cluster"])))
                slot = ("cluster", None, p["slot"])
            merged.setdefault(slot, {**p, "models": []})["models"].append(kind)
        events.append(("detect", f"{kind}: {len(patterns_of)} patterns"))
    for p in merged.values():
        everyone = len(p["models"]) == len(tables)
        p["confidence"] = (1.5 if len(tables) > 1 else 1.0) if everyone else 0.8 if p["models"] == ["linear"] else 1.0
        found.append(p)
    n_train = train.count()
    best = score_patterns(found, n_train, o.top_patterns)
    paired = rules.compiled_patterns(train, best)
    compiled = [r for r, _ in paired]
    source = {r.name: p for r, p in paired}
    events.append(("construct", f"{len(compiled)} rules"))
    spark = df.sparkSession
    scores = None
    for kind, table in tables.items():
        part = fold_metrics(table, problem).withColumn("model", F.lit(kind))
        scores = part if scores is None else scores.unionByName(part)
    if not compiled:
        empty = spark.createDataFrame([], VARIABLE_SCHEMA)
        return Result(tables[o.models[0]], scores, found, [], empty, [], problem, events, tables, o.key)
    checks = causal.check_columns(
        train, o.key, sorted({c for r in compiled for c in r.columns() if c in numeric and len(r.columns()) == 1}), o.target, numeric
    ) if expr.is_numeric(df.schema[o.target]) else {}
    survived = {
        r["name"]: r.asDict()
        for r in bootstrap.survival(bootstrap.replicate_stats(train, o.key, compiled, o.bootstrap_iterations, o.seed), o.mode).collect()
    }
    held = {r["name"]: r["holdout_validated"] for r in bootstrap.holdout_check(holdout, compiled).collect()}
    good = [r for r in compiled if survived[r.name]["status"] == "validated"]
    steps: list[dict] = []
    if good and numeric and problem == "regression":
        steps = selection.forward_selection(train, holdout, numeric, good, o.target, o.ridge_alpha)
    elif good and numeric and problem == "binary":
        filled = prep.medians(train, numeric)
        plain = [df.na.fill({c: v for c, v in filled.items() if v is not None}) for df in (train, holdout)]
        steps = selection.model_selection(*plain, numeric, good, o.target, models.LogisticModel, binary=True)
    gain = {s["name"]: s["improvement_pct"] for s in steps}
    rows = []
    for r in compiled:
        s, p = survived[r.name], source[r.name]
        flags = checks.get(r.columns()[0], {}) if len(r.columns()) == 1 else {}
        failed = [k for k, v in flags.items() if v]
        penalty = causal.PENALTY ** len(failed)
        rows.append(
            (r.name, p["pattern_type"], p.get("column_name"), p.get("bin_value"), s["status"], s["presence_rate"], s["presence_rate"],
             s["presence_rate"] * penalty, penalty, ",".join(failed), s["rejection_reason"], held.get(r.name), p.get("effect_size"),
             p.get("sample_count"), gain.get(r.name), r.to_json())
        )
    variables = spark.createDataFrame(rows, VARIABLE_SCHEMA)
    events.append(("validate", f"{len(good)} of {len(compiled)} rules"))
    return Result(tables[o.models[0]], scores, found, compiled, variables, steps, problem, events, tables, o.key)
