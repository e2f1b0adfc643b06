"""Latent-variable rules: a finding compiled to one column expression."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import derive, expr
from residua.functions.quantiles import exact_quantiles

INTERVAL = r"^\s*([\[\(])\s*([^,\s]+)\s*,\s*([^,\s]+)\s*([\]\)])\s*$"
EXACT_ABS, EXACT_REL = 1e-9, 1e-5


@dataclass(frozen=True)
class Rule:
    """A named rule; ``kind`` decides how ``params`` become a column.  With ``derived``, an expression tree of
    base columns, the rule reads that expression in place of a table column."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        """Every table column the rule reads."""
        p = self.params
        if self.kind == "cluster":
            return list(p["center"])
        if self.kind == "interaction":
            return [p["feature_a"], p["feature_b"]]
        if self.kind == "variance_regime":
            return [p["feature"]]
        if "derived" in p:
            return derive.columns(p["derived"])
        return [p["column"]] if "column" in p else []

    def binary(self) -> bool:
        return self.kind not in ("cluster", "interaction")

    def column(self) -> Column:
        return compile_rule(self)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "kind": self.kind, "params": self.params}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Rule":
        return Rule(**json.loads(text))


def compile_rule(rule: Rule) -> Column:
    """Score column of a rule; an unknown kind scores 0."""
    p = rule.params
    value = derive.compiled(p["derived"]) if "derived" in p else expr.col(p["column"]) if "column" in p else None
    if rule.kind == "numeric_bin":
        return in_interval(value, p["lower"], p["upper"], p.get("left_closed", False), p.get("right_closed", True))
    if rule.kind == "numeric_exact":
        return close_to(value, p["value"])
    if rule.kind == "categorical":
        return category(value, p["value"], p.get("numeric", False))
    if rule.kind == "cluster":
        return proximity(p["center"])
    if rule.kind == "interaction":
        return bounded_product(p["feature_a"], p["feature_b"], p["min"], p["max"])
    if rule.kind == "variance_regime":
        x = expr.as_double(expr.col(p["feature"]))
        return F.coalesce((x >= F.lit(float(p["threshold"]))).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def in_interval(c: Column, lower: float, upper: float, left_closed: bool, right_closed: bool) -> Column:
    """1.0 inside the interval, else 0.0; null and NaN are outside."""
    x = expr.as_double(c)
    low = x >= F.lit(float(lower)) if left_closed else x > F.lit(float(lower))
    high = x <= F.lit(float(upper)) if right_closed else x < F.lit(float(upper))
    return F.coalesce((low & high).cast("double"), F.lit(0.0))


def close_to(c: Column, value: float) -> Column:
    """1.0 where |x - v| <= 1e-9 + 1e-5 |v|."""
    x = expr.as_double(c)
    tolerance = EXACT_ABS + EXACT_REL * abs(float(value))
    return F.coalesce((F.abs(x - F.lit(float(value))) <= F.lit(tolerance)).cast("double"), F.lit(0.0))


def category(c: Column, value: str, numeric: bool = False) -> Column:
    """String equality; on a numeric column the text is tried as interval, then as number."""
    if numeric:
        interval = parse_interval(value)
        if interval:
            return in_interval(c, *interval)
        number = parse_number(value)
        if number is not None:
            return close_to(c, number)
    return F.coalesce((c.cast("string") == F.lit(value)).cast("double"), F.lit(0.0))


def proximity(center: dict[str, float]) -> Column:
    """1 / (1 + distance to the centre); null, NaN and infinities count as 0."""
    total = F.lit(0.0)
    for c, v in center.items():
        d = F.coalesce(expr.finite(expr.col(c)), F.lit(0.0)) - F.lit(float(v))
        total = total + d * d
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(total))


def bounded_product(a: str, b: str, lo: float, hi: float) -> Column:
    """a*b scaled by the stored bounds and clipped to [0, 1]; 0 when the bounds coincide."""
    if hi <= lo:
        return F.lit(0.0)
    x = expr.col(a).cast("double") * expr.col(b).cast("double")
    return expr.clip((x - F.lit(float(lo))) / F.lit(float(hi - lo)), 0.0, 1.0)


def parse_bound(text: str, default: float) -> float | None:
    t = text.lower().strip().replace("−", "-")
    if t == "nan":
        return default
    try:
        return float(t)
    except ValueError:
        return None


def parse_interval(text: str) -> tuple[float, float, bool, bool] | None:
    """(lower, upper, left closed, right closed) of an interval label."""
    m = re.match(INTERVAL, text)
    if not m:
        return None
    lo, hi = parse_bound(m[2], float("-inf")), parse_bound(m[3], float("inf"))
    if lo is None or hi is None:
        return None
    return lo, hi, m[1] == "[", m[4] == "]"


def parse_number(text: str) -> float | None:
    try:
        v = float(text)
    except ValueError:
        return None
    return v if abs(v) != float("inf") and v == v else None


def interval_columns(label: Column) -> dict[str, Column]:
    """The same parse as columns: lower, upper, left_closed, right_closed (null if no interval)."""
    is_interval = label.rlike(INTERVAL)

    def bound(group: int, default: float) -> Column:
        raw = F.lower(F.regexp_extract(label, INTERVAL, group))
        infinite = F.regexp_extract(raw, r"^[+-]?inf(inity)?$", 0) != ""
        value = (
            F.when(raw == "nan", F.lit(default))
            .when(infinite & raw.startswith("-"), F.lit(float("-inf")))
            .when(infinite, F.lit(float("inf")))
            .otherwise(raw.try_cast("double"))
        )
        return F.when(is_interval, value)

    return {
        "lower": bound(2, float("-inf")),
        "upper": bound(3, float("inf")),
        "left_closed": F.when(is_interval, F.regexp_extract(label, INTERVAL, 1) == "["),
        "right_closed": F.when(is_interval, F.regexp_extract(label, INTERVAL, 4) == "]"),
    }


def clean_name(c: Column) -> Column:
    """Letters, digits and single underscores; empty text becomes "unknown"."""
    out = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")
    return F.when(out == "", F.lit("unknown")).otherwise(out)


def clean_text(text: str) -> str:
    return "_".join(p for p in re.sub(r"\W", "_", text).split("_") if p) or "unknown"


def rules_from_patterns(df: DataFrame, patterns: list[dict]) -> list[Rule]:
    """One rule per pattern that has one.  Bounds and medians the rules need are fitted on ``df`` together."""
    return [r for r, _ in compiled_patterns(df, patterns)]


def compiled_patterns(df: DataFrame, patterns: list[dict]) -> list[tuple[Rule, dict]]:
    """(rule, its pattern); a cluster whose centre has no column in the table has no rule.  A subgroup pattern
    with ``derived`` gives a rule that computes its column.  Equal names get a number."""
    interactions = [p for p in patterns if p["pattern_type"] == "interaction"]
    regimes = [p for p in patterns if p["pattern_type"] == "variance_regime"]
    bounds = {}
    if interactions:
        aggs = []
        for i, p in enumerate(interactions):
            x = expr.finite(expr.col(p["feature_a"])) * expr.finite(expr.col(p["feature_b"]))
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        bounds = {id(p): (row[f"lo{i}"], row[f"hi{i}"]) for i, p in enumerate(interactions)}
    middles = {}
    if regimes:
        names = sorted({p["column_name"] for p in regimes})
        middles = exact_quantiles(df, {c: expr.col(c) for c in names}, [0.5])
    out: list[tuple[Rule, dict]] = []
    taken: dict[str, int] = {}
    for index, p in enumerate(patterns):
        rule = _rule(df, p, index, bounds, middles)
        if rule is None:
            continue
        taken[rule.name] = taken.get(rule.name, 0) + 1
        if taken[rule.name] > 1:
            rule = Rule(f"{rule.name}_{taken[rule.name]}", rule.kind, rule.params)
        out.append((rule, p))
    return out


def _rule(df: DataFrame, p: dict, index: int, bounds: dict, middles: dict) -> Rule | None:
    kind = p["pattern_type"]
    if kind == "subgroup":
        return _subgroup_rule(df, p)
    if kind == "cluster":
        center = {c: float(v) for c, v in p["cluster_center"].items() if c in df.columns}
        return Rule(f"Latent_Cluster_{p['cluster']}", "cluster", {"center": center}) if center else None
    if kind == "interaction":
        lo, hi = bounds[id(p)]
        a, b = p["feature_a"], p["feature_b"]
        return Rule(f"Latent_Interaction_{clean_text(a)}_x_{clean_text(b)}", "interaction", {"feature_a": a, "feature_b": b, "min": lo, "max": hi})
    if kind == "variance_regime":
        c = p["column_name"]
        return Rule(f"Latent_Variance_{clean_text(c)}_{index}", "variance_regime", {"feature": c, "threshold": middles[c][0]})
    return None


def _subgroup_rule(df: DataFrame, p: dict) -> Rule:
    column, label = p["column_name"], p["bin_value"]
    name = f"Latent_Subgroup_{clean_text(column)}_{clean_text(label)}"
    source = {"column": column, **({"derived": p["derived"]} if p.get("derived") else {})}
    if p.get("derived") or expr.is_numeric(df.schema[column]):
        interval = parse_interval(label)
        if interval:
            lo, hi, left, right = interval
            return Rule(name, "numeric_bin", {**source, "lower": lo, "upper": hi, "left_closed": left, "right_closed": right})
        number = parse_number(label)
        if number is not None:
            return Rule(name, "numeric_exact", {**source, "value": number})
    return Rule(name, "categorical", {**source, "value": label})


def score_columns(rules: list[Rule]) -> list[Column]:
    return [r.column().alias(r.name) for r in rules]


def rule_diagnostics(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Support, range and variance of every rule in one aggregation."""
    cells = []
    for i, r in enumerate(rules):
        s = r.column()
        cells.append(
            F.struct(
                F.lit(r.name).alias("name"),
                F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("support"),
                (F.max(s) - F.min(s)).alias("score_range"),
                F.var_pop(s).alias("variance"),
            ).alias(f"c{i}")
        )
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rules))])).alias("s")).select("s.*")


def apply_rules(df: DataFrame, rules: list[Rule], keep: list[str] | None = None, decimals: int = 6) -> DataFrame:
    """Score a table with rules: one projection, valid for batch tables and streams."""
    missing = sorted({c for r in rules for c in r.columns() if c not in df.columns})
    if missing:
        raise ValueError(f"columns missing from the table: {missing}")
    kept = [expr.col(c) for c in (keep if keep is not None else df.columns)]
    return df.select(*kept, *[F.round(r.column(), decimals).alias(r.name) for r in rules])


def applied_summary(scored: DataFrame, names: list[str]) -> DataFrame:
    """Rows, non-zero scores and mean score of each rule."""
    cells = [
        F.struct(
            F.lit(n).alias("name"), F.count(expr.col(n)).alias("rows"),
            F.count_if(expr.col(n) != 0).alias("non_zero"), F.avg(expr.col(n)).alias("mean_score"),
        ).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    return scored.agg(*cells).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("s")).select("s.*")
