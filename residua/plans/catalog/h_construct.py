"""Rules, checks, bootstrap, selection, application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.hashing import POISSON1_CDF
from residua.functions.moments import grouped_moments
from residua.operators import audit, bootstrap, causal, cv, prep, rules, scan, selection
from residua.operators.rules import Rule
from residua.plans.catalog.registry import EVENT_FRAME, ORDER_FRAME, Tables, fold_sql, query, uniform_sql

LABELS_SQL = """(SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN '(' || o_custkey || '.5, ' || (o_custkey + 10) || ']' WHEN o_orderstatus = 'O' THEN '[-inf, ' || o_custkey || ')'
   ELSE o_orderpriority END AS label FROM orders)"""


@query(
    "parse_intervals", "H1", "label lower:3 upper:3 left_side right_side unbounded",
    f"""WITH p AS (SELECT label, regexp_extract(label, '^([\\[\\(])([^,]+), ([^,]+)([\\]\\)])$', ['a', 'lo', 'hi', 'b']) AS m FROM {LABELS_SQL})
        SELECT label, CASE WHEN m.lo = '-inf' THEN -1e18 ELSE TRY_CAST(m.lo AS DOUBLE) END AS lower, TRY_CAST(nullif(m.hi, '') AS DOUBLE) AS upper,
          CASE m.a WHEN '[' THEN 'closed' WHEN '(' THEN 'open' ELSE 'none' END AS left_side, CASE m.b WHEN ']' THEN 'closed' WHEN ')' THEN 'open' ELSE 'none' END AS right_side, m.lo = '-inf' AS unbounded FROM p""",
)
def parse_intervals(t: Tables) -> DataFrame:
    key = F.col("o_custkey")
    label = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), key.cast("string"), F.lit(".5, "), (key + 10).cast("string"), F.lit("]")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("[-inf, "), key.cast("string"), F.lit(")")))
        .otherwise(F.col("o_orderpriority"))
    )
    parsed = t.orders.select(label.alias("label")).distinct()
    parsed = parsed.select("label", *[c.alias(n) for n, c in rules.interval_columns(F.col("label")).items()])
    low = F.col("lower")

    def side(c: str):
        return F.when(F.col(c), "closed").when(~F.col(c), "open").otherwise("none")

    return parsed.select(
        "label", F.when(low == F.lit(float("-inf")), F.lit(-1e18)).otherwise(low).alias("lower"), "upper",
        side("left_closed").alias("left_side"), side("right_closed").alias("right_side"),
        F.coalesce(low == F.lit(float("-inf")), F.lit(False)).alias("unbounded"),
    )


RULES = [
    Rule("bin", "numeric_bin", {"column": "l_quantity", "lower": 10.0, "upper": 20.0}),
    Rule("exact", "numeric_exact", {"column": "l_tax", "value": 0.05}),
    Rule("flag", "categorical", {"column": "l_returnflag", "value": "R"}),
    Rule("near", "cluster", {"center": {"l_quantity": 30.0, "l_discount": 0.05}}),
    Rule("product", "interaction", {"feature_a": "l_quantity", "feature_b": "l_discount", "min": 0.0, "max": 4.0}),
    Rule("regime", "variance_regime", {"feature": "l_extendedprice", "threshold": 50_000.0}),
    Rule("unknown", "no_such_kind"),
]
RULE_SQL = {
    "bin": "(l_quantity > 10 AND l_quantity <= 20)::INT::DOUBLE",
    "exact": "(abs(l_tax - 0.05) <= 1e-9 + 1e-5 * 0.05)::INT::DOUBLE",
    "flag": "(l_returnflag = 'R')::INT::DOUBLE",
    "near": "1 / (1 + sqrt(pow(l_quantity - 30, 2) + pow(l_discount - 0.05, 2)))",
    "product": "least(greatest(l_quantity * l_discount / 4.0, 0), 1)",
    "regime": "(l_extendedprice >= 50000)::INT::DOUBLE",
    "unknown": "0.0::DOUBLE",
}


@query(
    "apply_rules", "H2 H3 H4 H5 H6 H7 H8 H28", "l_orderkey l_extendedprice bin:1 exact:1 flag:1 near:6 product:6 regime:1 unknown:1",
    "SELECT l_orderkey, l_extendedprice, " + ", ".join(f"{v} AS {k}" for k, v in RULE_SQL.items()) + " FROM lineitem",
)
def apply_rules(t: Tables) -> DataFrame:
    return rules.apply_rules(t.lineitem, RULES, ["l_orderkey", "l_extendedprice"])


@query(
    "applied_summary", "H28", "name rows non_zero mean_score:5",
    " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS rows, count(*) FILTER (round({v}, 6) <> 0) AS non_zero, avg(round({v}, 6)) AS mean_score FROM lineitem" for k, v in RULE_SQL.items()),
)
def applied_summary(t: Tables) -> DataFrame:
    return rules.applied_summary(apply_rules(t), [r.name for r in RULES])


@query(
    "category_rule_on_numbers", "H4", "p_partkey as_interval:1 as_number:1 as_text:1",
    "SELECT p_partkey, (p_size > 10 AND p_size <= 20)::INT AS as_interval, (p_size = 7)::INT AS as_number, (p_brand = 'Brand#3')::INT AS as_text FROM part",
)
def category_rule_on_numbers(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", rules.category(F.col("p_size"), "(10.0, 20.0]", True).alias("as_interval"),
        rules.category(F.col("p_size"), "7", True).alias("as_number"), rules.category(F.col("p_brand"), "Brand#3").alias("as_text"),
    )


@query(
    "fitted_rules", "H6 H7 H8", "kind rows total:3",
    """SELECT 'interaction' AS kind, count(*) AS rows, sum((l_quantity * l_tax - lo) / (hi - lo)) AS total FROM lineitem, (SELECT min(l_quantity * l_tax) AS lo, max(l_quantity * l_tax) AS hi FROM lineitem)
       UNION ALL SELECT 'variance_regime', count(*), sum((l_extendedprice >= q)::INT) FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.5) AS q FROM lineitem)
       UNION ALL SELECT 'numeric_bin', count(*), sum((l_quantity > 5 AND l_quantity <= 9)::INT) FROM lineitem
       UNION ALL SELECT 'categorical', count(*), sum((l_linestatus = 'O')::INT) FROM lineitem
       UNION ALL SELECT 'cluster', count(*), sum(1 / (1 + abs(l_quantity - 12))) FROM lineitem""",
)
def fitted_rules(t: Tables) -> DataFrame:
    found = [
        {"pattern_type": "interaction", "feature_a": "l_quantity", "feature_b": "l_tax"},
        {"pattern_type": "variance_regime", "column_name": "l_extendedprice"},
        {"pattern_type": "subgroup", "column_name": "l_quantity", "bin_value": "(5.0, 9.0]"},
        {"pattern_type": "subgroup", "column_name": "l_linestatus", "bin_value": "O"},
        {"pattern_type": "cluster", "cluster": 0, "cluster_center": {"l_quantity": 12.0}},
    ]
    compiled = rules.rules_from_patterns(t.lineitem, found)
    out = None
    scored = t.lineitem.select(*[r.column().alias(r.kind) for r in compiled])
    for r in compiled:
        part = scored.agg(F.lit(r.kind).alias("kind"), F.count("*").alias("rows"), F.sum(r.kind).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def _above(column: str) -> str:
    return f"({column} > (SELECT quantile_cont({column}, 0.5) FROM lineitem))"


@query(
    "derived_rules", "H6 H7 H28 D13", "name rows active total:3",
    f"""SELECT 'product' AS name, count(*) AS rows, count(*) FILTER (l_quantity * l_discount > 0.5 AND l_quantity * l_discount <= 1.5) AS active,
         (count(*) FILTER (l_quantity * l_discount > 0.5 AND l_quantity * l_discount <= 1.5))::DOUBLE AS total FROM lineitem
       UNION ALL SELECT 'both', count(*), count(*) FILTER ({_above('l_quantity')} AND {_above('l_extendedprice')}), count(*) FILTER ({_above('l_quantity')} AND {_above('l_extendedprice')}) FROM lineitem
       UNION ALL SELECT 'either', count(*), count(*) FILTER ({_above('l_quantity')} <> {_above('l_extendedprice')}), count(*) FILTER ({_above('l_quantity')} <> {_above('l_extendedprice')}) FROM lineitem""",
)
def derived_rules(t: Tables) -> DataFrame:
    """Rules on derived columns after a JSON round trip, on a table that has base columns only."""
    from residua.operators import prep

    pairs = [("l_quantity", "l_discount"), ("l_quantity", "l_extendedprice")]
    trees = prep.interaction_trees(pairs, prep.medians(t.lineitem, sorted({c for p in pairs for c in p})))
    product, (_, both, either) = prep.interaction_names(*pairs[0])[0], prep.interaction_names(*pairs[1])
    found = {
        "product": {"pattern_type": "subgroup", "column_name": product, "bin_value": "(0.5, 1.5]", "derived": trees[product]},
        "both": {"pattern_type": "subgroup", "column_name": both, "bin_value": "1", "derived": trees[both]},
        "either": {"pattern_type": "subgroup", "column_name": either, "bin_value": "1", "derived": trees[either]},
    }
    stored = [r.to_json() for r in rules.rules_from_patterns(t.lineitem, list(found.values()))]
    compiled = [rules.Rule.from_json(text) for text in stored]
    scored = rules.apply_rules(t.lineitem, compiled, [])
    cells = [
        F.struct(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.count_if(expr.col(r.name) > 0).alias("active"), F.sum(expr.col(r.name)).alias("total"))
        for n, r in zip(found, compiled, strict=True)
    ]
    return scored.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("s")).select("s.*")


@query(
    "stored_run", "H28 A9 A10 A11 A12 A13", "stored rows",
    f"""WITH o AS (SELECT o_orderkey FROM {ORDER_FRAME} WHERE {uniform_sql('o_orderkey', 'holdout42')} >= 0.2)
        SELECT 'residuals' AS stored, count(*) AS rows FROM o UNION ALL SELECT 'fold_metrics', count(DISTINCT {fold_sql('o_orderkey', 42, 5)}) FROM o
        UNION ALL SELECT 'validated rules that apply', count(*) FROM (SELECT 1 FROM {ORDER_FRAME})""",
)
def stored_run(t: Tables) -> DataFrame:
    """A whole run written to result tables and read back; its stored rules applied to all rows."""
    from residua.config import Options
    from residua.plans.discover import discover
    from residua.sources import sinks

    hidden = (F.col("c_acctbal") > 6000) & (F.col("o_custkey") % 4 == 1)
    frame = t.order_frame().select(
        "o_orderkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), (F.col("o_custkey") % 4).cast("double").alias("quarter"),
        (F.col("o_totalprice") / 1000 + F.when(hidden, 400.0).otherwise(0.0)).alias("price"),
    )
    root = t.scratch()
    discover(frame, Options(target="price", key="o_orderkey", bootstrap_iterations=10, cluster=False)).save(root, "run")
    read = lambda kind: sinks.read_results(t.spark, root, kind, "run")
    stored = [rules.Rule.from_json(r["rule"]) for r in read("latent_variables").where("status = 'validated'").select("rule").orderBy("rule").collect()]  # top patterns of a run
    applied = rules.apply_rules(frame.drop("price"), stored, ["o_orderkey"])
    parts = [
        read("residuals").agg(F.lit("residuals").alias("stored"), F.count(F.lit(1)).alias("rows")),
        read("fold_metrics").agg(F.lit("fold_metrics").alias("stored"), F.count(F.lit(1)).alias("rows")),
        applied.agg(F.lit("validated rules that apply").alias("stored"), F.count(F.lit(1)).alias("rows")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "rule_diagnostics", "H9", "name support:6 score_range:6 variance:6",
    " UNION ALL ".join(f"SELECT '{k}' AS name, avg(({v} > 0)::INT) AS support, max({v}) - min({v}) AS score_range, var_pop({v}) AS variance FROM lineitem" for k, v in RULE_SQL.items()),
)
def rule_diagnostics(t: Tables) -> DataFrame:
    return rules.rule_diagnostics(t.lineitem, RULES)


@query(
    "clean_names", "H10", "page_id name",
    """SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM pages)""",
)
def clean_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", rules.clean_name(F.col("url")).alias("name"))


@query(
    "proxy_columns", "H11", "column_name proxy_of r:6",
    f"""WITH f AS (SELECT o_totalprice AS price, o_totalprice * 0.9 + c_acctbal / 10 AS net, c_acctbal AS bal FROM {ORDER_FRAME}), r AS (SELECT corr(price, net) AS r FROM f)
        SELECT 'price' AS column_name, 'net' AS proxy_of, r FROM r WHERE abs(r) > 0.95 UNION ALL SELECT 'net', 'price', r FROM r WHERE abs(r) > 0.95""",
)
def proxy_columns(t: Tables) -> DataFrame:
    df = t.order_frame().select(
        F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 0.9 + F.col("c_acctbal") / 10).alias("net"), F.col("c_acctbal").alias("bal")
    )
    return causal.proxies(df, ["price", "net", "bal"])


@query(
    "reverse_causality", "H12", "column_name n r:6 partial_r:6 reverse",
    f"""WITH f AS (SELECT o_totalprice AS y, o_totalprice + c_acctbal * 20 AS x, c_acctbal AS z FROM {ORDER_FRAME}), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM f),
          p AS (SELECT n, xy, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS pr FROM c)
        SELECT 'x' AS column_name, n, xy AS r, pr AS partial_r, abs(xy) > 0.95 OR (abs(xy) > 0.8 AND abs(pr) > 0.8) AS reverse FROM p""",
)
def reverse_causality(t: Tables) -> DataFrame:
    df = t.order_frame().select(
        F.col("o_totalprice").alias("y"), (F.col("o_totalprice") + F.col("c_acctbal") * 20).alias("x"), F.col("c_acctbal").alias("z")
    )
    return causal.reverse_causal(df, "x", "y", ["z"])


@query(
    "double_ml", "H13", "column_name theta_raw:6 theta_dml:6 n_used n_controls confounded",
    f"""WITH f AS (SELECT floor({uniform_sql('o_orderkey', 'dml42')} * 2)::INT AS k, c_acctbal / 1000 AS x, c_acctbal / 500 + o_totalprice / 1e6 AS t, c_acctbal / 300 + o_totalprice / 1e6 * 0.1 AS y FROM {ORDER_FRAME}),
          c AS (SELECT 1 - k AS k, avg(x) AS mx, avg(t) AS mt, avg(y) AS my, covar_pop(x, t) * count(*) / (var_pop(x) * count(*) + 1) AS bt, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1) AS bv FROM f GROUP BY k),
          r AS (SELECT t - mt - bt * (x - mx) AS rt, y - my - bv * (x - mx) AS ry FROM f JOIN c ON f.k = c.k),
          a AS (SELECT regr_slope(y, t) AS raw, (SELECT sum(rt * ry) / sum(rt * rt) FROM r) AS dml, count(*) AS n FROM f)
        SELECT 'tr' AS column_name, raw AS theta_raw, dml AS theta_dml, n AS n_used, 1 AS n_controls, abs(raw) >= 0.05 AND abs(dml) / abs(raw) < 0.3 AS confounded FROM a""",
)
def double_ml(t: Tables) -> DataFrame:
    bal, price = F.col("c_acctbal"), F.col("o_totalprice")
    df = t.order_frame().select(
        "o_orderkey", (bal / 1000).alias("x"), (bal / 500 + price / 1e6).alias("tr"), (bal / 300 + price / 1e6 * 0.1).alias("y")
    )
    return causal.orthogonal_effects(df, "o_orderkey", ["tr"], "y", ["x"])


@query(
    "causal_penalty", "H14", "c_custkey penalty:3 penalised_importance:9 causal_warnings",
    """WITH b AS (SELECT c_custkey, abs(c_acctbal) / 10000 AS imp, c_acctbal > 5000 AS p, c_mktsegment = 'BUILDING' AS r, c_nationkey > 20 AS f FROM customer)
       SELECT c_custkey, pow(0.5, p::INT + r::INT + f::INT) AS penalty, imp * pow(0.5, p::INT + r::INT + f::INT) AS penalised_importance,
         concat_ws(',', CASE WHEN p THEN 'proxy_for_feature' END, CASE WHEN r THEN 'possible_reverse_causality' END, CASE WHEN f THEN 'confounded_by_dml' END) AS causal_warnings FROM b""",
)
def causal_penalty(t: Tables) -> DataFrame:
    return causal.penalised(
        t.customer.select(
            "c_custkey", (F.abs("c_acctbal") / 10000).alias("importance"), (F.col("c_acctbal") > 5000).alias("proxy"),
            (F.col("c_mktsegment") == "BUILDING").alias("reverse"), (F.col("c_nationkey") > 20).alias("confounded"),
        )
    )


BOOT_RULES = [
    Rule("urgent", "categorical", {"column": "o_orderpriority", "value": "1-URGENT"}),
    Rule("rare", "numeric_bin", {"column": "o_totalprice", "lower": 0.0, "upper": 1300.0}),
    Rule("broad", "numeric_bin", {"column": "o_totalprice", "lower": 900.0, "upper": 499_000.0}),
]
BOOT_SQL = {
    "urgent": "(o_orderpriority = '1-URGENT')::INT::DOUBLE",
    "rare": "(o_totalprice > 0 AND o_totalprice <= 1300)::INT::DOUBLE",
    "broad": "(o_totalprice > 900 AND o_totalprice <= 499000)::INT::DOUBLE",
}


def weights_sql(source: str, key: str, replicates: int, seed: int = 42) -> str:
    """One row per (row, replicate) with its Poisson(1) weight, zero weights left out."""
    thresholds = " + ".join(f"(u >= {c})::INT" for c in POISSON1_CDF)
    u = f"(('0x' || substr(md5({key} || ':{seed}:' || (r // 4)), 8 * (r % 4) + 1, 8))::BIGINT / 4294967296.0)"
    return f"(SELECT *, {thresholds} AS w FROM (SELECT s.*, r AS replicate, {u} AS u FROM {source} s, (SELECT unnest(range(0, {replicates})) AS r)))"


def boot_stats_sql(replicates: int) -> str:
    w = weights_sql("orders", "o_orderkey", replicates)
    parts = []
    for n, v in BOOT_SQL.items():
        parts.append(
            f"SELECT '{n}' AS name, replicate, sum(w)::DOUBLE AS n, sum(w * {v}) AS s1, sum(w * {v} * {v}) AS s2, max({v}) - min({v}) AS score_range, sum(CASE WHEN {v} > 0 THEN w ELSE 0 END) AS act "
            f"FROM {w} WHERE w > 0 GROUP BY replicate"
        )
    union = " UNION ALL ".join(parts)
    return f"""(SELECT name, replicate, greatest(0, s2 / n - (s1 / n) * (s1 / n)) AS variance, score_range, act / n AS support,
       CASE WHEN s2 / n - (s1 / n) * (s1 / n) > 0 AND score_range > 0 THEN score_range / sqrt((s2 / n - (s1 / n) * (s1 / n)) * n / (n - 1)) END AS effect FROM ({union}))"""


REPLICATES = 50


@query("bootstrap_replicates", "H15", "name replicate:int variance:9 score_range:4 support:9", f"SELECT * FROM {boot_stats_sql(REPLICATES)}")
def bootstrap_replicates(t: Tables) -> DataFrame:
    return bootstrap.replicate_stats(t.orders, "o_orderkey", BOOT_RULES, REPLICATES)


@query(
    "bootstrap_presence", "H16 H17 H18 H19", "name total survived fail_variance fail_range fail_support_low fail_support_high presence_rate:4 status rejection_reason mean_support:6 effect_mean:4 effect_ci_lower:4 effect_ci_upper:4",
    f"""WITH g AS (SELECT *, NOT (variance > 1e-7) AS fv, NOT (score_range > 0.01) AS fr, support < 0.005 AS fl, support > 0.98 AS fh FROM {boot_stats_sql(REPLICATES)}),
          a AS (SELECT name, count(*) AS total, count(*) FILTER (NOT (fv OR fr OR fl OR fh)) AS survived, count(*) FILTER (fv) AS fail_variance, count(*) FILTER (fr) AS fail_range, count(*) FILTER (fl) AS fail_support_low,
            count(*) FILTER (fh) AS fail_support_high, avg(support) AS mean_support, avg(effect) AS effect_mean, quantile_cont(effect, 0.025) AS effect_ci_lower, quantile_cont(effect, 0.975) AS effect_ci_upper FROM g GROUP BY name)
        SELECT *, survived / total AS presence_rate, CASE WHEN survived / total >= 0.5 THEN 'validated' ELSE 'rejected' END AS status,
          CASE WHEN survived / total < 0.5 THEN CASE greatest(fail_variance, fail_range, fail_support_low, fail_support_high) WHEN 0 THEN 'low_presence_rate' WHEN fail_variance THEN 'low_variance' WHEN fail_range THEN 'low_range'
            WHEN fail_support_low THEN 'support_too_sparse' ELSE 'support_too_broad' END END AS rejection_reason FROM a""",
)
def bootstrap_presence(t: Tables) -> DataFrame:
    return bootstrap.survival(bootstrap.replicate_stats(t.orders, "o_orderkey", BOOT_RULES, REPLICATES))


MEANS_SQL = f"(SELECT replicate, sum(w * o_totalprice) / sum(w) AS statistic FROM {weights_sql('orders', 'o_orderkey', REPLICATES)} WHERE w > 0 GROUP BY replicate)"


@query("percentile_interval", "H20 H22", "n_used lower:3 upper:3", f"SELECT count(*) AS n_used, quantile_cont(statistic, 0.025) AS lower, quantile_cont(statistic, 0.975) AS upper FROM {MEANS_SQL}")
def percentile_interval(t: Tables) -> DataFrame:
    return bootstrap.percentile_interval(bootstrap.bootstrap_means(t.orders, "o_orderkey", F.col("o_totalprice"), REPLICATES))


@query("bootstrap_means", "H22", "replicate:int statistic:3", f"SELECT * FROM {MEANS_SQL}")
def bootstrap_means(t: Tables) -> DataFrame:
    return bootstrap.bootstrap_means(t.orders, "o_orderkey", F.col("o_totalprice"), REPLICATES)


@query("bca_interval", "H21", "lower:2 upper:2 method n_used")
def bca_interval(t: Tables) -> DataFrame:
    got = bootstrap.bca_mean(t.events, "event_id", F.col("value"), REPLICATES)
    return t.spark.createDataFrame([got], "lower double, upper double, method string, n_used int")


@query(
    "mean_acceleration", "H21", "n mean:6 acceleration:9",
    "SELECT count(*) AS n, max(m) AS mean, sum(pow(value - m, 3)) / (6 * pow(sum(pow(value - m, 2)), 1.5)) AS acceleration FROM events, (SELECT avg(value) AS m FROM events)",
)
def mean_acceleration(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([bootstrap.mean_acceleration(t.events, F.col("value"))], "n long, mean double, acceleration double")


D_SQL = "CASE WHEN n1 < 2 OR n2 < 2 THEN 0 ELSE (s1 / n1 - s2 / n2) / sqrt(((n1 - 1) * (q1 / n1 - pow(s1 / n1, 2)) + (n2 - 1) * (q2 / n2 - pow(s2 / n2, 2))) / (n1 + n2 - 2)) END"
PERMUTATIONS = 1000


def _groups_sql(source: str, cond: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"(SELECT {by + ',' if by else ''} count(*) FILTER ({cond}) AS n1, count(*) FILTER (NOT ({cond})) AS n2, sum(value) FILTER ({cond}) AS s1, sum(value) FILTER (NOT ({cond})) AS s2, sum(value * value) FILTER ({cond}) AS q1, sum(value * value) FILTER (NOT ({cond})) AS q2 FROM {source} {group})"


@query("group_cohens_d", "G10", "n_in n_out cohens_d:9", f"SELECT n1 AS n_in, n2 AS n_out, {D_SQL} AS cohens_d FROM {_groups_sql('events', 'user_id > 75')}")
def group_cohens_d(t: Tables) -> DataFrame:
    return bootstrap.group_d(t.events, F.col("value"), F.col("user_id") > 75)


@query(
    "permutation_test", "H23", "observed:9 permutations p_value:6",
    f"""WITH o AS (SELECT n1 / (n1 + n2) AS share, {D_SQL} AS d FROM {_groups_sql('events', 'user_id > 75')}),
          r AS (SELECT value, r, ('0x' || substr(md5(event_id || ':perm42:' || (r // 4)), 8 * (r % 4) + 1, 8))::BIGINT / 4294967296.0 < share AS inside FROM events, o, (SELECT unnest(range(0, {PERMUTATIONS})) AS r)),
          p AS (SELECT {D_SQL} AS d FROM {_groups_sql('r', 'inside', 'r')})
        SELECT max(o.d) AS observed, count(*) AS permutations, avg((abs(p.d) >= abs(o.d))::INT) AS p_value FROM p, o""",
)
def permutation_test(t: Tables) -> DataFrame:
    return bootstrap.permutation_test(t.events, "event_id", F.col("value"), F.col("user_id") > 75, PERMUTATIONS)


@query(
    "cramers_v", "H24", "pair n chi2:6 cramers_v:9",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c),
         d AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels GROUP BY ALL), f AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM d)
       SELECT 'status-priority' AS pair, sum(o)::BIGINT AS n, sum(pow(o - e, 2) / e) AS chi2, sqrt(sum(pow(o - e, 2) / e) / (sum(o) * 2)) AS cramers_v FROM e
       UNION ALL SELECT 'quality-toxic', sum(o)::BIGINT, sum(pow(abs(o - e) - 0.5, 2) / e), sqrt(sum(pow(abs(o - e) - 0.5, 2) / e) / sum(o)) FROM f""",
)
def cramers_v(t: Tables) -> DataFrame:
    a = bootstrap.cramers_v(t.orders, "o_orderstatus", "o_orderpriority").withColumn("pair", F.lit("status-priority"))
    b = bootstrap.cramers_v(t.labels, "quality", "toxic").withColumn("pair", F.lit("quality-toxic"))
    return a.unionByName(b)


GRID_SQL = """(SELECT DISTINCT p_size * 20 AS bucket, CASE WHEN p_type = 'SMALL' THEN 'demo' ELSE 'production' END AS mode, 'regression' AS problem, round(0.4 + p_size / 100.0, 4) AS threshold FROM part)"""


@query(
    "presence_threshold", "H25", "name threshold:4",
    f"""WITH r AS (SELECT 'user' || user_id AS name, count(*) AS n_rows, CASE WHEN user_id > 75 THEN 'demo' ELSE 'production' END AS mode, CASE WHEN user_id > 140 THEN 'binary' ELSE 'regression' END AS problem FROM events GROUP BY user_id),
          b AS (SELECT r.*, coalesce((SELECT max(bucket) FROM {GRID_SQL} g WHERE g.bucket <= r.n_rows), (SELECT min(bucket) FROM {GRID_SQL})) AS bucket FROM r)
        SELECT name, coalesce(g.threshold, CASE WHEN b.mode = 'demo' THEN 0.5 ELSE 0.7 END) AS threshold FROM b LEFT JOIN {GRID_SQL} g ON b.bucket = g.bucket AND b.mode = g.mode AND b.problem = g.problem""",
)
def presence_threshold(t: Tables) -> DataFrame:
    table = t.part.select(
        (F.col("p_size") * 20).alias("bucket"), F.when(F.col("p_type") == "SMALL", "demo").otherwise("production").alias("mode"),
        F.lit("regression").alias("problem"), F.round(0.4 + F.col("p_size") / 100.0, 4).alias("threshold"),
    ).distinct()
    runs = t.events.groupBy("user_id").agg(F.count("*").alias("n_rows")).select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), "n_rows",
        F.when(F.col("user_id") > 75, "demo").otherwise("production").alias("mode"),
        F.when(F.col("user_id") > 140, "binary").otherwise("regression").alias("problem"),
    )
    return bootstrap.presence_threshold(table, runs)


@query(
    "holdout_check", "H26", "name n_on n_off variance:9 score_range:3 holdout_validated",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS name, count(*) FILTER ({v} > 0) AS n_on, count(*) FILTER (NOT ({v} > 0)) AS n_off, var_pop({v}) AS variance, max({v}) - min({v}) AS score_range,
            count(*) FILTER ({v} > 0) >= 5 AND count(*) FILTER (NOT ({v} > 0)) >= 5 AND var_pop({v}) > 1e-6 AND max({v}) - min({v}) > 0.01 AS holdout_validated
            FROM orders WHERE {uniform_sql('o_orderkey', 'holdout42')} < 0.2"""
        for n, v in BOOT_SQL.items()
    ),
)
def holdout_check(t: Tables) -> DataFrame:
    held = prep.with_holdout(t.orders, "o_orderkey", 0.2).where("is_holdout")
    return bootstrap.holdout_check(held, BOOT_RULES)


def planted_orders(t: Tables) -> DataFrame:
    """Orders whose target depends on a hidden priority effect."""
    bump = F.when(F.col("o_orderpriority") == "1-URGENT", 300_000.0).otherwise(0.0)
    return t.order_frame().withColumn("y", F.col("o_totalprice") + bump).withColumn("bal", F.col("c_acctbal"))


@query("forward_selection", "H27", "name selection_order baseline:6 augmented:6 improvement_pct:2 combined_pct:2")
def forward_selection(t: Tables) -> DataFrame:
    split = prep.with_holdout(planted_orders(t), "o_orderkey", 0.2)
    steps = selection.forward_selection(split.where(~F.col("is_holdout")), split.where("is_holdout"), ["bal"], BOOT_RULES, "y")
    return selection.selection_table(t.spark, steps)


@query("binary_selection", "H27", "name selection_order better", "SELECT 'urgent' AS name, 1 AS selection_order, true AS better")
def binary_selection(t: Tables) -> DataFrame:
    """The first rule chosen for a 0/1 target, by logistic models and exact AUC: the one that was planted."""
    from residua.operators import models

    df = planted_orders(t).withColumn("late", (F.col("y") > 350_000).cast("int"))
    split = prep.with_holdout(df, "o_orderkey", 0.2)
    named = [Rule("urgent" if i == 0 else f"other{i}", r.kind, r.params) for i, r in enumerate(BOOT_RULES)]
    steps = selection.model_selection(split.where(~F.col("is_holdout")), split.where("is_holdout"), ["bal"], named, "late", models.LogisticModel, binary=True)
    return selection.selection_table(t.spark, steps[:1]).withColumn("better", F.col("augmented") > F.col("baseline"))


@query(
    "single_rule_gain", "H27", "baseline:6 augmented:6",
    f"""WITH f AS (SELECT o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 300000 ELSE 0 END AS y, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS z, c_acctbal AS x, {uniform_sql('o_orderkey', 'holdout42')} < 0.2 AS h FROM {ORDER_FRAME}),
          m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS sxx, var_pop(z) * count(*) AS szz, covar_pop(x, z) * count(*) AS sxz, covar_pop(x, y) * count(*) AS sxy, covar_pop(z, y) * count(*) AS szy FROM f WHERE NOT h),
          c AS (SELECT *, sxy / (sxx + 1) AS b0, (sxy * (szz + 1) - szy * sxz) / ((sxx + 1) * (szz + 1) - sxz * sxz) AS b1, (szy * (sxx + 1) - sxy * sxz) / ((sxx + 1) * (szz + 1) - sxz * sxz) AS b2 FROM m)
        SELECT 1 - sum(pow(y - my - b0 * (x - mx), 2)) / (var_pop(y) * count(*)) AS baseline, 1 - sum(pow(y - my - b1 * (x - mx) - b2 * (z - mz), 2)) / (var_pop(y) * count(*)) AS augmented FROM f, c WHERE h""",
)
def single_rule_gain(t: Tables) -> DataFrame:
    split = prep.with_holdout(planted_orders(t), "o_orderkey", 0.2)
    cols = {"bal": expr.col("bal"), "urgent": BOOT_RULES[0].column(), "y": expr.col("y")}
    fitted = grouped_moments(split.where(~F.col("is_holdout")), cols)[0]
    held = grouped_moments(split.where("is_holdout"), cols)[0]
    row = (selection.holdout_r2(fitted, held, ["bal"], "y", 1.0), selection.holdout_r2(fitted, held, ["bal", "urgent"], "y", 1.0))
    return t.spark.createDataFrame([row], "baseline double, augmented double")


@query("false_positive_audit", "H29", "runs false_positive_runs empirical_fpr:4 status")
def false_positive_audit(t: Tables) -> DataFrame:
    return audit.false_positive_audit(t.event_frame(), "event_id", "residual")


NULL_SPLITS = 120  # 20 replicates of 6 pretend features


@query(
    "null_scan", "H29", "replicate:int feature:int sample_count ks_stat:9",
    f"""WITH s AS (SELECT i, residual AS e, ('0x' || substr(md5(event_id || ':null42:' || (i // 4)), 8 * (i % 4) + 1, 8))::BIGINT / 4294967296.0 < 0.5 AS low FROM {EVENT_FRAME}, (SELECT unnest(range(0, {NULL_SPLITS})) AS i)),
          c AS (SELECT i, e, count(*) FILTER (low) OVER w AS a, count(*) FILTER (NOT low) OVER w AS b, count(*) FILTER (low) OVER (PARTITION BY i) AS na, count(*) FILTER (NOT low) OVER (PARTITION BY i) AS nb FROM s WINDOW w AS (PARTITION BY i ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT i // 6 AS replicate, i % 6 AS feature, max(na) AS sample_count, max(abs(a / na - b / nb)) AS ks_stat FROM c GROUP BY i""",
)
def null_scan(t: Tables) -> DataFrame:
    return audit.null_scan(t.event_frame(), "event_id", "residual")


@query("discovery_votes", "H30", "column_name bin_value votes stable")
def discovery_votes(t: Tables) -> DataFrame:
    folded = cv.kfold(t.event_frame(), "event_id", 5)
    return audit.discovery_votes(folded, [scan.BinSpec("event_type")], "residual", 5)
