"""Projection, imputation, scaling, encoding, splits, derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.operators import cv, prep, profile, sparse
from residua.plans.catalog.registry import ORDER_FRAME, Tables, fold_sql, query, uniform_sql


@query("feature_target", "D1", "o_orderkey o_totalprice c_acctbal c_mktsegment", f"SELECT o_orderkey, o_totalprice, c_acctbal, c_mktsegment FROM {ORDER_FRAME}")
def feature_target(t: Tables) -> DataFrame:
    df = t.order_frame().select("c_acctbal", "o_totalprice", "c_mktsegment", "o_orderkey")
    return prep.feature_target(df, "o_totalprice", ["o_orderkey"])


@query("usable_features", "D2", "lang source n_chars", "SELECT lang, source, n_chars FROM documents")
def usable_features(t: Tables) -> DataFrame:
    df = t.documents.withColumn("flat", F.lit(3.0))
    types = profile.column_types(df)
    names = prep.usable_features(df, "target", types)
    flat = prep.zero_variance(df, [c for c in names if expr.is_numeric(df.schema[c])])
    return df.select(*[c for c in names if c not in flat])


HOLEY = """(SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority,
    o_custkey, o_orderstatus FROM orders)"""


def holey(t: Tables) -> DataFrame:
    """Orders with planted nulls in a numeric and a text column."""
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"), "o_custkey", "o_orderstatus",
    )


@query("impute_median", "D4", "o_orderkey price:4", f"SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {HOLEY})) AS price FROM {HOLEY}")
def impute_median(t: Tables) -> DataFrame:
    return prep.impute_median(holey(t), ["price"])


MODE_SQL = f"(SELECT priority FROM {HOLEY} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"


@query("impute_mode", "D5", "o_orderkey priority", f"SELECT o_orderkey, coalesce(priority, {MODE_SQL}) AS priority FROM {HOLEY}")
def impute_mode(t: Tables) -> DataFrame:
    return prep.impute_mode(holey(t), ["priority"])


@query(
    "scaling", "D6", "o_orderkey standard:6 minmax:6 robust:6",
    """SELECT o_orderkey, (o_totalprice - m) / s AS standard, (o_totalprice - lo) / (hi - lo) AS minmax, (o_totalprice - q2) / (q3 - q1) AS robust
       FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.25) AS q1,
         quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)""",
)
def scaling(t: Tables) -> DataFrame:
    c = F.col("o_totalprice")
    fitted = {k: prep.fit_scales(t.orders, {"v": c}, k)["v"] for k in ("standard", "minmax", "robust")}
    return t.orders.select("o_orderkey", *[s.apply(c).alias(k) for k, s in fitted.items()])


@query(
    "one_hot", "D7", "o_orderkey o_orderstatus_O:1 o_orderstatus_P:1",
    "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders",
)
def one_hot(t: Tables) -> DataFrame:
    values = prep.levels(t.orders, ["o_orderstatus"])["o_orderstatus"]
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in prep.one_hot("o_orderstatus", values).items()])


@query(
    "preprocessor", "D8", "o_orderkey price:6 o_custkey:6 priority_2:1 o_orderstatus_O:1 o_orderstatus_P:1",
    f"""SELECT o_orderkey, (p - mp) / sp AS price, (o_custkey - mc) / sc AS o_custkey, (priority = '2-HIGH')::INT AS priority_2,
          (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P
        FROM (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {HOLEY})) AS p, coalesce(priority, {MODE_SQL}) AS priority FROM {HOLEY}),
          (SELECT avg(coalesce(price, q)) AS mp, stddev_pop(coalesce(price, q)) AS sp, avg(o_custkey) AS mc, stddev_pop(o_custkey) AS sc
           FROM {HOLEY}, (SELECT quantile_cont(price, 0.5) AS q FROM {HOLEY}))""",
)
def preprocessor(t: Tables) -> DataFrame:
    df = holey(t)
    model = prep.Preprocessor().fit(df, ["price", "o_custkey", "priority", "o_orderstatus"])
    out = model.transform(df.withColumnRenamed("o_orderkey", "row_id"), ["row_id"])
    return out.select(
        F.col("row_id").alias("o_orderkey"), "price", "o_custkey", F.col("`priority_2-HIGH`").alias("priority_2"),
        "o_orderstatus_O", "o_orderstatus_P",
    )


@query("inverse_scale", "D9", "o_orderkey price:4", f"SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {HOLEY})) AS price FROM {HOLEY}")
def inverse_scale(t: Tables) -> DataFrame:
    df = holey(t)
    model = prep.Preprocessor("robust").fit(df, ["price"])
    scaled = model.transform(df, ["o_orderkey"])
    return scaled.select("o_orderkey", model.inverse("price", F.col("price")).alias("price"))


WIDE_ROWS = f"(SELECT o_orderkey, o_custkey::VARCHAR AS c, {fold_sql('o_orderkey')} AS fold, o_totalprice::DOUBLE AS y FROM orders)"


@query(
    "wide_ridge", "D7 E10", "o_orderkey fold prediction:0",
    f"""WITH f AS {WIDE_ROWS}, s AS (SELECT k.fold AS k, c, count(*) AS n, sum(y) AS sy FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1, 2),
        z AS (SELECT min(c) AS c0 FROM f),
        b AS (SELECT k, sum(CASE WHEN c = c0 THEN sy ELSE sy / (n + 1) END) / sum(CASE WHEN c = c0 THEN n ELSE n / (n + 1.0) END) AS b FROM s, z GROUP BY k)
        SELECT o_orderkey, fold, b + CASE WHEN f.c = c0 OR n IS NULL THEN 0 ELSE (sy - n * b) / (n + 1) END AS prediction
        FROM f JOIN b ON b.k = fold CROSS JOIN z LEFT JOIN s ON s.k = fold AND s.c = f.c""",
)
def wide_ridge(t: Tables) -> DataFrame:
    """Cross-fitted ridge with a coefficient for every customer."""
    df = cv.kfold(t.orders, "o_orderkey").select("o_orderkey", "fold", F.col("o_custkey").cast("string").alias("customer"), F.col("o_totalprice").cast("double").alias("y"))
    return sparse.sparse_oof(df, [], ["customer"], "y", 5)[0]


@query(
    "numeric_fallback", "D10", "o_orderkey price:4 o_custkey",
    f"SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {HOLEY})) AS price, o_custkey::DOUBLE AS o_custkey FROM {HOLEY}",
)
def numeric_fallback(t: Tables) -> DataFrame:
    return prep.numeric_fallback(holey(t), ["o_orderkey"])


@query("random_holdout", "D11", "o_orderkey is_holdout", f"SELECT o_orderkey, {uniform_sql('o_orderkey', 'holdout42')} < 0.2 AS is_holdout FROM orders")
def random_holdout(t: Tables) -> DataFrame:
    return prep.with_holdout(t.orders, "o_orderkey", 0.2)


@query(
    "temporal_holdout", "D12", "event_id is_holdout",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 >= floor((SELECT count(*) FROM events) * (1 - 0.2)) AS is_holdout FROM events",
)
def temporal_holdout(t: Tables) -> DataFrame:
    return prep.with_temporal_holdout(t.events.select("event_id", "ts"), "ts", "event_id", 0.2)


@query(
    "interaction_features", "D13", "pair n product_sum:2 n_both n_either",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS p, quantile_cont(l_discount, 0.5) AS d FROM lineitem)
       SELECT 'quantity-price' AS pair, count(*) AS n, sum(l_quantity * l_extendedprice) AS product_sum,
         count(*) FILTER (l_quantity > q AND l_extendedprice > p) AS n_both, count(*) FILTER ((l_quantity > q) <> (l_extendedprice > p)) AS n_either FROM lineitem, m
       UNION ALL SELECT 'quantity-discount', count(*), sum(l_quantity * l_discount), count(*) FILTER (l_quantity > q AND l_discount > d),
         count(*) FILTER ((l_quantity > q) <> (l_discount > d)) FROM lineitem, m""",
)
def interaction_features(t: Tables) -> DataFrame:
    pairs = {"quantity-price": ("l_quantity", "l_extendedprice"), "quantity-discount": ("l_quantity", "l_discount")}
    df = prep.add_interactions(t.lineitem, [*pairs.values(), ("l_quantity", "l_returnflag"), ("l_tax", "missing")])
    out = None
    for name, (a, b) in pairs.items():
        product, both, either = prep.interaction_names(a, b)
        part = df.agg(
            F.lit(name).alias("pair"), F.count("*").alias("n"), F.sum(product).alias("product_sum"),
            F.sum(both).alias("n_both"), F.sum(either).alias("n_either"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "top_pairs", "D14", "feature_a feature_b strength:6",
    """SELECT s_a.p_brand AS feature_a, s_a.p_type AS feature_b, s_a.strength FROM (SELECT p_brand, p_type, avg(p_retailprice) / 1000 - 1 AS strength FROM part GROUP BY ALL) s_a
       WHERE abs(strength) > 0 ORDER BY abs(strength) DESC, feature_a, feature_b LIMIT 5""",
)
def top_pairs(t: Tables) -> DataFrame:
    strengths = t.part.groupBy(F.col("p_brand").alias("feature_a"), F.col("p_type").alias("feature_b")).agg(
        (F.avg("p_retailprice") / 1000 - 1).alias("strength")
    )
    return prep.top_pairs(strengths, 5)


@query(
    "winsorize", "D15", "event_id value_winsorized:4",
    "SELECT event_id, least(greatest(value, lo), hi) AS value_winsorized FROM events, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)",
)
def winsorize(t: Tables) -> DataFrame:
    return prep.winsorize(t.events, "value")


@query(
    "minmax_scores", "D16", "event_id score:6",
    "SELECT event_id, (value - lo) / (hi - lo) AS score FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)",
)
def minmax_scores(t: Tables) -> DataFrame:
    return prep.minmax_scores(t.events, "value", "score")


@query(
    "json_features", "D17", "p_partkey json",
    """SELECT p_partkey, '{"p_size":' || p_size::DOUBLE::VARCHAR || ',"odd":' || CASE WHEN p_size = 1 THEN 'null' ELSE '2.5' END || '}' AS json FROM part""",
)
def json_features(t: Tables) -> DataFrame:
    odd = F.when(F.col("p_size") == 1, F.lit(float("nan"))).otherwise(F.lit(2.5))
    return t.part.withColumn("odd", odd).select("p_partkey", prep.json_features(["p_size", "odd"]).alias("json"))


@query(
    "flatten_config", "D18", "id geo_nation geo_region account_balance:2",
    """SELECT c_custkey AS id, n_name AS geo_nation, n_regionkey AS geo_region, c_acctbal AS account_balance FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def flatten_config(t: Tables) -> DataFrame:
    nested = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.struct(F.struct(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region")).alias("geo")).alias("place"),
        F.struct(F.col("c_acctbal").alias("balance")).alias("account"),
    )
    flat = prep.flatten_struct(nested)
    return flat.select(
        "id", F.col("`place.geo.nation`").alias("geo_nation"), F.col("`place.geo.region`").alias("geo_region"),
        F.col("`account.balance`").alias("account_balance"),
    )


@query("safe_divide", "D19", "l_key ratio:6", "SELECT md5(l_orderkey::VARCHAR || '-' || l_extendedprice::VARCHAR) AS l_key, CASE WHEN l_tax = 0 THEN -1.0 ELSE l_discount / l_tax END AS ratio FROM lineitem")
def safe_divide(t: Tables) -> DataFrame:
    key = F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_extendedprice").cast("string")).cast("binary"))
    return t.lineitem.select(key.alias("l_key"), expr.safe_divide(F.col("l_discount"), F.col("l_tax"), -1.0).alias("ratio"))
