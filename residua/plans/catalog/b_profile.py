"""Profiling and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.operators import profile, validate
from residua.plans.catalog.registry import Tables, query

ID_RE = "(^|_)(id|index|key|uuid|pk)($|_)"


def facts_sql(table: str, columns: dict[str, str], positions: bool = False) -> str:
    """Column facts of a table in SQL; ``columns`` maps names to storage kinds."""
    words = ", ".join(f"'{w}'" for w in profile.BOOLEAN_WORDS)
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        flag = {"integer": f"{c} IN (0, 1)", "float": f"{c} IN (0, 1)", "string": f"lower(trim({c})) IN ({words})"}.get(kind, "false")
        time = "true" if kind == "time" else f"TRY_CAST({c} AS TIMESTAMP) IS NOT NULL" if kind == "string" else "false"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) AS unique_count, count({c}) AS present, coalesce(bool_and({flag}), false) AS all_boolean, "
            f"coalesce(avg(CASE WHEN {c} IS NOT NULL THEN ({time})::INT END), 0) AS time_share FROM {table}"
        )
    union = " UNION ALL ".join(parts)
    return f"""(SELECT *, round(null_count / row_count * 100, 4) AS null_pct, coalesce(round(unique_count / nullif(present, 0) * 100, 4), 0) AS unique_pct,
      CASE WHEN regexp_matches(column_name, '{ID_RE}', 'i') AND unique_count / nullif(present, 0) * 100 > 90 THEN 'id'
           WHEN kind = 'time' OR time_share >= 0.8 THEN 'datetime'
           WHEN kind = 'boolean' OR (all_boolean AND present > 0) THEN 'boolean'
           WHEN kind IN ('integer', 'float') THEN 'numeric'
           WHEN unique_count < 50 OR coalesce(unique_count / nullif(present, 0) * 100, 0) < 5 THEN 'categorical' ELSE 'text' END AS detected_type
    FROM ({union}))"""


ORDERS_KINDS = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
    "o_orderdate": "time", "o_orderpriority": "string",
}
LABEL_DOCS = "(SELECT l.doc_id, quality, toxic, lang, source, text FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
LABEL_KINDS = {"doc_id": "integer", "quality": "integer", "toxic": "integer", "lang": "string", "source": "string", "text": "string"}
FACT_COLS = "column_name row_count null_count null_pct:4 unique_count unique_pct:4 detected_type"


def label_docs(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "text"), "doc_id")


@query(
    "column_types", "B1", "source_table column_name detected_type",
    f"SELECT 'orders' AS source_table, column_name, detected_type FROM {facts_sql('orders', ORDERS_KINDS)} UNION ALL "
    f"SELECT 'documents', column_name, detected_type FROM {facts_sql(LABEL_DOCS, LABEL_KINDS)}",
)
def column_types(t: Tables) -> DataFrame:
    a = profile.column_facts(t.orders).withColumn("source_table", F.lit("orders"))
    b = profile.column_facts(label_docs(t)).withColumn("source_table", F.lit("documents"))
    return a.unionByName(b)


SPARSE = """(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price,
   CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS urgent_cust, o_orderpriority FROM orders)"""


def sparse_orders(t: Tables) -> DataFrame:
    """Orders with planted nulls."""
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("urgent_cust"), "o_orderpriority",
    )


@query(
    "null_unique_counts", "B2", FACT_COLS,
    f"SELECT * FROM {facts_sql(SPARSE, {'o_orderkey': 'integer', 'price': 'float', 'urgent_cust': 'integer', 'o_orderpriority': 'string'})}",
)
def null_unique_counts(t: Tables) -> DataFrame:
    return profile.column_facts(sparse_orders(t))


@query(
    "sample_values", "B3", "column_name slot:int value",
    """SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY md5(value || ':42'), value) AS slot, value
       FROM (SELECT DISTINCT 'c_name' AS column_name, c_name AS value FROM customer UNION SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer
             UNION SELECT DISTINCT 'c_nationkey', c_nationkey::VARCHAR FROM customer)
       QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY md5(value || ':42'), value) <= 5""",
)
def sample_values(t: Tables) -> DataFrame:
    return profile.sample_values(t.customer, ["c_name", "c_mktsegment", "c_nationkey"])


TARGETS = {
    "quality": ("labels", "integer"), "o_orderstatus": ("orders", "string"), "o_totalprice": ("orders", "float"),
    "l_quantity": ("lineitem", "float"), "l_linenumber": ("lineitem", "integer"), "label": ("embeddings", "integer"),
    "o_custkey": ("orders", "integer"), "l_discount": ("lineitem", "float"),
}


def targets_sql() -> str:
    parts = []
    for c, (table, kind) in TARGETS.items():
        v = f"{c}::DOUBLE" if kind != "string" else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS target, '{kind}' AS kind, count({c}) AS n, count(DISTINCT {c}) AS n_unique, min({v}) AS lo, max({v}) AS hi, "
            f"coalesce(bool_and({v} = floor({v})), false) AS whole FROM {table}"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


def _per_target(t: Tables, fn) -> DataFrame:
    out = None
    for c, (table, _) in TARGETS.items():
        part = fn(profile.target_facts(getattr(t, table), c)).withColumn("target", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "task_detection", "B4", "target n n_unique task",
    f"""SELECT target, n, n_unique, CASE WHEN n_unique <= 20 AND (kind IN ('integer', 'string') OR (kind = 'float' AND whole))
        THEN 'classification' ELSE 'regression' END AS task FROM {targets_sql()}""",
)
def task_detection(t: Tables) -> DataFrame:
    return _per_target(t, profile.detected_task)


@query(
    "problem_type", "B5", "target n_unique problem",
    f"""SELECT target, n_unique, CASE WHEN kind = 'integer' AND n_unique BETWEEN 2 AND 10 AND lo = 0 AND hi = n_unique - 1 AND n / n_unique >= 30
        THEN CASE WHEN n_unique = 2 THEN 'binary' ELSE 'multiclass' END ELSE 'regression' END AS problem FROM {targets_sql()}""",
)
def problem_type(t: Tables) -> DataFrame:
    return _per_target(t, profile.problem_type)


@query(
    "target_suitability", "B6", "target n_unique task",
    f"""SELECT target, n_unique, CASE WHEN kind = 'string' THEN 'classification' WHEN kind = 'float' AND n_unique > 20 THEN 'regression'
        WHEN kind = 'integer' AND n_unique <= 20 THEN 'classification' ELSE 'regression' END AS task FROM {targets_sql()}""",
)
def target_suitability(t: Tables) -> DataFrame:
    return _per_target(t, profile.target_suitability)


@query(
    "ingest_validation", "B7", "row_count errors warnings",
    """SELECT count(*) AS row_count,
         concat_ws('|', CASE WHEN count(*) < 100 THEN 'rows' END, CASE WHEN count(DISTINCT flat) = 1 THEN 'Target column ''flat'' has no variance.' END,
                   'Time column ''no_time'' not found.') AS errors,
         CASE WHEN 100.0 * count(*) FILTER (o_orderkey <> 0) / count(*) > 95 THEN 'Column ''first_only'' is ' || printf('%.1f', round(100.0 * count(*) FILTER (o_orderkey <> 0) / count(*), 4)) || '% null.' END AS warnings
       FROM (SELECT *, 1 AS flat FROM orders)""",
)
def ingest_validation(t: Tables) -> DataFrame:
    df = t.orders.withColumn("flat", F.lit(1)).withColumn("first_only", F.when(F.col("o_orderkey") == 0, 1))
    r = validate.ingest_report(df, "flat", "no_time")
    return r.select("row_count", F.concat_ws("|", "errors").alias("errors"), F.concat_ws("|", "warnings").alias("warnings"))


@query(
    "run_validation", "B8", "row_count duplicate_rows duplicate_pct:1 target_nulls dropped errors",
    """SELECT count(*) AS row_count, count(*) - count(DISTINCT (event_type, user_id, hour, amount)) AS duplicate_rows,
         round((count(*) - count(DISTINCT (event_type, user_id, hour, amount))) / count(*) * 100, 1) AS duplicate_pct,
         count(*) FILTER (amount IS NULL) AS target_nulls, 'one' AS dropped,
         CASE WHEN count(*) FILTER (amount IS NULL) > 0 THEN 'Target column has ' || count(*) FILTER (amount IS NULL) || ' null values.' ELSE '' END AS errors
       FROM (SELECT event_type, user_id, hour(ts) AS hour, CASE WHEN event_type <> 'view' THEN floor(value) END AS amount FROM events)""",
)
def run_validation(t: Tables) -> DataFrame:
    df = t.events.select(
        "event_type", "user_id", F.hour("ts").alias("hour"), F.lit(1).alias("one"),
        F.when(F.col("event_type") != "view", F.floor("value")).alias("amount"),
    )
    r = validate.run_report(df, "amount")
    return r.withColumn("dropped", F.concat_ws("|", "dropped_columns")).withColumn("errors", F.concat_ws("|", "errors"))


def stats_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
            quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75,
            skewness({c}) AS skewness, kurtosis({c}) AS kurtosis,
            (SELECT count(*) FROM {table} z, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {table}) w
              WHERE b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) AS outlier_count,
            count(*) FILTER ({c} = 0) AS zero_count FROM {table}"""
        )
    return " UNION ALL ".join(parts)


STATS_COLS = "column_name count mean:3 std:3 min:3 max:3 q25:3 median:3 q75:3 skewness:3 kurtosis:3 outlier_count zero_count"


@query("numeric_stats", "B9", STATS_COLS, stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + " UNION ALL " + stats_sql("events", ["value"]))
def numeric_stats(t: Tables) -> DataFrame:
    return profile.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 9).unionByName(
        profile.numeric_stats(t.events, ["value"], 9)
    )


@query(
    "top_values", "B10", "column_name rank:int value count pct:4",
    """WITH l AS (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders
                 UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
        c AS (SELECT column_name, value, count(*) AS count FROM l GROUP BY ALL)
       SELECT column_name, value, count, count / sum(count) OVER (PARTITION BY column_name) * 100 AS pct,
              row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
       FROM c QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) <= 10""",
)
def top_values(t: Tables) -> DataFrame:
    return profile.top_values(t.orders, ["o_orderpriority", "o_custkey", "o_orderstatus"])


@query(
    "class_distribution", "B11", "class count",
    "SELECT label::VARCHAR AS class, count(*) AS count FROM embeddings GROUP BY label",
)
def class_distribution(t: Tables) -> DataFrame:
    return profile.class_distribution(t.embeddings, "label")


@query("target_profile", "B11", STATS_COLS, stats_sql("orders", ["o_totalprice"]))
def target_profile(t: Tables) -> DataFrame:
    return profile.numeric_stats(t.orders, ["o_totalprice"], 9)


@query(
    "class_imbalance", "B12", "num_classes minority majority ratio:6 is_imbalanced",
    """SELECT count(*) AS num_classes, min(c) AS minority, max(c) AS majority, min(c) / max(c) AS ratio, min(c) / max(c) < 0.2 AS is_imbalanced
       FROM (SELECT toxic, count(*) AS c FROM labels GROUP BY toxic)""",
)
def class_imbalance(t: Tables) -> DataFrame:
    return profile.class_imbalance(t.labels, "toxic")


@query(
    "target_stats", "B13", "column_name mean:3 std:3 min:3 max:3 median:3",
    "SELECT 'c_acctbal' AS column_name, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, quantile_cont(c_acctbal, 0.5) AS median FROM customer",
)
def target_stats(t: Tables) -> DataFrame:
    return profile.target_stats(t.customer, "c_acctbal", 9)


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM {table}"
        for i, a in enumerate(cols) for b in cols[i + 1 :]
    )


@query("correlation_pairs", "B14", "feature_a feature_b correlation:4", _corr_sql("lineitem", LINE_COLS))
def correlation_pairs(t: Tables) -> DataFrame:
    return profile.correlations(t.lineitem, LINE_COLS, min_abs=0.0, k=None)


@query(
    "correlation_top", "B14", "feature_a feature_b correlation:4 abs_correlation:4",
    """SELECT *, abs(correlation) AS abs_correlation FROM (
         SELECT 'price' AS feature_a, 'taxed' AS feature_b, round(corr(o_totalprice, o_totalprice * 1.2 + o_custkey), 4) AS correlation FROM orders
         UNION ALL SELECT 'price', 'cust', round(corr(o_totalprice, o_custkey), 4) FROM orders
         UNION ALL SELECT 'taxed', 'cust', round(corr(o_totalprice * 1.2 + o_custkey, o_custkey), 4) FROM orders) WHERE abs(correlation) >= 0.3""",
)
def correlation_top(t: Tables) -> DataFrame:
    df = t.orders.select(
        F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 1.2 + F.col("o_custkey")).alias("taxed"),
        F.col("o_custkey").alias("cust"),
    )
    return profile.correlations(df, ["price", "taxed", "cust"])


@query(
    "vif_two", "B15", "feature vif:2 severity",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_extendedprice * l_extendedprice) AS b, sum(l_quantity * l_extendedprice) AS c FROM lineitem),
        v AS (SELECT least(1000, 1 / (1 - c * c / (a * b))) AS vif FROM g)
       SELECT f AS feature, vif, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'medium' ELSE 'low' END AS severity
       FROM v, (VALUES ('l_quantity'), ('l_extendedprice')) t(f)""",
)
def vif_two(t: Tables) -> DataFrame:
    return profile.vif(t.lineitem, ["l_quantity", "l_extendedprice"], min_vif=0.0)


MESSY = """(SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS mostly_null,
   CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN c_nationkey END AS part_null,
   1.0::DOUBLE AS constant, length(c_mktsegment)::DOUBLE AS few, c_acctbal * 2 AS doubled, exp(c_acctbal / 1000.0) AS skewed, c_mktsegment FROM customer)"""
MESSY_KINDS = {
    "c_custkey": "integer", "c_acctbal": "float", "mostly_null": "float", "part_null": "integer", "constant": "float",
    "few": "float", "doubled": "float", "skewed": "float", "c_mktsegment": "string",
}


def messy_customers(t: Tables) -> DataFrame:
    """Customers with planted quality problems."""
    segment = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", "c_acctbal",
        F.when(segment == "BUILDING", F.col("c_acctbal")).alias("mostly_null"),
        F.when(segment.isin("BUILDING", "MACHINERY", "FURNITURE"), F.col("c_nationkey")).alias("part_null"),
        F.lit(1.0).alias("constant"), F.length(segment).cast("double").alias("few"),
        (F.col("c_acctbal") * 2).alias("doubled"), F.exp(F.col("c_acctbal") / 1000.0).alias("skewed"), "c_mktsegment",
    )


def issues(t: Tables) -> DataFrame:
    df = messy_customers(t)
    facts = profile.column_facts(df)
    numeric = expr.numeric_columns(df)
    corr = profile.correlations(df, ["c_acctbal", "doubled", "few", "skewed"])
    return profile.quality_issues(facts, profile.numeric_stats(df, numeric), corr, "c_custkey")


ISSUES_SQL = f"""(WITH f AS (SELECT * FROM {facts_sql(MESSY, MESSY_KINDS)}),
  k AS (SELECT 'c_custkey' AS column_name, skewness(c_custkey) AS s FROM {MESSY} UNION ALL SELECT 'c_acctbal', skewness(c_acctbal) FROM {MESSY}
    UNION ALL SELECT 'mostly_null', skewness(mostly_null) FROM {MESSY} UNION ALL SELECT 'part_null', skewness(part_null) FROM {MESSY}
    UNION ALL SELECT 'few', skewness(few) FROM {MESSY} UNION ALL SELECT 'doubled', skewness(doubled) FROM {MESSY} UNION ALL SELECT 'skewed', skewness(skewed) FROM {MESSY}),
  c AS (SELECT corr(c_acctbal, doubled) AS r FROM {MESSY})
  SELECT 'high' AS severity, 'missing_values' AS category, column_name FROM f WHERE null_pct > 70
  UNION ALL SELECT 'medium', 'missing_values', column_name FROM f WHERE null_pct > 30 AND null_pct <= 70
  UNION ALL SELECT 'high', 'constant_column', column_name FROM f WHERE unique_count <= 1 AND null_pct < 100
  UNION ALL SELECT 'medium', 'constant_column', column_name FROM f WHERE unique_count > 1 AND unique_count < 5 AND detected_type = 'numeric' AND null_pct < 100
  UNION ALL SELECT 'low', 'skewness', column_name FROM k WHERE abs(s) > 2
  UNION ALL SELECT 'medium', 'high_correlation', NULL FROM c WHERE abs(round(r, 4)) >= 0.95)"""


@query("quality_issues", "B16", "severity category column_name", f"SELECT * FROM {ISSUES_SQL}")
def quality_issues(t: Tables) -> DataFrame:
    return issues(t)


@query(
    "quality_score", "B17", "n_issues quality_score:2",
    f"""SELECT count(*) AS n_issues, greatest(0.0, 100.0 - sum(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END)) AS quality_score FROM {ISSUES_SQL}""",
)
def quality_score(t: Tables) -> DataFrame:
    return profile.quality_score(issues(t))


@query(
    "recommendations", "B18", "severity_rank n",
    f"""SELECT CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank, count(*) AS n FROM {ISSUES_SQL} GROUP BY ALL""",
)
def recommendations(t: Tables) -> DataFrame:
    return profile.recommendations(issues(t)).groupBy("severity_rank").agg(F.count("*").alias("n"))


@query("full_profile", "B19", "table_name row_count")
def full_profile(t: Tables) -> DataFrame:
    p = profile.profile(t.order_frame().drop("c_custkey"), "o_totalprice", "o_orderdate")
    out = None
    for name in ("facts", "stats", "top", "samples", "target", "correlations", "vif", "issues", "score", "recommendations"):
        part = getattr(p, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        out = part if out is None else out.unionByName(part)
    return out


