"""Column lineage and egress policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import lineage, policy
from residua.plans.catalog.registry import Tables, query


def print_sql(c: str) -> str:
    """SQL twin of the additive column fingerprint."""
    words = ", ".join(
        f"coalesce(sum(('0x' || substr(md5({c}::VARCHAR), {16 * i + 1}, 15))::BIGINT)::VARCHAR, '0')" for i in range(2)
    )
    return f"sha256(concat_ws(':', count(*)::VARCHAR, (count(*) - count({c}))::VARCHAR, {words}))"


def snapshot_sql(table: str, columns: dict[str, str]) -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS dtype, {print_sql(c)} AS value_hash, {i} AS position FROM {table}"
        for i, (c, kind) in enumerate(columns.items())
    ) + ")"


BEFORE_COLS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
AFTER = """(SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus AS status, o_totalprice + 1 AS o_totalprice,
   o_orderdate, 1 AS added FROM orders)"""
AFTER_COLS = {
    "o_orderkey": "bigint", "o_custkey": "string", "status": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "added": "int",
}


def changed_orders(t: Tables) -> DataFrame:
    """Orders with a retyped, a renamed, a changed, a dropped and an added column."""
    return t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate", F.lit(1).alias("added"),
    )


@query("column_snapshot", "C1 C2", "column_name dtype value_hash position", f"SELECT * FROM {snapshot_sql('orders', BEFORE_COLS)}")
def column_snapshot(t: Tables) -> DataFrame:
    return lineage.snapshot(t.orders, 1)


def diff(t: Tables) -> DataFrame:
    return lineage.classify(lineage.snapshot(t.orders, 1), lineage.snapshot(changed_orders(t), 2))


DIFF_SQL = f"""(WITH p AS (SELECT * FROM {snapshot_sql('orders', BEFORE_COLS)}), c AS (SELECT * FROM {snapshot_sql(AFTER, AFTER_COLS)}),
  lost AS (SELECT * FROM p WHERE column_name NOT IN (SELECT column_name FROM c)), fresh AS (SELECT * FROM c WHERE column_name NOT IN (SELECT column_name FROM p)),
  ren AS (SELECT l.column_name AS old_name, f.column_name AS new_name FROM lost l JOIN fresh f ON l.dtype = f.dtype AND l.value_hash = f.value_hash)
  SELECT c.column_name, CASE WHEN p.dtype <> c.dtype THEN 'retype' WHEN p.value_hash <> c.value_hash THEN 'value_change' ELSE 'ok' END AS kind,
    NULL AS prior_column_name, CASE WHEN p.dtype <> c.dtype THEN p.dtype || ' -> ' || c.dtype END AS detail FROM p JOIN c ON p.column_name = c.column_name
  UNION ALL SELECT new_name, 'rename_candidate', old_name, NULL FROM ren
  UNION ALL SELECT column_name, 'drop', NULL, NULL FROM lost WHERE column_name NOT IN (SELECT old_name FROM ren)
  UNION ALL SELECT column_name, 'add', NULL, NULL FROM fresh WHERE column_name NOT IN (SELECT new_name FROM ren))"""


@query("lineage_diff", "C3", "column_name kind prior_column_name detail", f"SELECT * FROM {DIFF_SQL}")
def lineage_diff(t: Tables) -> DataFrame:
    return diff(t)


@query(
    "hamming_distance", "C4", "n_name r_name distance",
    """SELECT n_name, r_name, len(list_filter(range(1, 33), lambda i: substr(md5(n_name), i, 1) <> substr(md5(r_name), i, 1))) AS distance
       FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey""",
)
def hamming_distance(t: Tables) -> DataFrame:
    used = t.customer.select("c_nationkey").distinct()
    pairs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(used, F.col("c_nationkey") == F.col("n_nationkey"))
    return pairs.select(
        "n_name", "r_name",
        lineage.hamming(F.md5(F.col("n_name").cast("binary")), F.md5(F.col("r_name").cast("binary"))).cast("long").alias("distance"),
    )


RULES_SQL = """(SELECT o_orderpriority || '/' || o_orderstatus AS name,
   CASE WHEN o_orderpriority = '1-URGENT' THEN ['o_orderkey'] WHEN o_orderpriority = '2-HIGH' THEN ['o_orderkey', 'o_totalprice']
        WHEN o_orderpriority = '3-MEDIUM' THEN ['status', 'o_custkey'] WHEN o_orderpriority = '5-LOW' THEN ['o_orderpriority', 'o_totalprice'] ELSE [] END AS columns
   FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def order_rules(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")

    def names(*cols: str):
        return F.array(*[F.lit(c) for c in cols])

    columns = (
        F.when(p == "1-URGENT", names("o_orderkey")).when(p == "2-HIGH", names("o_orderkey", "o_totalprice"))
        .when(p == "3-MEDIUM", names("status", "o_custkey")).when(p == "5-LOW", names("o_orderpriority", "o_totalprice"))
        .otherwise(F.array().cast("array<string>"))
    )
    return t.orders.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("name"), columns.alias("columns")).distinct()


@query(
    "apply_compatibility", "C5", "name compatibility blocking_kinds",
    f"""WITH r AS (SELECT name, unnest(columns) AS c FROM {RULES_SQL}), k AS (SELECT r.name, coalesce(d.kind, 'drop') AS kind FROM r LEFT JOIN {DIFF_SQL} d ON d.column_name = r.c),
          b AS (SELECT name, max(CASE kind WHEN 'drop' THEN 2 WHEN 'ok' THEN 0 WHEN 'add' THEN 0 ELSE 1 END) AS w,
                string_agg(CASE WHEN kind NOT IN ('ok', 'add') THEN kind END, ',' ORDER BY kind) AS ks FROM k GROUP BY name)
        SELECT a.name, CASE coalesce(w, 0) WHEN 2 THEN 'incompatible' WHEN 1 THEN 'requires_review' ELSE 'ok' END AS compatibility, coalesce(ks, '') AS blocking_kinds
        FROM {RULES_SQL} a LEFT JOIN b ON a.name = b.name""",
)
def apply_compatibility(t: Tables) -> DataFrame:
    return lineage.apply_compatibility(order_rules(t), diff(t))


EXISTING = """(SELECT c_mktsegment AS dataset, n_name AS column_name, CASE WHEN max(c_acctbal) > 9800 THEN 'public' ELSE 'non_public' END AS sensitivity
   FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000 GROUP BY ALL)"""
EVERY = "(SELECT DISTINCT c_mktsegment AS dataset, n_name AS column_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def sensitivity(t: Tables) -> tuple[DataFrame, DataFrame]:
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("dataset"), F.col("n_name").alias("column_name"), "c_acctbal"
    )
    level = F.when(F.max("c_acctbal") > 9800, "public").otherwise("non_public")
    return named.where(F.col("c_acctbal") > 8000).groupBy("dataset", "column_name").agg(level.alias("sensitivity")), named


@query(
    "sensitivity_seed", "C6", "dataset column_name sensitivity",
    f"""SELECT e.dataset, e.column_name, coalesce(x.sensitivity, 'non_public') AS sensitivity FROM {EVERY} e
        LEFT JOIN {EXISTING} x ON e.dataset = x.dataset AND e.column_name = x.column_name""",
)
def sensitivity_seed(t: Tables) -> DataFrame:
    existing, every = sensitivity(t)
    return policy.seed_sensitivity(existing, every)


@query(
    "sensitivity_update", "C6", "dataset column_name sensitivity",
    f"""SELECT coalesce(x.dataset, s.dataset) AS dataset, coalesce(x.column_name, s.column_name) AS column_name, coalesce(s.sensitivity, x.sensitivity) AS sensitivity
        FROM {EXISTING} x FULL JOIN (SELECT DISTINCT 'AUTOMOBILE' AS dataset, n_name AS column_name, 'public' AS sensitivity
          FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON x.dataset = s.dataset AND x.column_name = s.column_name""",
)
def sensitivity_update(t: Tables) -> DataFrame:
    existing, _ = sensitivity(t)
    changes = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("AUTOMOBILE").alias("dataset"), F.col("n_name").alias("column_name"), F.lit("public").alias("sensitivity")
    ).distinct()
    return policy.set_sensitivity(existing, changes)


PUBLIC_SQL = """(SELECT n_name AS column_name FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name HAVING avg(s_acctbal) > 4500
   UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT r_name FROM region)"""
CUSTOMER_RULES = """(SELECT c_name AS name, [n_name, c_mktsegment, r_name] AS columns, abs(c_acctbal) AS importance, (c_acctbal + 1000) / 11000 AS presence_rate
   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def public_names(t: Tables) -> DataFrame:
    by_nation = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("s_acctbal").alias("b"))
    return by_nation.where(F.col("b") > 4500).select(F.col("n_name").alias("column_name")).union(t.customer.select("c_mktsegment")).union(
        t.region.select("r_name")
    ).distinct()


def customer_rules(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("c_name").alias("name"), F.array("n_name", "c_mktsegment", "r_name").alias("columns"),
        F.abs("c_acctbal").alias("importance"), ((F.col("c_acctbal") + 1000) / 11000).alias("presence_rate"),
    )


EGRESS_SQL = f"""(SELECT name, importance, presence_rate, list_filter(columns, lambda c: NOT list_contains(pub, c)) AS blocked FROM {CUSTOMER_RULES}, (SELECT list(column_name) AS pub FROM {PUBLIC_SQL}))"""


@query(
    "egress_decision", "C7", "name allowed reason blocked_columns",
    f"""SELECT name, len(blocked) = 0 AS allowed, CASE WHEN len(blocked) > 0 THEN 'pii_protection_per_column' END AS reason,
        array_to_string(blocked, ',') AS blocked_columns FROM {EGRESS_SQL}""",
)
def egress_decision(t: Tables) -> DataFrame:
    return policy.egress(customer_rules(t), public_names(t))


@query(
    "public_filter", "C8", "name kept",
    f"""SELECT name, array_to_string(list_sort(list_filter(columns, lambda c: list_contains(pub, c))), ',') AS kept FROM {CUSTOMER_RULES}, (SELECT list(column_name) AS pub FROM {PUBLIC_SQL})""",
)
def public_filter(t: Tables) -> DataFrame:
    # the public names of one dataset: a few dozen
    names = public_names(t).agg(F.collect_set("column_name").alias("public"))
    return customer_rules(t).join(F.broadcast(names)).select(
        "name", F.concat_ws(",", policy.keep_public(F.col("columns"), F.col("public"))).alias("kept")
    )


@query(
    "egress_summary", "C9", "rank:int name effect_size:4 presence_rate:6 n_findings n_blocked",
    f"""SELECT row_number() OVER (ORDER BY importance DESC, name) AS rank, name, importance AS effect_size, presence_rate,
          (SELECT count(*) FROM {EGRESS_SQL} WHERE len(blocked) = 0) AS n_findings, (SELECT count(*) FROM {EGRESS_SQL} WHERE len(blocked) > 0) AS n_blocked
        FROM {EGRESS_SQL} WHERE len(blocked) = 0 QUALIFY row_number() OVER (ORDER BY importance DESC, name) <= 5""",
)
def egress_summary(t: Tables) -> DataFrame:
    return policy.egress_summary(customer_rules(t), public_names(t))
