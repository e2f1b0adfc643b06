"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import cv, models
from residua.plans.catalog.registry import ORDER_FRAME, Tables, fold_sql, query
from residua.sources import files, sinks, tables

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _write_dialects(t: Tables) -> str:
    """The orders table as CSV files of two dialects (open orders with semicolons)."""
    root = t.scratch()
    rows = t.orders.select(*ORDER_COLS)
    for name, sep, cond in (("semicolon", ";", F.col("o_orderstatus") == "O"), ("comma", ",", F.col("o_orderstatus") != "O")):
        rows.where(cond).write.option("header", "true").option("sep", sep).csv(f"{root}/{name}")
    return root


@query("csv_scan", "A1 A2 A3 A4 A7", " ".join(ORDER_COLS), f"SELECT {', '.join(ORDER_COLS)} FROM orders")
def csv_scan(t: Tables) -> DataFrame:
    got = tables.read_csv(t.spark, _write_dialects(t))
    return got.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
        "o_orderstatus", "o_totalprice", "o_orderpriority",
    )


@query(
    "csv_probe", "A2 A3", "delimiter encoding n_fields",
    "SELECT DISTINCT CASE WHEN o_orderstatus = 'O' THEN ';' ELSE ',' END AS delimiter, 'UTF-8' AS encoding, 5 AS n_fields FROM orders",
)
def csv_probe(t: Tables) -> DataFrame:
    return files.probe(t.spark, _write_dialects(t)).select(
        "delimiter", "encoding", F.size("header").alias("n_fields")
    ).distinct()


@query(
    "encoding_probe", "A3", "folder encoding",
    "SELECT DISTINCT f AS folder, f AS encoding FROM documents, (VALUES ('UTF-8'), ('ISO-8859-1')) v(f)",
)
def encoding_probe(t: Tables) -> DataFrame:
    root = t.scratch()
    text = t.documents.select("doc_id", F.regexp_replace("text", r"[^\x00-\xff]|[\r\n]", " ").alias("text"))
    for name in ("UTF-8", "ISO-8859-1"):
        text.write.option("header", "true").option("encoding", name).csv(f"{root}/{name}")
    folder = F.element_at(F.split("path", "/"), -2)
    # a part without any non-ASCII character reads as UTF-8 too, so one part decides a folder
    return files.probe(t.spark, root).groupBy(folder.alias("folder")).agg(F.min("encoding").alias("encoding"))


@query(
    "csv_bad_lines", "A1 A4", "bad_lines lines",
    "SELECT count(*) FILTER (o_orderstatus = 'F') AS bad_lines, count(*) AS lines FROM orders",
)
def csv_bad_lines(t: Tables) -> DataFrame:
    root = t.scratch()
    extra = F.when(F.col("o_orderstatus") == "F", F.lit(",surplus")).otherwise(F.lit(""))
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_totalprice").cast("string"), extra)
    t.orders.select(line.alias("value")).write.text(root)
    return tables.bad_line_count(t.spark, root, ",", 2)


@query(
    "parquet_scan", "A5", "l_returnflag l_linestatus n qty:4 revenue:2",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty,
              sum(l_extendedprice * (1 - l_discount)) AS revenue
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def parquet_scan(t: Tables) -> DataFrame:
    df = tables.read_parquet(t.spark, f"{t.folder}/lineitem.parquet")
    return (
        df.where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"), F.sum("l_quantity").alias("qty"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        )
    )


@query(
    "sidecar_metadata", "A6", "dataset target task",
    "SELECT c_name AS dataset, c_mktsegment AS target, CASE WHEN c_acctbal < 0 THEN 'classification' ELSE 'regression' END AS task FROM customer",
)
def sidecar_metadata(t: Tables) -> DataFrame:
    root = t.scratch()
    task = F.when(F.col("c_acctbal") < 0, "classification").otherwise("regression")
    docs = t.customer.select(F.col("c_name").alias("dataset"), F.col("c_mktsegment").alias("target"), task.alias("task"))
    docs.write.option("multiLine", "false").json(root)
    return t.spark.read.json(root)


@query(
    "clean_table", "A7", "c_custkey c_acctbal c_mktsegment",
    "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
def clean_table(t: Tables) -> DataFrame:
    keep = F.col("c_mktsegment") != "BUILDING"
    messy = t.customer.select(
        F.when(keep, F.col("c_custkey")).alias(" c_custkey "),
        F.when(keep, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(keep, F.lit(-1.0)).alias("c_acctbal "),
        F.lit(None).cast("string").alias("empty"),
        F.when(keep, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return tables.clean(messy)


@query("file_dedup", "A8", "new_files known_files", "SELECT count(DISTINCT o_orderstatus) - 1 AS new_files, count(DISTINCT o_orderstatus) FILTER (o_orderstatus = 'P') AS known_files FROM orders")
def file_dedup(t: Tables) -> DataFrame:
    root = t.scratch()
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    for copy in ("first", "second"):
        for status in ("O", "F", "P"):
            rows.where(F.col("o_orderstatus") == status).coalesce(1).write.csv(f"{root}/{copy}/{status}")
    listing = files.list_files(t.spark, root, "*.csv")
    hashed = files.content_hashes(listing)
    registry = hashed.where(F.contains("path", F.lit("/second/P/")))
    fresh = files.new_files(listing, registry)
    return fresh.agg(F.count("*").alias("new_files")).join(
        F.broadcast(registry.agg(F.count("*").alias("known_files")))
    )


def ridge_records(t: Tables) -> DataFrame:
    """Residual records of ridge on the account balance."""
    base = cv.kfold(t.order_frame(), "o_orderkey").withColumn("y", F.col("o_totalprice"))
    return cv.residual_records(models.ridge_oof(base, ["c_acctbal"], "y").table, "o_orderkey", features=["c_acctbal"])


RIDGE_OOF = f"""
  f AS (SELECT *, {fold_sql('o_orderkey')} AS fold, o_totalprice AS y, c_acctbal AS x FROM {ORDER_FRAME}),
  fs AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM f GROUP BY fold),
  ft AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy, sum(sxx) AS sxx FROM fs),
  tr AS (SELECT fs.fold, ft.n - fs.n AS n, ft.sx - fs.sx AS sx, ft.sy - fs.sy AS sy, ft.sxy - fs.sxy AS sxy, ft.sxx - fs.sxx AS sxx FROM fs, ft),
  co AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1.0) AS slope, sx / n AS mx, sy / n AS my FROM tr),
  oof AS (SELECT f.*, slope, my + slope * (x - mx) AS prediction, y - (my + slope * (x - mx)) AS residual FROM f JOIN co USING (fold))
"""


@query(
    "residual_sink", "A9", "fold n abs_sum:2",
    f"WITH {RIDGE_OOF} SELECT fold, count(*) AS n, sum(abs(residual)) AS abs_sum FROM oof GROUP BY fold",
)
def residual_sink(t: Tables) -> DataFrame:
    root = t.scratch()
    sinks.write_residuals(ridge_records(t), root, "r1")
    return sinks.read_results(t.spark, root, "residuals", "r1").groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("abs_residual").alias("abs_sum")
    )


EVENT_PATTERNS = """(SELECT user_id AS run_id, event_type AS pattern_type, 'column_' || event_type AS column_name,
    avg(value) / 50.0 AS effect_size, 1.0 / (1 + sum(value)) AS p_value, least(1.0, 5.0 / (1 + sum(value))) AS adjusted_p_value,
    count(*) AS sample_count, avg(value) - 50.0 AS mean_residual, stddev_pop(value) AS std_residual
  FROM events GROUP BY user_id, event_type)"""


def event_patterns(t: Tables) -> DataFrame:
    """Pattern-like rows derived from events: one per (user, event type)."""
    return t.events.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("pattern_type")).agg(
        F.concat(F.lit("column_"), F.first("event_type")).alias("column_name"),
        (F.avg("value") / 50.0).alias("effect_size"),
        (F.lit(1.0) / (1 + F.sum("value"))).alias("p_value"),
        F.least(F.lit(1.0), F.lit(5.0) / (1 + F.sum("value"))).alias("adjusted_p_value"),
        F.count("*").alias("sample_count"),
        (F.avg("value") - 50.0).alias("mean_residual"),
        F.stddev_pop("value").alias("std_residual"),
    )


PATTERN_COLS = "pattern_type column_name effect_size:9 p_value:9 adjusted_p_value:9 sample_count mean_residual:9 std_residual:6"


@query("pattern_sink", "A10 A14", PATTERN_COLS, f"SELECT * FROM {EVENT_PATTERNS}")
def pattern_sink(t: Tables) -> DataFrame:
    root = t.scratch()
    sinks.write_patterns(event_patterns(t).drop("run_id"), root, "r1")
    return sinks.pattern_export(sinks.read_results(t.spark, root, "patterns", "r1"))


@query("pattern_csv", "A14", PATTERN_COLS, f"SELECT * FROM {EVENT_PATTERNS}")
def pattern_csv(t: Tables) -> DataFrame:
    root = t.scratch()
    nested = event_patterns(t).withColumn("definition", F.struct("column_name")).withColumn("column_name", F.lit(""))
    sinks.write_csv(sinks.pattern_export(nested), root)
    return t.spark.read.option("header", "true").schema(
        "pattern_type string, column_name string, effect_size double, p_value double, adjusted_p_value double, sample_count long, mean_residual double, std_residual double"
    ).csv(root)


CUSTOMER_VARIABLES = """(SELECT c_nationkey AS run_id, c_name AS name, CASE WHEN c_acctbal >= 5000 THEN 'validated' WHEN c_acctbal < 0 THEN 'rejected' ELSE 'candidate' END AS status,
    round((c_acctbal + 1000) / 11000.0, 6) AS stability_score, round((c_acctbal + 1000) / 11000.0, 6) AS presence_rate,
    abs(c_acctbal) / 10000.0 AS importance, c_mktsegment AS column_name, 'segment ' || c_mktsegment AS description
  FROM customer)"""


def customer_variables(t: Tables) -> DataFrame:
    """Variable-like rows derived from customers."""
    rate = F.round((F.col("c_acctbal") + 1000) / 11000.0, 6)
    return t.customer.select(
        F.col("c_nationkey").alias("run_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 5000, "validated").when(F.col("c_acctbal") < 0, "rejected").otherwise("candidate").alias("status"),
        rate.alias("stability_score"), rate.alias("presence_rate"),
        (F.abs("c_acctbal") / 10000.0).alias("importance"), F.col("c_mktsegment").alias("column_name"),
        F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("description"),
    )


@query("variable_sink", "A11", "name status stability_score:6 importance:6", f"SELECT * FROM {CUSTOMER_VARIABLES}")
def variable_sink(t: Tables) -> DataFrame:
    root = t.scratch()
    sinks.write_variables(customer_variables(t).drop("run_id"), root, "r1")
    return sinks.read_results(t.spark, root, "latent_variables", "r1")


@query(
    "variable_csv", "A15", "name status stability_score:6 bootstrap_presence_rate:6 importance_score:6 description",
    f"SELECT *, presence_rate AS bootstrap_presence_rate, importance AS importance_score FROM {CUSTOMER_VARIABLES}",
)
def variable_csv(t: Tables) -> DataFrame:
    root = t.scratch()
    named = customer_variables(t).withColumnRenamed("presence_rate", "bootstrap_presence_rate").withColumnRenamed("importance", "importance_score")
    sinks.write_csv(sinks.variable_export(named), root)
    return t.spark.read.option("header", "true").schema(
        "name string, status string, stability_score double, bootstrap_presence_rate double, importance_score double, description string, explanation_text string"
    ).csv(root)


@query(
    "fold_metric_sink", "A12 E8", "fold n r2:6 rmse:4",
    f"""WITH {RIDGE_OOF} SELECT fold, count(*) AS n, 1 - sum(residual * residual) / (var_pop(y) * count(*)) AS r2,
        sqrt(avg(residual * residual)) AS rmse FROM oof GROUP BY fold""",
)
def fold_metric_sink(t: Tables) -> DataFrame:
    root = t.scratch()
    base = cv.kfold(t.order_frame(), "o_orderkey").withColumn("y", F.col("o_totalprice"))
    sinks.write_fold_metrics(cv.fold_scores(models.ridge_oof(base, ["c_acctbal"], "y").table), root, "r1")
    return sinks.read_results(t.spark, root, "fold_metrics", "r1").withColumn("fold", F.col("fold").cast("int"))


@query(
    "event_log", "A13", "phase kind n amount:2",
    "SELECT 'user_' || user_id AS phase, event_type AS kind, count(*) AS n, sum(value) AS amount FROM events GROUP BY ALL",
)
def event_log(t: Tables) -> DataFrame:
    root = t.scratch()
    rows = t.events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("phase"),
        F.col("event_type").alias("kind"), F.struct("value", "event_id").alias("payload"),
    )
    sinks.write_events(rows, root, "r1")
    return sinks.read_results(t.spark, root, "events", "r1").groupBy("phase", "kind").agg(
        F.count("*").alias("n"), F.sum("payload.value").alias("amount")
    )


@query(
    "full_report", "A16", "n_patterns:int n_variables:int rows strongest:6",
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n_patterns, count(*) AS n_variables, count(*) AS rows,
         (SELECT max(m) FROM (SELECT avg(value) / 50 AS m FROM events GROUP BY user_id, event_type)) AS strongest FROM customer""",
)
def full_report(t: Tables) -> DataFrame:
    patterns, variables = event_patterns(t), customer_variables(t)
    run = t.events.agg(F.min("ts").cast("string").alias("started"), F.count("*").alias("events"))
    dataset = t.customer.agg(F.count("*").alias("rows"))
    summary = event_patterns(t).agg(F.count("*").alias("patterns_found"))
    doc = sinks.full_report(run, dataset, patterns, variables, summary)
    return doc.select(
        F.json_array_length(F.get_json_object("value", "$.patterns")).alias("n_patterns"),
        F.json_array_length(F.get_json_object("value", "$.latent_variables")).alias("n_variables"),
        F.get_json_object("value", "$.dataset.rows").cast("long").alias("rows"),
        F.array_max(F.from_json(F.get_json_object("value", "$.patterns[*].effect_size"), "array<double>")).alias("strongest"),
    )


@query(
    "artifact_roundtrip", "A17", "label n total:4",
    "SELECT label, count(*) AS n, sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE))) AS total FROM embeddings GROUP BY label",
)
def artifact_roundtrip(t: Tables) -> DataFrame:
    root = t.scratch()
    sinks.save_array(t.embeddings, f"{root}/arrays")
    back = t.spark.read.parquet(f"{root}/arrays")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query(
    "delete_run", "A18", "run_id n",
    "SELECT 'keep' AS run_id, count(*) AS n FROM events WHERE event_type <> 'error'",
)
def delete_run(t: Tables) -> DataFrame:
    root = t.scratch()
    rows = t.events.select("event_id", "event_type", "value")
    sinks.write_patterns(rows.where(F.col("event_type") != "error"), root, "keep")
    sinks.write_patterns(rows.where(F.col("event_type") == "error"), root, "gone")
    sinks.delete_run(t.spark, root, "gone")
    return sinks.read_results(t.spark, root, "patterns").groupBy("run_id").agg(F.count("*").alias("n"))


