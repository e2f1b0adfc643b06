"""Session construction and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "residua", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="residua-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as parquet in the checkpoint folder, so later jobs read the same rows and lost
    executors do not force a recomputation of a non-repeatable plan.

    ``checkpoint()`` would keep the size estimate of the plan it cuts; in a loop whose rounds join a table
    with itself, that estimate grows to thousands of digits.  A written table is estimated by its files.
    Row order inside partitions is not kept.  Frames that parquet cannot hold (columns of type void or of
    equal names) are checkpointed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._durable_path = path
    return kept


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` frame that nothing reads any more."""
    path = getattr(df, "_durable_path", None)
    if path is not None:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.  Its cleaner acts when the driver
    happens to collect garbage; a long job on a large table should not wait for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


SPREAD_BYTES = 4 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give a small input enough partitions for work that multiplies rows.  Decided from the
    plan's size estimate: inputs that already have a split per core are left alone, so no
    large table is shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df
