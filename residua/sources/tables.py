"""Readers: CSV with detection, parquet, sidecar JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import expr
from residua.operators.validate import DatasetError
from residua.sources.files import probe

BAD = "_bad_line"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[expr.col(c) for c in columns]) if columns else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by extension."""
    return read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar JSON (one document per file, possibly over several lines)."""
    return spark.read.option("multiLine", "true").json(path)


def _fields(line: Column, delimiter: str) -> Column:
    """Number of fields in a raw line; delimiters inside quotes do not count."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.size(F.split(bare, re.escape(delimiter)))


def scan_csv(spark: SparkSession, paths: list[str], delimiter: str = ",", encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """CSV files of one dialect, all columns plus the raw text of malformed lines."""
    reader = (
        spark.read.option("header", "true").option("sep", delimiter).option("encoding", encoding)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("enforceSchema", "true")
        .option("ignoreLeadingWhiteSpace", "false").option("quote", '"').option("escape", '"')
    )
    if schema is None:
        names = spark.read.option("header", "true").option("sep", delimiter).option("encoding", encoding).option("inferSchema", "true").csv(paths).schema
        fields = ", ".join(f"{expr.name(f.name)} {f.dataType.simpleString()}" for f in names.fields)
    else:
        fields = schema
    return reader.schema(f"{fields}, {BAD} string").csv(paths)


def drop_bad_lines(df: DataFrame, delimiter: str) -> DataFrame:
    """Skip lines with too many fields; short lines keep their missing fields as null."""
    width = len(df.columns) - 1
    keep = F.col(BAD).isNull() | (_fields(F.col(BAD), delimiter) <= width)
    return df.where(keep).drop(BAD)


def bad_line_count(spark: SparkSession, paths: list[str] | str, delimiter: str, width: int) -> DataFrame:
    """Lines with more than ``width`` fields, and all non-blank lines (headers included)."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.agg(
        F.count_if(_fields(F.col("value"), delimiter) > width).alias("bad_lines"), F.count("*").alias("lines")
    )


def clean(df: DataFrame) -> DataFrame:
    """Trim names, keep the first of equal names, drop empty rows and empty columns."""
    keep: dict[str, str] = {}
    for c in df.columns:
        keep.setdefault(c.strip().lstrip("\ufeff"), c)
    named = df.select(*[expr.col(c).alias(n) for n, c in keep.items()])
    rows = named.na.drop("all")
    seen = rows.agg(*[F.count(expr.col(c)).alias(f"n{i}") for i, c in enumerate(rows.columns)]).first()
    full = [c for i, c in enumerate(rows.columns) if seen[f"n{i}"] > 0]
    if not full:
        raise DatasetError(["file contains no usable data"])
    return rows.select(*[expr.col(c) for c in full])


def read_csv(spark: SparkSession, path: str, pattern: str = "*.csv", schema: str | None = None) -> DataFrame:
    """All CSV files under a path: dialects are detected per file, files of one dialect are
    read together (splittable), and the parts are united by column name."""
    # one row per dialect; the path lists are what the reader needs
    dialects = (
        probe(spark, path, pattern).where(F.col("length") > 0)
        .groupBy("encoding", "delimiter", F.concat_ws("\x1f", "header").alias("h"))
        .agg(F.collect_list("path").alias("paths")).orderBy("delimiter", "h").collect()
    )
    if not dialects:
        raise DatasetError(["file is empty"])
    out = None
    for d in dialects:
        raw = scan_csv(spark, sorted(d["paths"]), d["delimiter"], d["encoding"], schema)
        part = drop_bad_lines(raw, d["delimiter"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return clean(out)
