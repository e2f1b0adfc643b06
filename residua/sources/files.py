"""File facts gathered by tasks: encodings, delimiters, headers and content hashes.

Listing comes from the ``binaryFile`` source without its content column; tasks then open
byte ranges of the files, so neither a large file nor many files pass through the driver.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 10_240
RANGE_BYTES = 64 * 1024 * 1024
DELIMITERS = [",", ";", "\t", "|"]


def _open(path: str):
    from pyarrow import fs

    uri = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else path
    filesystem, inner = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(inner)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path).select("path", "length")
    )


def sniff_delimiter(text: str) -> str:
    """The candidate that splits the most lines into the same number (> 1) of fields."""
    lines = [line for line in text.splitlines() if line.strip()][:50]
    best, best_score = ",", 0.0
    for d in DELIMITERS:
        counts = [len(row) for row in csv.reader(io.StringIO("\n".join(lines)), delimiter=d)]
        if not counts:
            continue
        common = max(set(counts), key=counts.count)
        share = counts.count(common) / len(counts)
        if common > 1 and share > best_score + 1e-9:
            best, best_score = d, share
    return best


def _complete_utf8(data: bytes, is_start: bool) -> bool:
    """Whether a byte range is valid UTF-8; leading continuation bytes belong to the range
    before."""
    if not is_start:
        skip = 0
        while skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
            skip += 1
        data = data[skip:]
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(data, final=False)
    except UnicodeDecodeError:
        return False
    return True


def utf8_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, is_utf8) over whole files.  Files are validated in byte ranges, so one large
    file is checked by many tasks."""

    def check(batches):
        for pdf in batches:
            flags = []
            for path, start, length in zip(pdf["path"], pdf["start"], pdf["length"]):
                with _open(path) as f:
                    f.seek(int(start))
                    want = min(range_bytes, int(length) - int(start))
                    data = f.read(want + 3)
                    last = int(start) + want >= int(length)
                    if not last:
                        end = want
                        while end < len(data) and data[end] & 0xC0 == 0x80:
                            end += 1
                        data = data[:end]
                    ok = _complete_utf8(data, int(start) == 0)
                    if ok and last:
                        body = data
                        if int(start):
                            while body and body[0] & 0xC0 == 0x80:
                                body = body[1:]
                        try:
                            body.decode("utf-8")
                        except UnicodeDecodeError:
                            ok = False
                    flags.append(ok)
            yield pd.DataFrame({"path": pdf["path"], "ok": flags})

    ranges = files.select(
        "path", "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"),
    ).repartition("path", "start")
    return ranges.mapInPandas(check, "path string, ok boolean").groupBy("path").agg(F.bool_and("ok").alias("is_utf8"))


def file_heads(files: DataFrame) -> DataFrame:
    """(path, has_bom, delimiter, header) from the first bytes of each file."""

    def read(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                with _open(path) as f:
                    raw = f.read(HEAD_BYTES)
                bom = raw.startswith(codecs.BOM_UTF8)
                body = raw[3:] if bom else raw
                try:
                    text = codecs.getincrementaldecoder("utf-8")().decode(body, final=False)
                except UnicodeDecodeError:
                    text = body.decode("latin-1")
                delimiter = sniff_delimiter(text)
                header = next(csv.reader(io.StringIO(text), delimiter=delimiter), [])
                out.append((path, bom, delimiter, header))
            yield pd.DataFrame(out, columns=["path", "has_bom", "delimiter", "header"])

    return files.select("path").mapInPandas(
        read, "path string, has_bom boolean, delimiter string, header array<string>"
    )


def probe(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Per file: length, encoding (first of utf-8, latin-1 that decodes it), BOM, delimiter,
    header."""
    files = list_files(spark, path, pattern)
    return (
        files.join(utf8_files(files), "path").join(file_heads(files), "path")
        .withColumn("encoding", F.when(F.col("is_utf8"), "UTF-8").otherwise("ISO-8859-1"))
        .drop("is_utf8")
    )


def content_hashes(files: DataFrame, chunk: int = 8 * 1024 * 1024) -> DataFrame:
    """(path, length, sha256); each file is streamed through one hash."""

    def run(batches):
        for pdf in batches:
            hashes = []
            for path in pdf["path"]:
                h = hashlib.sha256()
                with _open(path) as f:
                    while block := f.read(chunk):
                        h.update(block)
                hashes.append(h.hexdigest())
            yield pdf.assign(sha256=hashes)

    return files.select("path", "length").mapInPandas(run, "path string, length long, sha256 string")


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content is not in the registry (sha256); copies within the batch keep the
    first path."""
    hashed = content_hashes(files).join(registry.select("sha256"), "sha256", "left_anti")
    return hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.min("length").alias("length"))
