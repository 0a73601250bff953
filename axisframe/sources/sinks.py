"""Sinks: tables with a header over all rows' columns, JSON documents, and results kept under a signature of their inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.operators.gates import require_rows


def write_union_csv(frames: list[DataFrame], path: str) -> None:
    """Tables of unlike columns as one CSV table whose header has every column, in order of first sight.

    No rows at all is an error. Spark's commit leaves either the whole table or none.
    """
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    require_rows(whole).write.option("header", True).csv(path)


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def json_digest(value) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON document as a folder of one text file, whole or not at all."""
    spark.createDataFrame([(canonical_json(value),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str):
    """The document that ``write_json`` left."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def inventory(log: DataFrame, classes: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """The log with each entry's class and score, in order of the key; entries without them keep nulls."""
    return log.join(classes, key, "left").join(scores, key, "left").orderBy(key)


def table_digest(frame: DataFrame) -> str:
    """A hash of a table's columns and rows, in any order and however dealt; a repeated row counts as often as it is there."""
    cells = F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})
    h = F.xxhash64(cells).cast("decimal(20,0)")
    # sums of two hashes, which no order of rows changes
    n, a, b = frame.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64(F.lit(1), cells).cast("decimal(20,0)"))).first()
    return json_digest([frame.dtypes, n, str(a), str(b)])


def kept(spark: SparkSession, folder: str, name: str, inputs: dict[str, DataFrame], config: dict, code: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """(table, "reused" or "built"): a stage's result, taken from an earlier run if nothing that it depends on changed.

    The signature hashes the inputs' rows, the configuration and the code's version, and names the folder of the
    result. A result is reused only if its manifest is there and its rows still have the digest written beside it;
    the manifest comes last, so a run that was stopped leaves nothing that is taken for whole.
    """
    signature = json_digest({"inputs": {k: table_digest(v) for k, v in inputs.items()}, "config": config, "code": code})
    path = f"{folder.rstrip('/')}/{name}-{signature}"
    try:
        manifest = read_json(spark, f"{path}/manifest")
    except Exception as error:
        if getattr(error, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        manifest = None
    if manifest is not None:
        table = spark.read.parquet(f"{path}/rows")
        if manifest["signature"] == signature and table_digest(table) == manifest["digest"]:
            return table, "reused"
    build().write.mode("overwrite").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    spark.createDataFrame([(canonical_json({"signature": signature, "digest": table_digest(table)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return table, "built"


def verify_bundle(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault): entries of a bundle (path, content) that break its manifest (path, bytes, sha256).

    Faults: ``unsafe path``, ``repeated``, ``missing``, ``unexpected``, ``size``, ``hash``. None means a whole bundle.
    """
    have = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))
    counted = have.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("hash").alias("hash"))
    met = counted.withColumn("here", F.lit(True)).join(manifest.select("path", F.col("bytes").alias("due"), F.lower("sha256").alias("due_hash")).withColumn("named", F.lit(True)), "path", "full")
    unsafe = F.col("path").startswith("/") | F.col("path").contains("\\") | F.exists(F.split("path", "/"), lambda x: x.isin("", ".", ".."))
    fault = F.when(unsafe, "unsafe path").when(F.col("n") > 1, "repeated").when(F.col("here").isNull(), "missing").when(F.col("named").isNull(), "unexpected").when(F.col("size") != F.col("due"), "size").when(F.col("hash") != F.col("due_hash"), "hash")
    return met.select("path", fault.alias("fault")).where("fault is not null")
