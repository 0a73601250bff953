"""Results that are kept member by member: a later run computes the new and the changed members alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.store import written


def member_hashes(frame: DataFrame, key: str) -> DataFrame:
    """(key, input_hash) of each member's rows, whatever their order and however they are dealt.

    The count, sum and exclusive or of two 64-bit row hashes: parts add up before the shuffle.
    """
    columns = [F.to_json(F.struct(*sorted(frame.columns)))]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("again"), *columns)
    sums = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(20,0)")).alias("s"), F.bit_xor(two).alias("x"))
    return sums.select(key, F.sha2(F.concat_ws("/", "n", "s", "x"), 256).alias("input_hash"))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, empty where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replayed(spark: SparkSession, folder: str, members: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(results of all members, the members computed now): finished members are taken from the folder.

    A member is finished if a row of the manifest has its key, its rows' hash and the ``fingerprint`` (of the code and
    its settings). ``compute`` gets the rows of the others and returns rows that carry the key. Their results are
    written first and the manifest's rows after them, each in one commit: a run that dies leaves nothing that a later
    one takes for finished, and only repeats its members. Members that are gone stay in the folder and out of the
    results. Null keys are one member; a member without results is finished too.
    """
    field = T.StructField(key, members.schema[key].dataType)
    manifest_schema = T.StructType([field, *T.StructType.fromDDL("input_hash string, fingerprint string, run string").fields])
    hashes = written(member_hashes(members, key), "member-hashes")
    same = lambda a, b: a[key].eqNullSafe(b[key])
    manifest = _read(spark, f"{folder}/manifest", manifest_schema).where(F.col("fingerprint") == fingerprint)
    todo = written(hashes.join(manifest, same(hashes, manifest) & (hashes["input_hash"] == manifest["input_hash"]), "left_anti"), "members-to-do")
    out = compute(members.join(todo, same(members, todo), "left_semi"))
    result_schema = T.StructType([*out.schema.fields, T.StructField("run", T.StringType())])
    if not todo.isEmpty():
        run = f"run-{uuid.uuid4().hex}"
        out.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/results")
        todo.select(key, "input_hash", F.lit(fingerprint).alias("fingerprint"), F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/manifest")
    finished = _read(spark, f"{folder}/manifest", manifest_schema).where(F.col("fingerprint") == fingerprint)
    finished = finished.join(hashes, same(finished, hashes) & (finished["input_hash"] == hashes["input_hash"]), "left_semi")
    # two runs at once may have finished a member twice: one of them is taken
    taken = finished.groupBy(key).agg(F.min("run").alias("run"))
    results = _read(spark, f"{folder}/results", result_schema)
    return results.join(taken, same(results, taken) & (results["run"] == taken["run"]), "left_semi").drop("run"), todo.select(key)
