"""Tables and paths in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a table whose rows meet all others, as long as none is too large: 78 tasks.
_SPREAD = 12


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder under the warehouse where the session names none, as in small local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(frame: DataFrame, kind: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = fresh_path(spark, kind)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def tasks(frame: DataFrame, rows: int = 500_000) -> int:
    """How many tasks of about so many rows the frame makes, at least those of a shuffle: a task's share stays the same."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-frame.count() // rows))


def blocks_of(rows: int, least: int, most: int) -> int:
    """Into how many blocks to cut rows that all meet: of ``least`` rows or more while they make few tasks, of ``most`` at most."""
    return max(1, min(-(-rows // least), _SPREAD), -(-rows // most))


def block_pairs(frame: DataFrame, own: str, blocks: int) -> DataFrame:
    """Each row once for each two blocks of which ``own`` is one: appends ``low`` and ``high``."""
    dealt = frame.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.withColumns({"low": F.least(own, "_other"), "high": F.greatest(own, "_other")}).drop("_other")


def dealt_by_pair(frame: DataFrame, blocks: int) -> DataFrame:
    """A partition for each two blocks ``low`` <= ``high``."""
    at = F.col("low") * (2 * blocks - 1 - F.col("low")) / 2 + F.col("high")  # their place among all pairs
    return frame.repartitionById(blocks * (blocks + 1) // 2, at.cast("int"))
