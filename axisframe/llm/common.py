"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Paths of tables that go when their block of ``passing`` ends; the innermost block is last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder under the warehouse is set where the session names none, as in small local runs.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession):
    """Tables that ``written`` makes inside are deleted at the end, but for those that stay."""
    blocks = _PASSING.get()
    mark = _PASSING.set((*blocks, mine := []))
    try:
        yield
    finally:
        _PASSING.reset(mark)
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, kind: str, *, stays: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    In a block of ``passing`` it lasts as long as the block; a table that ``stays`` belongs to the block around that.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, kind)
    blocks = _PASSING.get()[:-1] if stays else _PASSING.get()
    if blocks:
        blocks[-1].append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, *others: DataFrame, stem: str) -> str:
    """A column name that no frame has, so that extra columns may be called anything."""
    taken = {c.lower() for f in (frame, *others) for c in f.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that is a fixed function of the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def ordinals(frame: DataFrame, groups: list[str], key: str, ties: list[Column], rows_per_bucket: int, name: str, total: int | None = None) -> DataFrame:
    """Append ``name``: 0, 1, ... within each group by (key, ties), without sorting a whole group in one task.

    ``key`` is a long column, spread evenly over all longs. Its range is cut into equal buckets, of about
    ``rows_per_bucket`` rows over the whole frame; rows are numbered inside (group, bucket), and the sizes of
    earlier buckets are added. A hot group thus spreads over as many tasks as it has buckets. The group columns
    have no nulls, so the sizes join on the partitioning that the numbering already has.
    """
    total = frame.count() if total is None else total
    bits = max(0, (max(1, total) // rows_per_bucket).bit_length())
    bucket, offset, size = (free_name(frame, stem=s) for s in ("bucket", "offset", "bucket_rows"))
    # the top bits of (key + 2^63): signed order and bucket order agree
    number = F.shiftright(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")
    dealt = frame.withColumn(bucket, number)
    sizes = dealt.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, bucket, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    keys = [*groups, bucket]
    theirs = [free_name(frame, stem=f"offset_key_{i}") for i in range(len(keys))]
    renamed = offsets.select(*[F.col(c).alias(t) for c, t in zip(keys, theirs, strict=True)], offset)
    inside = Window.partitionBy(*keys).orderBy(F.col(key), *ties)
    numbered = dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    on = F.lit(True)
    for c, t in zip(keys, theirs, strict=True):
        on = on & (F.col(c) == F.col(t))
    return numbered.join(renamed, on).withColumn(name, F.col(name) + F.col(offset)).select(*frame.columns, name)
