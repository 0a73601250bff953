"""Aggregations, from conditional counts to grouped quantiles and vector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.operators.rules import preferred


def cross_table(frame: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column value, absent cells 0."""
    return frame.groupBy(row).pivot(column, values).count().na.fill(0)


def all_and_any(frame: DataFrame, keys: list[str], condition: Column, every="all_true", some="any_true") -> DataFrame:
    """Whether a condition holds for all and for any row of a group; null does not hold."""
    c = F.coalesce(condition, F.lit(False))
    return frame.groupBy(*keys).agg(F.bool_and(c).alias(every), F.bool_or(c).alias(some))


def gate_over_conditions(grid: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """``gate_pass`` if every required condition passes, with numbers passed and required; absence fails."""
    ok = F.coalesce(passed, F.lit(False))
    return grid.groupBy(*keys).agg(F.bool_and(ok).alias("gate_pass"), F.count_if(ok).alias("n_passed"), F.count(F.lit(1)).alias("n_required"))


def vector_mean(frame: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pos, mean): component means of each group's vectors."""
    long = frame.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_of_means(frame: DataFrame, inner: str, outer: list[str], value: str) -> DataFrame:
    """The mean over inner groups of their means, so that each inner group weighs the same."""
    per = frame.groupBy(*outer, inner).agg(F.avg(value).alias("_m"))
    return per.groupBy(*outer).agg(F.avg("_m").alias("mean_of_means"), F.avg("_m").alias("equal_weight_mean"), F.count(F.lit(1)).alias("n_groups")).drop("equal_weight_mean")


def summary(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, mean, median and upper median (the element after the lower half) of non-null values."""
    some = frame.where(F.col(value).isNotNull())
    ranked = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    upper = F.max(F.when(F.col("_n") == F.floor(F.col("_c") / 2) + 1, F.col(value)))
    return ranked.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), upper.alias("upper_median"))


def grouped_quantiles(frame: DataFrame, keys: list[str], metrics: list[str], fractions: dict[str, float]) -> DataFrame:
    """(keys, metric, n, one column a fraction) over finite values; a metric without any has no row."""
    long = frame.unpivot(keys, metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    columns = [F.percentile("value", F.lit(f)).alias(n) for n, f in fractions.items()]
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), *columns)


def flag_counts(frame: DataFrame, keys: list[str], value: str, flagged: Column) -> DataFrame:
    """n_observed, n_flagged, min, max; all null where nothing was observed."""
    out = frame.groupBy(*keys).agg(F.count(value).alias("_n"), F.count_if(flagged & F.col(value).isNotNull()).alias("_f"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    seen = F.col("_n") > 0
    return out.select(*keys, F.when(seen, F.col("_n")).alias("n_observed"), F.when(seen, F.col("_f")).alias("n_flagged"), "min_value", "max_value")


def members(frame: DataFrame, keys: list[str], member: str, name: str = "members") -> DataFrame:
    """Sorted distinct members of each group, joined by ';'."""
    return frame.select(*keys, member).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(member)), ";").alias(name))


def votes(frame: DataFrame, keys: list[str], voter: str, share: float = 0.5) -> DataFrame:
    """Keys that at least this share of all voters voted for, with n_votes."""
    total = frame.agg(F.count_distinct(voter).alias("_all"))
    counted = frame.groupBy(*keys).agg(F.count_distinct(voter).alias("n_votes"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n_votes") >= F.col("_all") * share).drop("_all")  # one row


def argmax(frame: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row of largest value of each group; ties go to the smaller ``tie``."""
    return preferred(frame, keys, [F.col(value).desc_nulls_last(), F.col(tie)])


def density(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean, standard deviation, mean magnitude, share of non-zero, and five quantiles."""
    v = F.col(value)
    quantiles = [F.percentile(value, F.lit(q)).alias(n) for n, q in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))]
    return frame.groupBy(*keys).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("sd_value"), F.avg(F.abs(v)).alias("mean_abs"), F.avg((v != 0).cast("double")).alias("nonzero_fraction"), *quantiles)


def strided_correlation(frame: DataFrame, order: str, stride: int, x: str, y: str) -> DataFrame:
    """Pearson correlation over every stride-th row."""
    return frame.where(F.pmod(F.col(order), F.lit(stride)) == 0).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def pair_statistics(pairs: DataFrame, value: str) -> DataFrame:
    """median, max, mean and n over pairs."""
    return pairs.agg(F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def partition_by_cause(frame: DataFrame, causes: dict[str, Column]) -> DataFrame:
    """Counts of rows by the exact set of causes that hold ('none' if none)."""
    label = F.concat_ws("+", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in causes.items()])
    return frame.groupBy(F.when(label == "", "none").otherwise(label).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def delta_from_baseline(frame: DataFrame, keys: list[str], is_baseline: Column, value: str) -> DataFrame:
    """``delta``: the value minus its group's baseline value; null for the baseline itself."""
    base = F.max(F.when(is_baseline, F.col(value))).over(Window.partitionBy(*keys))
    return frame.withColumn("delta", F.when(~is_baseline, F.col(value) - base))
