"""Control panels: how far a metric tells two classes of cases apart, and what else it goes with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.operators.statistics import average_ranks, rank_correlation


def separation(frame: DataFrame, keys: list[str], positive: Column, metric: str, rank: str, target: str) -> DataFrame:
    """One row a panel: the classes' ranges, what separates them, and where the target stands.

    (keys, n_positive, n_negative, positive_min, positive_median, positive_max, negative_min, negative_median,
    negative_max, threshold, classes_overlap, n_positive_below, rank1_fraction, rank3_fraction, target_percentile).
    ``threshold`` is halfway between the largest negative and the smallest positive, and null where they overlap or a
    class is empty; ``n_positive_below`` counts positives under the largest negative. Fractions are of the positives
    with a best rank of 1, and of 3 at most; the percentile is of positives at or under the panel's ``target``. Rows
    whose metric or class is null are left out.
    """
    rows = frame.withColumn("_p", positive).where(F.col(metric).isNotNull() & F.col("_p").isNotNull())
    yes, no = F.when(F.col("_p"), F.col(metric)), F.when(~F.col("_p"), F.col(metric))
    aggregates = [F.count(yes).alias("n_positive"), F.count(no).alias("n_negative")]
    for name, column in (("positive", yes), ("negative", no)):
        aggregates += [F.min(column).alias(f"{name}_min"), F.median(column).alias(f"{name}_median"), F.max(column).alias(f"{name}_max")]
    aggregates += [F.avg(F.when(F.col("_p"), (F.col(rank) <= r).cast("double"))).alias(f"rank{r}_fraction") for r in (1, 3)]
    aggregates.append((100 * F.avg(F.when(F.col("_p"), (F.col(metric) <= F.col(target)).cast("double")))).alias("target_percentile"))
    found = rows.groupBy(*keys).agg(*aggregates)
    ends = found.select(*[F.col(k).alias(f"_by_{k}") for k in keys], F.col("negative_max").alias("_worst"))
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    below = rows.join(ends, on).groupBy(*keys).agg(F.count_if(F.col("_p") & (F.col(metric) < F.col("_worst"))).alias("n_positive_below"))
    below = below.select(*[F.col(k).alias(f"_by_{k}") for k in keys], "n_positive_below")
    apart = F.col("negative_max") < F.col("positive_min")
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    joined = found.join(below, on)
    return joined.select(
        *keys, "n_positive", "n_negative", "positive_min", "positive_median", "positive_max", "negative_min", "negative_median", "negative_max",
        F.when(both & apart, (F.col("positive_min") + F.col("negative_max")) / 2).alias("threshold"),
        (both & ~apart).alias("classes_overlap"), F.when(F.col("n_negative") > 0, F.col("n_positive_below")).alias("n_positive_below"),
        "rank1_fraction", "rank3_fraction", "target_percentile",
    )


def confounds(frame: DataFrame, keys: list[str], metric: str, others: list[str]) -> DataFrame:
    """(keys, confound, n, rho): Spearman's correlation of the metric with each other column, over rows that have both.

    Ranks are the mean ones; rho is null where either side has one value alone, or where fewer than two rows are left.
    """
    long = frame.select(*keys, F.col(metric).cast("double").alias("_m"), F.explode(F.map_from_arrays(F.array(*[F.lit(o) for o in others]), F.array(*[F.col(o).cast("double") for o in others]))).alias("confound", "_o"))
    long = long.where("_m is not null and _o is not null")
    groups = [*keys, "confound"]
    ranked = average_ranks(average_ranks(long, groups, "_m", "_rm"), groups, "_o", "_ro")
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), rank_correlation("_rm", "_ro").alias("rho"))
