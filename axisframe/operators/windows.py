"""Ranks, percentiles, gaps, islands and other operators along an order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from axisframe.store import tasks


def rank_within(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """class_rank (from 1), class_n and rank_fraction within each class."""
    w = Window.partitionBy(*keys)
    out = frame.withColumn("class_rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("class_n", F.count(F.lit(1)).over(w))
    return out.withColumn("rank_fraction", F.col("class_rank") / F.col("class_n"))


def widest_gap(frame: DataFrame, keys: list[str], score: str, tie: str, first: int = 15) -> DataFrame:
    """Per key: the widest of the first gaps of the descending scores, and the threshold at its middle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    gaps = frame.withColumn("_next", F.lead(score).over(w)).withColumn("_n", F.row_number().over(w)).where(F.col("_next").isNotNull() & (F.col("_n") <= first))
    gap = F.col(score) - F.col("_next")
    best = F.max(F.struct(gap.alias("gap"), (-F.col("_n")).alias("n"), ((F.col(score) + F.col("_next")) / 2).alias("threshold")))
    return gaps.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.gap").alias("gap"), (-F.col("b.n")).cast("long").alias("n_above"), F.col("b.threshold").alias("threshold"))


def percentiles(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Four conventions, as percent of the group: weak (<=), strict (<, of the others), mid-rank, average rank."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    below = F.rank().over(w.orderBy(value)) - 1
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    some = frame.where(F.col(value).isNotNull())
    return some.withColumns(
        {
            "pct_weak": 100.0 * (below + peers) / n,
            "pct_strict": F.when(n > 1, 100.0 * below / (n - 1)),
            "pct_mid": 100.0 * (below + 0.5 * peers) / n,
            "pct_average": 100.0 * (below + (peers + 1) / 2) / n,
        }
    )


def sign_changes(frame: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Positions after which the sign turns (zeros never do), and whether the turn is across a gap in positions."""
    w = Window.partitionBy(*keys).orderBy(position)
    s = F.signum(value)
    out = frame.withColumn("next_position", F.lead(position).over(w)).withColumn("_turn", s * F.lead(s).over(w))
    return out.where("_turn < 0").withColumn("across_gap", F.col("next_position") - F.col(position) > 1).select(*keys, position, "next_position", "across_gap")


def _dealt(frame: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Keys and positions, dealt by keys to so many tasks that a task's share stays the same as tables grow."""
    return frame.select(*keys, position).repartition(tasks(frame), *keys)


def gaps(frame: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Breaks in the numbering: the positions on both sides and how many are missing."""
    w = Window.partitionBy(*keys).orderBy(position)
    out = _dealt(frame, keys, position).distinct().withColumn("after", F.lead(position).over(w))
    return out.where(F.col("after") - F.col(position) > 1).select(*keys, F.col(position).alias("before"), "after", (F.col("after") - F.col(position) - 1).alias("n_missing"))


def islands(frame: DataFrame, keys: list[str], position: str, tolerance: int = 1) -> DataFrame:
    """Runs of positions at most ``tolerance`` apart: lo, hi and n."""
    w = Window.partitionBy(*keys).orderBy(position)
    start = F.when(F.col(position) - F.lag(position).over(w) <= tolerance, 0).otherwise(1)
    marked = _dealt(frame, keys, position).distinct().withColumn("_new", start).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_run")


def coverage(intervals: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Positions under the union of each group's intervals, without laying out the positions."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(high) - F.greatest(F.col(low) - 1, F.coalesce(reach, F.col(low) - 1)))
    return intervals.withColumn("_f", fresh).groupBy(*keys).agg(F.sum("_f").cast("long").alias("n_covered"), F.count(F.lit(1)).alias("n_intervals"))


def lag_one(frame: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Lag-1 autocorrelation of the centred series and the effective number of samples."""
    centred = F.col(value) - F.avg(value).over(Window.partitionBy(*keys))
    out = frame.withColumn("_x", centred).withColumn("_y", F.lag("_x").over(Window.partitionBy(*keys).orderBy(*order)))
    r = F.sum(F.col("_x") * F.col("_y")) / F.nullif(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0))
    per = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r.alias("lag1"))
    bounded = F.greatest(F.lit(0.0), F.col("lag1"))
    return per.withColumn("n_effective", F.col("n") * (1 - bounded) / (1 + bounded))


def adjacent_distances(points: DataFrame, frames: list[str], chain: str, order: str, coordinates: list[str], *, low: float = 2.5, high: float = 4.5) -> DataFrame:
    """(frames, chain, n_pairs, min_distance, max_distance, n_below, n_above): neighbouring points of each chain.

    Neighbours are points whose ``order`` differs by one; a gap in the numbers is no pair. Pairs under ``low`` and over
    ``high`` are counted. A chain without a pair has nulls and zeros.
    """
    w = Window.partitionBy(*frames, chain).orderBy(order)
    step = F.when(F.col(order) - F.lag(order).over(w) == 1, F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in coordinates), F.lit(0.0))))
    d = F.col("_d")
    return points.withColumn("_d", step).groupBy(*frames, chain).agg(F.count(d).alias("n_pairs"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.count_if(d < low).alias("n_below"), F.count_if(d > high).alias("n_above"))


def cumulative_overlap(frame: DataFrame, keys: list[str], order: str, overlap: str) -> DataFrame:
    """``cumulative``: the root of the running sum of squared overlaps."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("cumulative", F.sqrt(F.sum(F.col(overlap) * F.col(overlap)).over(w)))


def first_reaching(frame: DataFrame, keys: list[str], order: str, value: str, levels: list[float]) -> DataFrame:
    """Per key, the first place in the order at which the value reaches each level; null if never."""
    return frame.groupBy(*keys).agg(*[F.min(F.when(F.col(value) >= x, F.col(order))).alias(f"first_{str(x).replace('.', '_')}") for x in levels])


def local_gap(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``local_gap``: the smaller distance to the neighbours' values; ``ratio_to_previous``."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return frame.withColumns({"local_gap": F.least(F.abs(F.col(value) - before), F.abs(after - F.col(value))), "ratio_to_previous": F.col(value) / F.nullif(before, F.lit(0.0))})


def leave_one_out_mean(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``mean_without``: the group's mean without the row; null in a group of one."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    return frame.withColumn("mean_without", F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def circular_shift(frame: DataFrame, keys: list[str], position: str, value: str, member: Column) -> DataFrame:
    """(keys, observed, n_shifts, p_two_sided): each chain's mean inside less that outside, against all its rotations.

    A chain is one array of a task, all of its rotations one correlation with the members; chains spread over tasks.
    Rotations without values on either side have no difference and don't count; a chain without members has no row.
    """
    names = ["observed", "n_shifts", "p_two_sided"]

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        v, inside = pdf["_v"].to_numpy(float), pdf["_m"].to_numpy(bool)
        if not inside.any():
            return pd.DataFrame(columns=[*keys, *names])
        known = ~np.isnan(v)
        v = np.where(known, v, 0.0)
        turned = np.conj(np.fft.rfft(inside.astype(float)))
        sums = np.fft.irfft(np.fft.rfft(v) * turned, len(v))
        counts = np.rint(np.fft.irfft(np.fft.rfft(known.astype(float)) * turned, len(v)))
        rest = known.sum() - counts
        good = (counts > 0) & (rest > 0)
        safe = lambda x: np.where(good, x, 1.0)
        gap = np.where(good, sums / safe(counts) - (v.sum() - sums) / safe(rest), np.nan)
        observed = v[inside].sum() / counts[0] - v[~inside].sum() / rest[0] if good[0] else np.nan
        least = abs(observed) - 1e-9 * max(1.0, np.abs(v).max())
        share = float((np.abs(gap[good]) >= least).mean()) if good[0] else np.nan
        return pd.DataFrame([(*key, observed, len(v), share)], columns=[*keys, *names])

    rows = frame.select(*keys, F.col(position).alias("_p"), F.col(value).cast("double").alias("_v"), F.coalesce(member, F.lit(False)).alias("_m"))
    schema = T.StructType([*[frame.schema[k] for k in keys], *T.StructType.fromDDL("observed double, n_shifts long, p_two_sided double").fields])
    found = rows.groupBy(*keys).applyInPandas(test, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("observed", "p_two_sided")})


def empty_middle(frame: DataFrame, keys: list[str], value: str, state: str, closed="closed", opened="open", low: float = 0.15, high: float = 0.85) -> DataFrame:
    """How many rows lie in the middle band between the largest closed and the smallest open value."""
    ends = frame.groupBy(*keys).agg(F.max(F.when(F.col(state) == closed, F.col(value))).alias("top"), F.min(F.when(F.col(state) == opened, F.col(value))).alias("bottom"))
    a = F.col("top") + low * (F.col("bottom") - F.col("top"))
    b = F.col("top") + high * (F.col("bottom") - F.col("top"))
    return frame.join(ends, keys).groupBy(*keys, "top", "bottom").agg(F.count_if(F.col(value).between(F.least(a, b), F.greatest(a, b))).alias("n_middle"))


def unwrapped(frame: DataFrame, keys: list[str], order: str, value: str, box: float) -> DataFrame:
    """``unwrapped``: the value shifted by whole boxes so that each step is the nearest image of the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    turns = F.coalesce(F.round(step / box), F.lit(0.0))
    running = F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("_turns", turns).withColumn("unwrapped", F.col(value) - running * box).drop("_turns")
