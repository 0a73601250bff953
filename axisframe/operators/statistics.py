"""Null distributions, rank tests, regressions and fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from axisframe.operators.ridge import ridge_fits

#: Radii in a block of places.
_BLOCK_RADII = 1024
#: Rows of a group up to which its rank sums are counted one by one.
_COUNTED = 48


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def cosine_tail(dimension: int, overlap: Column) -> Column:
    """P(|cos| >= overlap) between a fixed and a uniform direction: cos squared is Beta(1/2, (d - 1)/2)."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else 1 - incomplete_beta(0.5, (dimension - 1) / 2, min(1.0, x * x)))

    return tail(overlap)


def cosine_moments(dimension: int) -> tuple[float, float]:
    """Mean and standard deviation of |cos| between random directions."""
    mean = math.exp(math.lgamma(dimension / 2) - math.lgamma((dimension + 1) / 2)) / math.sqrt(math.pi)
    return mean, math.sqrt(1 / dimension - mean**2)


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def draws(spark: SparkSession, n: int, dimension: int, seed: int, parts: int = 8) -> DataFrame:
    """(draw, direction): uniform unit vectors; draw i depends on the seed and i alone, however rows are dealt."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["draw"]:
                v = np.random.default_rng([seed, int(i)]).standard_normal(dimension)
                out.append((v / np.linalg.norm(v)).tolist())
            yield pd.DataFrame({"draw": pdf["draw"], "direction": out})

    return spark.range(0, n, 1, parts).withColumnRenamed("id", "draw").mapInPandas(run, "draw long, direction array<double>")


def null_summary(frame: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """mean, sd (n - 1), quantiles, z, exceedances and add-one p of each key's null draws against what was observed."""
    v = F.col(value)
    per = frame.groupBy(*keys, observed).agg(
        F.count(v).alias("n_draws"), F.avg(v).alias("null_mean"), F.stddev_samp(v).alias("null_sd"), *[F.percentile(v, F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.count_if(v >= F.col(observed)).alias("n_exceed")
    )
    return per.withColumns({"z": (F.col(observed) - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0)), "p_add_one": (F.col("n_exceed") + 1) / (F.col("n_draws") + 1)})


def average_ranks(frame: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The frame with the value's rank in its group from 1, ties sharing their mean; null values have none.

    Counts of equal values are put in order, not rows, so a large group of few values is small.
    """
    tallies = frame.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    below = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tallies.select(*[F.col(k).alias(f"_by_{k}") for k in keys], "_v", (below + (F.col("_k") + 1) / 2).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    return frame.join(ranks, [*on, F.col(value) == F.col("_v")], "left").drop("_v", *[f"_by_{k}" for k in keys])


def rank_correlation(x: str, y: str) -> Column:
    """The aggregate correlation of two rank columns; null where either has one value alone."""
    a, b = F.col(x), F.col(y)
    n = F.count(F.lit(1))
    centred = lambda u, v: F.sum(u * v) - F.sum(u) * F.sum(v) / n
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, centred(a, b) / F.nullif(F.sqrt(centred(a, a) * centred(b, b)), F.lit(0.0)))


def spearman(frame: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho) over rows with both values; a constant side has no rho."""
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rank_correlation("_rx", "_ry").alias("rho"))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t; 0 for a perfect one, null below three pairs."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(r, k, strict=True):
            if x is None or x != x or m < 3:
                out.append(None)
            else:
                out.append(0.0 if abs(x) >= 1 else student_tail(x * math.sqrt((m - 2) / (1 - x * x)), m - 2))
        return pd.Series(out, dtype="float64")

    return tail(rho, n)


def series_correlation(frame: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho, lag_x, lag_y, n_effective, t, p): rank correlation of two series whose values follow their neighbours.

    With lag-1 autocorrelations a and b, n pairs count as n (1 - a b) / (1 + a b); t and its two-sided p are Student's
    at two fewer. Rows without one of the values are left out before neighbours are told; rows of one place in the order
    follow by their values. A constant series, or two
    effective pairs or fewer, have null t and p; a perfect correlation has a null t and p 0.
    """
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rho = spearman(both, keys, "_x", "_y").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "rho")
    means = both.groupBy(*keys).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")).select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_mx", "_my")
    w = Window.partitionBy(*keys).orderBy(*order, "_x", "_y")
    centred = both.join(means, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]).withColumns({"_x": F.col("_x") - F.col("_mx"), "_y": F.col("_y") - F.col("_my")})
    lagged = centred.withColumns({"_bx": F.lag("_x").over(w), "_by": F.lag("_y").over(w)})
    lag = lambda v: F.sum(F.col(f"_{v}") * F.col(f"_b{v}")) / F.nullif(F.sum(F.col(f"_{v}") * F.col(f"_{v}")), F.lit(0.0))
    out = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), lag("x").alias("lag_x"), lag("y").alias("lag_y"))
    out = out.join(rho, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    both_lags = F.col("lag_x") * F.col("lag_y")
    out = out.withColumn("n_effective", F.col("n") * (1 - both_lags) / F.nullif(1 + both_lags, F.lit(0.0)))
    usable = (F.col("n_effective") > 2) & F.col("rho").isNotNull()
    out = out.withColumn("t", F.when(usable & (F.abs("rho") < 1), F.col("rho") * F.sqrt((F.col("n_effective") - 2) / (1 - F.col("rho") * F.col("rho")))))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_tail(a, b) if a == a and a is not None else None for a, b in zip(t, df, strict=True)], dtype="float64")

    p = F.when(usable & (F.abs("rho") >= 1), F.lit(0.0)).when(F.col("t").isNotNull(), tail("t", F.col("n_effective") - 2))
    return out.select(*keys, "n", "rho", "lag_x", "lag_y", "n_effective", "t", p.alias("p"))


def residuals(frame: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """``residual`` of y after the group's least-squares line in x."""
    line = frame.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return frame.join(line, keys).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def _rank_sum_chances(ranks: np.ndarray, ties: np.ndarray, n1: int, seen: int) -> tuple[float, float]:
    """(P(sum >= seen), P(|sum - mean| >= |seen - mean|)) of the rank sum of ``n1`` out of all, to about 1e-12.

    The exact distribution's characteristic function is summed up: with each row taken by chance p = n1 / n, that of
    (sum, number taken) is a product over the ranks, and taking exactly ``n1`` is a Fourier sum over the number. Periods
    are as long as the tails outside them weigh under e^-37; terms are left out where a bound on each is below e^-46.
    """
    n = int(ties.sum())
    step = int(np.gcd.reduce(ranks - ranks[0])) or 1
    places = (ranks - ranks[0]) // step  # sums are n1 * ranks[0] + step * the sum of places
    x = (seen - n1 * int(ranks[0])) // step
    p, top = n1 / n, int(places[-1])
    centre = int(round(float(places @ ties) / n))
    mean = n1 * (float(places @ ties) / n - centre)  # of the sum of places about the centre
    x -= n1 * centre
    # Hoeffding's bound, for draws without return (Serfling) and for the number taken
    reach = math.sqrt(38 * min(n1, n - n1) * (max(n1, n - n1) + 1) / (2 * n)) * top + 2
    size = max(top + 1, 2)
    rounds = max(1, math.ceil(min(2 * reach, min(n1, n - n1) * top) / size)) + 1
    period, counts = rounds * size, min(n + 1, 2 * math.ceil(math.sqrt(19 * n)) + 3)
    # the moduli that bound a term: |sum of e^(i t place)| for all t = 2 pi k / period, a stride of k at a time
    weight, grid = np.zeros(size), np.arange(size)
    weight[places] = ties
    theta = 2 * np.pi * np.arange(counts) / counts
    off = (places - centre).astype(float)
    total, tail, between = 0.0, 0.0, 0.0
    low = math.floor(mean) - period // 2
    # sums in [x, low + period), and those nearer to the mean than x is
    gap = abs(x - mean)
    near = (math.floor(mean - gap + 1e-6) + 1, math.ceil(mean + gap - 1e-6))

    def span(t: np.ndarray, first: int, end: int) -> np.ndarray:
        """The sum of e^(-i t s) over s from first to before end."""
        if first >= end:
            return np.zeros(len(t), complex)
        half = np.where(t == 0, 1.0, np.sin(t / 2))
        return np.where(t == 0, end - first, np.exp(-0.5j * t * (first + end - 1)) * np.sin(t * (end - first) / 2) / half)

    for k1 in range(rounds):
        sums = np.fft.ifft(weight * np.exp(2j * np.pi * grid * k1 / period)) * size
        k = k1 + rounds * np.arange(size)
        k, sums = k[k <= period // 2], sums[k <= period // 2]
        sums = sums * np.exp(-2j * np.pi * (k * centre % period) / period)
        for at in np.flatnonzero(p * (1 - p) * (n - np.abs(sums)) < 46):
            t = 2 * np.pi * int(k[at]) / period
            some = theta[p * (1 - p) * (n - np.real(sums[at] * np.exp(1j * theta))) < 46]
            term = 0j
            for block in range(0, len(some), max(1, (1 << 20) // len(off))):
                th = some[block : block + max(1, (1 << 20) // len(off))]
                turn = 1 - p + p * np.exp(1j * (th[:, None] + t * off[None, :]))
                # powers by logarithms; a factor of zero makes the product zero
                with np.errstate(divide="ignore"):
                    product = np.exp((np.log(np.abs(turn)) * ties).sum(axis=1)) * np.exp(1j * (np.angle(turn) * ties).sum(axis=1))
                term += (product * np.exp(-1j * th * n1)).sum()
            if k[at] == 0:
                total = term.real
            twice = 1.0 if k[at] == 0 or 2 * k[at] == period else 2.0
            tail += twice * (term * span(np.array([t]), x, low + period)[0]).real
            between += twice * (term * span(np.array([t]), *near)[0]).real
    chance = lambda v: min(1.0, max(0.0, float(v) / period / total))
    return (1.0 if x <= low else chance(tail)), 1.0 - chance(between)


def rank_sum(frame: DataFrame, keys: list[str], value: str, in_first: Column) -> DataFrame:
    """(keys, n1, n2, u, p_greater, p_two_sided, floor): the exact Mann-Whitney test, ties sharing ranks.

    The null distribution of a small group is counted by a table over (members taken, doubled rank sum), not by listing
    all splits. Of a larger one, whose table would grow with a power of its size, it is summed up from its characteristic
    function; p is then exact to about 1e-12, not in its leading digits. Ranks come with their counts, not row by row.
    """
    ranked = average_ranks(frame.where(F.col(value).isNotNull()).withColumn("_first", in_first), keys, value, "_rank")
    each = ranked.groupBy(*keys, (F.col("_rank") * 2).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("k"), F.count_if("_first").alias("f"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "k", "f"))).alias("_all"))

    @F.pandas_udf("n1 int, n2 int, u double, p_greater double, p_two_sided double, floor double")
    def test(batch: pd.Series) -> pd.DataFrame:
        out = []
        for rows in batch:
            ranks, ties = [int(x["r"]) for x in rows], [int(x["k"]) for x in rows]
            n1 = sum(int(x["f"]) for x in rows)
            n2 = sum(ties) - n1
            if not n1 or not n2:
                out.append((n1, n2, None, None, None, None))
                continue
            seen = sum(int(x["r"]) * int(x["f"]) for x in rows)
            u = seen / 2 - n1 * (n1 + 1) / 2
            total = math.comb(n1 + n2, n1)
            left, least = n1, 1  # the largest sum takes the highest ranks
            for k in reversed(ties):
                least, left = least * math.comb(k, min(k, left)), left - min(k, left)
            if n1 + n2 > _COUNTED:
                out.append((n1, n2, u, *_rank_sum_chances(np.array(ranks), np.array(ties), n1, seen), least / total))
                continue
            ways: list[dict[int, int]] = [{0: 1}] + [{} for _ in range(n1)]
            for r in (r for r, k in zip(ranks, ties, strict=True) for _ in range(k)):
                for k in range(n1 - 1, -1, -1):
                    for s, c in ways[k].items():
                        ways[k + 1][s + r] = ways[k + 1].get(s + r, 0) + c
            middle = sum(r * k for r, k in zip(ranks, ties, strict=True)) * n1 / (n1 + n2)
            greater = sum(c for s, c in ways[n1].items() if s >= seen) / total
            both = sum(c for s, c in ways[n1].items() if abs(s - middle) >= abs(seen - middle) - 1e-9) / total
            out.append((n1, n2, u, greater, both, least / total))
        return pd.DataFrame(out, columns=["n1", "n2", "u", "p_greater", "p_two_sided", "floor"])

    return lists.withColumn("_t", test("_all")).select(*keys, "_t.*")


def fisher_exact(table: DataFrame, keys: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """(keys, the counts, odds_ratio, p_two_sided): both null where a margin is empty."""

    @F.pandas_udf("double")
    def p(aa: pd.Series, bb: pd.Series, cc: pd.Series, dd: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z in zip(aa, bb, cc, dd, strict=True):
            r, k, n = int(w + x), int(w + y), int(w + x + y + z)
            if not 0 < r < n or not 0 < k < n:
                out.append(None)
                continue
            low, high = max(0, r + k - n), min(r, k)
            logs = [math.lgamma(r + 1) - math.lgamma(i + 1) - math.lgamma(r - i + 1) + math.lgamma(n - r + 1) - math.lgamma(k - i + 1) - math.lgamma(n - r - k + i + 1) for i in range(low, high + 1)]
            top = max(logs)
            chance = np.exp(np.array(logs) - top)
            out.append(float(chance[chance <= chance[int(w) - low] * (1 + 1e-7)].sum() / chance.sum()))
        return pd.Series(out, dtype="float64")

    ratio = F.col(a) * F.col(d) / F.nullif(F.col(b) * F.col(c), F.lit(0))
    return table.select(*keys, a, b, c, d, ratio.cast("double").alias("odds_ratio"), p(a, b, c, d).alias("p_two_sided"))


def matched_controls(frame: DataFrame, id_column: str, label: str, count: str, value: str, *, caliper: float, least: int) -> DataFrame:
    """Each row against rows of its label with its count, or within a caliper where fewer than ``least`` have it.

    (id, tier, n_controls, percentile): the percentile is mid-rank; fewer than ``least`` controls are insufficient.
    """
    me = frame.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(count).alias("n"), F.col(value).alias("v"))
    # controls enter as tallies of equal (label, count, value), and counts meet counts before values do, so that a row's
    # place among its controls comes from running sums and no row meets its controls
    tallies = me.groupBy("label", "n", "v").agg(F.count(F.lit(1)).alias("k"))
    counts = tallies.select("label", "n").distinct()
    reach = counts.join(counts.withColumnRenamed("n", "m"), "label").where(F.abs(F.col("n") - F.col("m")) <= caliper * F.col("n"))
    dealt = reach.join(tallies.withColumnRenamed("n", "m"), ["label", "m"])
    own = F.when(F.col("m") == F.col("n"), F.col("k")).otherwise(0)
    sums = dealt.groupBy("label", "n", "v").agg(F.sum("k").alias("kc"), F.sum(own).alias("ke"))
    every = Window.partitionBy("label", "n")
    before = every.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # a null value is a control that stands above none; nothing stands under a row whose value is null
    below = lambda c: F.when(F.col("v").isNotNull(), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col(c))).over(before), F.lit(0)) + (F.col(c) - 1) / 2).otherwise(0.0)
    stands = sums.select("label", "n", "v", (F.sum("ke").over(every) - 1).alias("ne"), below("ke").alias("ue"), (F.sum("kc").over(every) - 1).alias("nc"), below("kc").alias("uc")).where("ne >= 0")
    named = stands.select(F.col("label").alias("_label"), F.col("n").alias("_n"), F.col("v").alias("_v"), "ne", "ue", "nc", "uc")
    per = me.join(named, (F.col("label") == F.col("_label")) & (F.col("n") == F.col("_n")) & F.col("v").eqNullSafe(F.col("_v")), "left").na.fill(0, ["ne", "ue", "nc", "uc"])
    tier = F.when(F.col("ne") >= least, "exact").when(F.col("nc") >= least, "caliper").otherwise("insufficient")
    return per.withColumn("tier", tier).select(
        "id",
        "tier",
        F.when(F.col("tier") == "exact", F.col("ne")).otherwise(F.col("nc")).cast("long").alias("n_controls"),
        F.when(F.col("tier") == "exact", 100 * F.col("ue") / F.col("ne")).when(F.col("tier") == "caliper", 100 * F.col("uc") / F.col("nc")).alias("percentile"),
    )


def guinier(frame: DataFrame, keys: list[str], q: str, intensity: str, sigma: str, *, most_qrg: float, least_points: int) -> DataFrame:
    """(keys, n_points, rg, i0, q_max): weighted ln I = ln I0 - (q Rg)^2 / 3 over the longest valid leading stretch.

    Every leading stretch's fit comes from running sums; it is valid if the slope falls and q Rg, to nine digits, is
    ``most_qrg`` or less. The stretch ends at the first invalid fit; intensities of zero or less are passed over.
    """
    w = (F.col(intensity) / F.col(sigma)) ** 2
    x, y = F.col(q) ** 2, F.ln(intensity)
    lead = Window.partitionBy(*keys).orderBy(q).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(e).over(lead) for n, e in (("sw", w), ("sx", w * x), ("sy", w * y), ("sxx", w * x * x), ("sxy", w * x * y))}
    run = frame.where(F.col(intensity) > 0).withColumns(sums).withColumn("n", F.count(F.lit(1)).over(lead))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") ** 2, F.lit(0.0))
    run = run.withColumn("slope", slope).withColumn("rg", F.when(F.col("slope") < 0, F.sqrt(-3 * F.col("slope"))))
    valid = F.coalesce(F.round(F.col("rg") * F.col(q), 9) <= most_qrg, F.lit(False))
    run = run.where(F.col("n") >= least_points).withColumn("_bad", F.sum((~valid).cast("int")).over(lead)).where("_bad = 0")
    best = F.max_by(F.struct(F.col("n").alias("n_points"), "rg", F.exp((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("i0"), F.col(q).alias("q_max")), "n")
    return run.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def kratky_peak(frame: DataFrame, keys: list[str], q: str, intensity: str, rg: str, i0: str) -> DataFrame:
    """(keys, x, height): the largest (q Rg)^2 I / I0 and its q Rg; ties to the smaller q."""
    height = (F.col(q) * F.col(rg)) ** 2 * F.col(intensity) / F.col(i0)
    best = F.max(F.struct(height.alias("height"), (-F.col(q)).alias("m"), (F.col(q) * F.col(rg)).alias("x")))
    return frame.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.x", "b.height")


def z_profile(frame: DataFrame, series: str, position: str, value: str, least_coverage: float) -> DataFrame:
    """(position, mean_z, n): values standardised in each series, averaged where enough series have the position."""
    w = Window.partitionBy(series)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    total = frame.agg(F.count_distinct(series).alias("_all"))
    per = frame.withColumn("_z", z).groupBy(position).agg(F.avg("_z").alias("mean_z"), F.count_distinct(series).alias("n"))
    return per.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("_all") * least_coverage).drop("_all")  # one row


def ridge_left_out(frame: DataFrame, keys: list[str], target: str, features: list[str], raw: list[str], neighbour: str, *, radius: float, alpha: float, least: int) -> DataFrame:
    """Each row predicted from its group's rows more than ``radius`` away by ``neighbour``: (keys, neighbour, status, n, predicted, residual).

    Features are standardised on the training rows, raw ones are not; the loss is the mean square error plus
    alpha times the squared coefficients, the intercept free. Values are not null; a row without a place trains none.

    A group's sums of products are added up once; what a row leaves out is taken from running sums along the places of a
    block, which also holds the rows within ``radius`` of it. So no task holds a group, and no row meets its group.
    """
    z = [*features, *raw, target]
    count, p = len(z), len(features)
    names = [f"_z{i}" for i in range(count)]
    upper = np.triu_indices(count + 1)
    rows = frame.select(*keys, F.col(neighbour).cast("double").alias("_place"), *[F.col(c).cast("double").alias(n) for c, n in zip(z, names, strict=True)])
    there = F.col("_place").isNotNull() & ~F.isnan("_place")
    own = lambda name: [F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in keys]
    by = lambda name: [F.col(k).alias(f"_{name}_{k}") for k in keys]
    centre = rows.where(there).groupBy(*by("c")).agg(F.array(*[F.avg(n) for n in names]).alias("_about"))
    centred = F.array(F.lit(1.0), *[F.col(n) - F.col("_about")[i] for i, n in enumerate(names)])
    placed = rows.where(there).join(centre, own("c")).select(*keys, "_place", "_about", centred.alias("_z"))
    whole = placed.groupBy(*by("w")).agg(F.array(*[F.sum(F.col("_z")[int(i)] * F.col("_z")[int(j)]) for i, j in zip(*upper, strict=True)]).alias("_all"))
    width = _BLOCK_RADII * radius or 1.0
    block = lambda c: F.floor(c / width)
    reach = radius * (1 + 1e-9)
    dealt = placed.withColumn("_home", block(F.col("_place"))).withColumn("_block", F.explode(F.array_distinct(F.array("_home", block(F.col("_place") - reach), block(F.col("_place") + reach)))))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", kind="stable")
        places, first = np.unique(pdf["_place"].to_numpy(float), return_index=True)
        first = np.append(first, len(pdf))
        rows = np.stack(pdf["_z"].to_list())
        running = np.vstack((np.zeros(len(upper[0])), np.cumsum(rows[:, upper[0]] * rows[:, upper[1]], axis=0)))
        mine = pdf[pdf["_home"] == pdf["_block"]]
        at = mine["_place"].to_numpy(float)
        low, high = np.searchsorted(places, at - radius), np.searchsorted(places, at + radius, "right")
        # the difference of two places decides, however the sums above were rounded
        low -= (low > 0) & (np.abs(places[np.maximum(low - 1, 0)] - at) <= radius)
        low += np.abs(places[np.minimum(low, len(places) - 1)] - at) > radius
        high += (high < len(places)) & (np.abs(places[np.minimum(high, len(places) - 1)] - at) <= radius)
        high -= np.abs(places[high - 1] - at) > radius
        left_out = list(running[first[high]] - running[first[low]])
        return mine[[*keys, "_place", "_about", "_z"]].assign(_out=pd.Series(left_out, mine.index, dtype=object))

    kinds = [*[frame.schema[k] for k in keys], *T.StructType.fromDDL("_place double, _about array<double>, _z array<double>, _out array<double>").fields]
    met = dealt.groupBy(*keys, "_block").applyInPandas(near, T.StructType(kinds)).join(whole, own("w"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.zeros((len(pdf), count + 1, count + 1))
            m[:, upper[0], upper[1]] = np.stack(pdf["_all"].to_list()) - np.stack(pdf["_out"].to_list())
            m[:, upper[1], upper[0]] = m[:, upper[0], upper[1]]
            n = np.rint(m[:, 0, 0])
            ok = (n >= max(1, least)) & (n > 0)
            here, about = np.stack(pdf["_z"].to_list())[:, 1:], np.stack(pdf["_about"].to_list())
            guess, _ = ridge_fits(m, np.where(ok, n, 1.0), ok, here[:, :-1], p, alpha)
            guess = np.where(ok, about[:, -1] + guess, np.nan)
            y = about[:, -1] + here[:, -1]
            yield pdf[[*keys, "_place"]].rename(columns={"_place": neighbour}).assign(status=np.where(ok, "ok", "insufficient"), n=n.astype(int), predicted=guess, residual=y - guess)

    schema = T.StructType([*[frame.schema[k] for k in keys], T.StructField(neighbour, T.DoubleType()), *T.StructType.fromDDL("status string, n int, predicted double, residual double").fields])
    fits = met.select(*keys, "_place", "_about", "_z", "_out", "_all").mapInPandas(solve, schema)
    fits = fits.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("predicted", "residual")})
    return fits.union(rows.where(~there).select(*keys, F.col("_place").alias(neighbour), F.lit("insufficient"), F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double")))


def cluster_bootstrap(frame: DataFrame, keys: list[str], cluster: str, value: str, n_draws: int, seed: int) -> DataFrame:
    """(keys, draw, mean): means over resampled clusters, which come whole; clusters are known by their order alone.

    Clusters are first summed, so a draw meets one row a cluster.
    """
    sums = frame.groupBy(*keys, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    per = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(cluster, "_s", "_n"))), lambda x: F.struct(x["_s"].alias("s"), x["_n"].cast("double").alias("n"))).alias("_c"))

    @F.pandas_udf("array<double>")
    def means(batch: pd.Series) -> pd.Series:
        out = []
        for rows in batch:
            both = np.array([(x["s"], x["n"]) for x in rows], dtype=float)
            pick = np.random.default_rng(seed).integers(0, len(both), (n_draws, len(both)))
            total = both[pick].sum(axis=1)
            out.append((total[:, 0] / total[:, 1]).tolist())
        return pd.Series(out)

    return per.select(*keys, F.posexplode(means("_c")).alias("draw", "mean"))


def matched_set_null(frame: DataFrame, id_column: str, value: str, chosen: Column, n_draws: int, seed: int, *, block_rows: int = 4096) -> DataFrame:
    """(observed, n_draws, null_mean, null_sd, p_add_one): the chosen rows' mean against sets of their size, drawn without return.

    Rows are dealt into blocks by a hash of their ids. How many of a draw's rows come from each block is drawn for all
    blocks at once, by the same seeds in every task; each block then draws its own. A draw is a sum over blocks, so no
    task sees more than a block. Rows without a value take no part; ids are distinct.
    """
    rows = frame.where(F.col(value).isNotNull())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("k"), F.avg(F.when(chosen, F.col(value))).alias("o")).first()
    blocks = max(1, -(-size["n"] // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(blocks)).cast("int").alias("block"), F.col(id_column).alias("p"), F.col(value).cast("double").alias("v"))
    per_block = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}  # a number a block
    sizes, k = np.array([per_block.get(b, 0) for b in range(blocks)], dtype=np.int64), int(size["k"] or 0)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        v = pdf.sort_values("p")["v"].to_numpy()
        sums = np.zeros(n_draws)
        for i in range(n_draws):
            own = int(np.random.default_rng([seed, i]).multivariate_hypergeometric(sizes, k, method="marginals")[block])
            sums[i] = v[np.random.default_rng([seed, i, block]).permutation(len(v))[:own]].sum()
        return pd.DataFrame({"draw": np.arange(n_draws), "s": sums})

    means = dealt.groupBy("block").applyInPandas(draw, "draw int, s double").groupBy("draw").agg((F.sum("s") / F.nullif(F.lit(k), F.lit(0))).alias("m"))
    observed = F.lit(size["o"]).cast("double")
    return means.agg(observed.alias("observed"), F.count("m").alias("n_draws"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"), ((F.count_if(F.col("m") >= observed) + 1) / (F.count("m") + 1)).alias("p_add_one"))
