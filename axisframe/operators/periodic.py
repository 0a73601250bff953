"""Chains in a periodic box made whole: nearest images along each chain, then whole bodies moved by whole boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inverse3(m: Column) -> Column:
    """The inverse of a 3 x 3 matrix given row by row as an array of nine; null where it has none worth the name.

    That is: an element is null or not finite, or the determinant's magnitude is below 1e-6.
    """
    a = [F.get(m, i) for i in range(9)]
    minor = lambda i, j, k, l: a[i] * a[l] - a[j] * a[k]  # noqa: E731, E741
    rows = [(4, 5, 7, 8), (2, 1, 8, 7), (1, 2, 4, 5), (5, 3, 8, 6), (0, 2, 6, 8), (2, 0, 5, 3), (3, 4, 6, 7), (1, 0, 7, 6), (0, 1, 3, 4)]
    found = [minor(*r) for r in rows]
    size = a[0] * found[0] + a[1] * found[3] + a[2] * found[6]
    good = F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(m) == 9) & (F.abs(size) >= 1e-6)
    return F.when(good, F.array(*[f / size for f in found]))


def _times(v: list[Column], m: Column) -> list[Column]:
    """The row vector times the matrix."""
    return [sum((v[i] * F.get(m, 3 * i + j) for i in range(1, 3)), v[0] * F.get(m, j)) for j in range(3)]


def unwrapped_chains(points: DataFrame, frames: list[str], chain: str, order: str, coordinates: list[str], box: str) -> DataFrame:
    """The points with each chain made whole: every point at the image nearest to the one before it.

    ``box`` is an array of nine: the three box vectors row by row (of any angles). A step of whole boxes anywhere along
    a chain moves all that follows, so the turns are a running sum and chains are folded without a loop. Halves of a
    box go to the even number of turns. Points of a frame whose box is null, not finite or flat stay as they are.
    """
    inverse = inverse3(F.transform(box, lambda x: x.cast("double")))
    w = Window.partitionBy(*frames, chain).orderBy(order)
    placed = points.withColumn("_inv", inverse)
    xyz = [F.col(c).cast("double") for c in coordinates]
    step = placed
    for k, f in enumerate(_times(xyz, F.col("_inv"))):
        step = step.withColumn(f"_f{k}", f)
    turns = [F.coalesce(F.rint(F.col(f"_f{k}") - F.lag(f"_f{k}").over(w)), F.lit(0.0)) for k in range(3)]
    step = step.withColumns({f"_t{k}": t for k, t in enumerate(turns)})
    running = [F.sum(f"_t{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in range(3)]
    step = step.withColumns({f"_k{k}": r for k, r in enumerate(running)})
    back = _times([F.col(f"_k{k}") for k in range(3)], F.transform(box, lambda x: x.cast("double")))
    moved = {c: F.when(F.col("_inv").isNull(), x).otherwise(x - b) for c, x, b in zip(coordinates, xyz, back, strict=True)}
    return step.withColumns(moved).select(*points.columns)


def bodies_together(points: DataFrame, frames: list[str], coordinates: list[str], box: str, moving: Column, anchor: Column) -> DataFrame:
    """The points with the ``moving`` ones shifted by whole boxes, so that their mean is nearest to the ``anchor`` points' mean.

    Frames without points of either kind, or without a usable box, stay as they are.
    """
    sums = [F.avg(F.when(which, F.col(c).cast("double"))).alias(f"_{name}{k}") for name, which in (("m", moving), ("a", anchor)) for k, c in enumerate(coordinates)]
    means = points.groupBy(*frames).agg(*sums, F.first(F.transform(box, lambda x: x.cast("double"))).alias("_b"))
    inverse = inverse3(F.col("_b"))
    away = _times([F.col(f"_m{k}") - F.col(f"_a{k}") for k in range(3)], inverse)
    shift = _times([F.rint(f) for f in away], F.col("_b"))
    shifts = means.select(*[F.col(f).alias(f"_by_{f}") for f in frames], *[F.coalesce(s, F.lit(0.0)).alias(f"_s{k}") for k, s in enumerate(shift)])
    on = [F.col(f).eqNullSafe(F.col(f"_by_{f}")) for f in frames]
    met = points.join(shifts, on)
    return met.withColumns({c: F.col(c).cast("double") - F.when(moving, F.col(f"_s{k}")).otherwise(0.0) for k, c in enumerate(coordinates)}).select(*points.columns)
