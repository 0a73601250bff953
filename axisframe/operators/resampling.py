"""Draws and resamples whose rows depend on the seed and their own number alone, however Spark deals them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.functions.vectors import dot
from axisframe.operators.ensemble import cluster_sums
from axisframe.operators.geometry import rigid_directions
from axisframe.operators.order import numbered
from axisframe.store import written


def subspace_draws(spark: SparkSession, basis: np.ndarray, n: int, seed: int, parts: int = 8) -> DataFrame:
    """(draw, direction): uniform directions in the span of orthonormal columns, drawn in full space and projected.

    Turning or flipping the basis leaves the draws as they are.
    """
    basis = np.asarray(basis, dtype=float)
    if basis.ndim != 2 or not basis.shape[1] or not np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-10):
        raise ValueError("the basis' columns must be orthonormal")

    def run(batches):
        for pdf in batches:
            full = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(basis)) for i in pdf["draw"]]) if len(pdf) else np.zeros((0, len(basis)))
            inside = full @ basis
            inside /= np.linalg.norm(inside, axis=1, keepdims=True)
            yield pd.DataFrame({"draw": pdf["draw"], "direction": list(inside @ basis.T)})

    return spark.range(0, n, 1, parts).withColumnRenamed("id", "draw").mapInPandas(run, "draw long, direction array<double>")


def random_subspace_overlaps(frame: DataFrame, key: str, dimension: str, k: str, n: int, seed: int) -> DataFrame:
    """(key, draw, rmsip): root mean square inner product of two random subspaces, of each row's dimension and number of modes.

    A uniform subspace against a fixed one has the law of two uniform ones, so only one is drawn: the first k rows of
    k orthonormal columns. Draws depend on the seed, the dimension and k alone; k is at most the dimension.
    """

    def run(batches):
        known: dict[tuple[int, int], list[float]] = {}
        for pdf in batches:
            for name, d, m in zip(pdf[key], pdf[dimension].astype(int), pdf[k].astype(int), strict=True):
                if (d, m) not in known:
                    drawn = (np.random.default_rng([seed, d, m, i]).standard_normal((d, m)) for i in range(n))
                    known[d, m] = [float(np.sqrt((np.linalg.qr(x)[0][:m] ** 2).sum() / m)) for x in drawn]
                yield pd.DataFrame({key: [name] * n, "draw": np.arange(n), "rmsip": known[d, m]})

    schema = T.StructType([T.StructField(key, frame.schema[key].dataType), *T.StructType.fromDDL("draw long, rmsip double").fields])
    return frame.select(key, dimension, k).mapInPandas(run, schema)


def axis_resamples(frame: DataFrame, cluster: str, vector: str, is_first: str, n: int, seed: int, *, balanced: int | None = None, block_rows: int = 256) -> DataFrame:
    """(draw, status, overlap): the state axis of resampled clusters against the axis of all rows.

    Clusters (ids for an entry bootstrap, studies for a cluster bootstrap) are drawn with replacement and come whole;
    with ``balanced``, that many clusters of each state alone are drawn without replacement. Clusters are known by
    their order. A draw without both states has status ``one state`` and no overlap.

    Clusters are summed and numbered, and each ``block_rows`` of them are a task: how many of a draw fall to each
    block comes from the same seeds everywhere, how often each cluster is taken from the block's own, and a draw is
    the sum of the blocks' weighted sums.
    """
    per = cluster_sums(frame, cluster, vector, F.col(is_first), ~F.col(is_first)).where("c is not null")
    pure = [(F.col("na") > 0) & (F.col("nb") == 0), (F.col("nb") > 0) & (F.col("na") == 0)]
    placed = numbered(per, [F.col("c")], "at").withColumn("block", F.floor(F.col("at") / block_rows).cast("int"))
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(pure[0]).alias("a"), F.count_if(pure[1]).alias("b")).orderBy("block").collect()  # three numbers a block
    blocks = [np.array([r[c] for r in sizes], dtype=np.int64) for c in ("n", "a", "b")]

    def weights(draw: int, block: int, own: int, pools: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(own)
        if balanced is None:
            share = np.random.default_rng([seed, draw]).multinomial(blocks[0].sum(), blocks[0] / blocks[0].sum())[block]
            return np.random.default_rng([seed, draw, block]).multinomial(share, np.full(own, 1 / own)).astype(float)
        for state, pool in enumerate(pools):
            if blocks[1 + state].sum() >= balanced:
                share = np.random.default_rng([seed, draw, state]).multivariate_hypergeometric(blocks[1 + state], balanced, method="marginals")[block]
                out[np.random.default_rng([seed, draw, state, block]).permutation(pool)[:share]] = 1.0
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        block = int(pdf["block"].iloc[0])
        a, b = (np.stack(pdf[c].to_list()).astype(float) for c in ("a", "b"))
        counts = pdf[["na", "nb"]].to_numpy(float)
        pools = [np.flatnonzero((counts[:, i] > 0) & (counts[:, 1 - i] == 0)) for i in (0, 1)]
        w = np.stack([np.ones(len(pdf)), *[weights(draw, block, len(pdf), pools) for draw in range(n)]])  # draw -1 is all rows
        return pd.DataFrame({"draw": np.arange(-1, n), "a": list(w @ a), "b": list(w @ b), "na": w @ counts[:, 0], "nb": w @ counts[:, 1]})

    parts = placed.select("block", "at", "a", "b", "na", "nb").groupBy("block").applyInPandas(run, "draw int, a array<double>, b array<double>, na double, nb double")
    counts = parts.groupBy("draw").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    cells = parts.select("draw", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "s")).groupBy("draw", "pos").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    gaps = written(cells.join(counts, "draw").where("na > 0 and nb > 0").select("draw", "pos", (F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("g")), "resampled-axes")
    whole = gaps.where("draw = -1").select("pos", F.col("g").alias("w"))
    size = F.sqrt(F.sum(F.col("g") * F.col("g")) * F.sum(F.col("w") * F.col("w")))
    met = gaps.where("draw >= 0").join(whole, "pos").groupBy("draw").agg((F.sum(F.col("g") * F.col("w")) / F.nullif(size, F.lit(0.0))).alias("overlap"))
    drawn = frame.sparkSession.range(n).select(F.col("id").cast("int").alias("draw"))
    both = counts.where("na > 0 and nb > 0").select("draw", F.lit("ok").alias("status"))
    return drawn.join(both, "draw", "left").join(met, "draw", "left").select("draw", F.coalesce("status", F.lit("one state")).alias("status"), "overlap")


def median_subsets(frame: DataFrame, column: str) -> tuple[dict, float | None]:
    """({"better": rows under the median, "worse": the others}, the median); null values are in neither."""
    middle = frame.agg(F.median(column)).first()[0]
    return {"better": F.col(column) < F.lit(middle), "worse": F.col(column) >= F.lit(middle)}, middle


def subset_overlap(frame: DataFrame, vector: str, subsets: dict, k: int, modes: DataFrame | None = None) -> DataFrame:
    """(subset, n, rmsip): leading components of each subset of rows against those of all rows, or against given ``modes``.

    ``modes`` has (component, loading), of which the first k count.
    """
    from axisframe.operators.ensemble import principal_components

    whole = (principal_components(frame, vector, k) if modes is None else modes.where(F.col("component") <= k)).select(F.col("component").alias("i"), F.col("loading").alias("u"))
    out = None
    for name, condition in subsets.items():
        part = frame.where(condition)
        own = principal_components(part, vector, k).select(F.col("component").alias("j"), F.col("loading").alias("v"))
        d = dot(F.col("u"), F.col("v"))
        one = whole.crossJoin(own).agg(F.sqrt(F.sum(d * d) / k).alias("rmsip")).select(F.lit(name).alias("subset"), "rmsip").crossJoin(part.agg(F.count(F.lit(1)).alias("n")))
        out = one if out is None else out.unionByName(one)
    return out.select("subset", "n", "rmsip")


def set_percentiles(frame: DataFrame, position: str, value: str, members: DataFrame) -> DataFrame:
    """(set, universe, n, percentile): the mean weak percentile of each set's positions, among all and among common ones.

    ``members`` is (set, position); common positions are those that some set names.
    """
    u = frame.select(F.col(position).alias("p"), F.col(value).alias("v")).where("v is not null")
    named = members.select("set", F.col("position").alias("p"))
    common = named.select("p").distinct()
    out = None
    for name, universe in (("all", u), ("common", u.join(common, "p", "left_semi"))):
        # ranks by value counts: a running sum over distinct values, not over rows
        from pyspark.sql.window import Window

        counts = universe.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        ranked = counts.select("v", (100 * F.sum("k").over(Window.orderBy("v")) / F.sum("k").over(Window.partitionBy())).alias("pct"))
        one = universe.join(ranked, "v").join(named, "p").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.avg("pct").alias("percentile")).withColumn("universe", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("set", "universe", "n", "percentile")


def rotation_basis(points: np.ndarray, moving: np.ndarray, axis: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Three orthonormal columns that span the small rotations of the moving points about a pivot, less whole-body motion.

    The pivot is the moving points' centroid dropped on the frozen axis. The rotations are about the axis, about the
    direction from it to the first moving point off it, and about the third direction; they are whitened symmetrically,
    so the columns turn with the structure.
    """
    along = axis / np.linalg.norm(axis)
    pivot = point + along * ((points[moving].mean(axis=0) - point) @ along)
    radial = points[moving] - pivot
    radial = radial - np.outer(radial @ along, along)
    off = np.flatnonzero(np.linalg.norm(radial, axis=1) > 1e-9)
    if len(moving) < 3 or not len(off):
        raise ValueError("three moving points are needed, not all on the axis")
    across = radial[off[0]] / np.linalg.norm(radial[off[0]])
    fields = np.zeros((3, *points.shape))
    for field, about in zip(fields, (along, across, np.cross(along, across)), strict=True):
        field[moving] = np.cross(about, points[moving] - pivot)
    inside = fields.reshape(3, -1).T
    whole = rigid_directions(points)
    inside = inside - whole @ (whole.T @ inside)
    size, turn = np.linalg.eigh(inside.T @ inside)
    if size[0] <= 1e-12 * size[-1]:
        raise ValueError("the rotations are not independent of whole-body motion")
    return inside @ (turn / np.sqrt(size)) @ turn.T


def rotation_null(frame: DataFrame, key: str, coordinates: str, moving: list[int], axis: str, point: str, direction: str, n: int, seed: int) -> DataFrame:
    """(key, draw, status, coefficients, overlap): directions drawn uniformly in each structure's ``rotation_basis``.

    ``overlap`` is the magnitude of a draw's product with the structure's direction (a flat array), whole-body motion
    taken out of it and unit length given to it. Draw -1 is the rotation about the frozen axis itself. Draws are the
    coefficients' alone: a structure that is turned with its axis and direction has the same rows. Structures without
    such a basis, or without a direction inside, have one row with a status and nulls.
    """
    at = np.asarray(moving, dtype=int)
    names = ["draw", "status", "coefficients", "overlap"]

    def run(batches):
        drawn = np.stack([np.random.default_rng([seed, i]).standard_normal(3) for i in range(n)]) if n else np.zeros((0, 3))
        drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
        for pdf in batches:
            for name, *given in zip(pdf[key], *(pdf[c] for c in (coordinates, axis, point, direction)), strict=True):
                points, about, through, along = (np.asarray(v, dtype=float) for v in given)
                points = points.reshape(-1, 3)
                try:
                    basis = rotation_basis(points, at, about, through)
                except ValueError as error:
                    yield pd.DataFrame({key: [name], "draw": [-1], "status": [str(error)], "coefficients": [None], "overlap": [None]})
                    continue
                whole = rigid_directions(points)
                inside = along - whole @ (whole.T @ along)
                size = np.linalg.norm(inside)
                if size <= 1e-9:
                    yield pd.DataFrame({key: [name], "draw": [-1], "status": ["no direction inside"], "coefficients": [None], "overlap": [None]})
                    continue
                centre = points[at].mean(axis=0)
                tangent = np.zeros_like(points)
                tangent[at] = np.cross(about, points[at] - (through + about * ((centre - through) @ about) / (about @ about)))
                own = basis.T @ tangent.ravel()
                rows = np.vstack((own / np.linalg.norm(own), drawn))
                yield pd.DataFrame({key: [name] * len(rows), "draw": np.arange(-1, n), "status": "ok", "coefficients": list(rows), "overlap": np.abs(rows @ (basis.T @ inside)) / size})

    schema = T.StructType([T.StructField(key, frame.schema[key].dataType), *T.StructType.fromDDL("draw int, status string, coefficients array<double>, overlap double").fields])
    return frame.select(key, coordinates, axis, point, direction).mapInPandas(run, schema).select(key, *names)


def permuted_null(frame: DataFrame, key: str, direction: str, along: list[float], n: int, seed: int) -> DataFrame:
    """(key, draw, overlap): each direction with its own components dealt anew, against a fixed one; draw -1 is as it is.

    A draw keeps every component's value, so its marginals are the direction's own. The permutation is a function of
    the seed, the draw and the number of components alone.
    """
    fixed = np.asarray(along, dtype=float)
    fixed = fixed / np.linalg.norm(fixed)
    block = 256

    def run(batches):
        deals: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for name, vector in zip(pdf[key], pdf[direction], strict=True):
                own = np.asarray(vector, dtype=float)
                size = np.linalg.norm(own)
                found = [np.array([own @ fixed])]
                for low in range(0, n, block):
                    if (low, len(own)) not in deals:
                        deals[low, len(own)] = np.random.default_rng([seed, low, len(own)]).random((block, len(own))).argsort(axis=1, kind="stable")
                    found.append(own[deals[low, len(own)][: min(block, n - low)]] @ fixed)
                overlaps = np.abs(np.concatenate(found)) / size if size else np.full(n + 1, np.nan)
                yield pd.DataFrame({key: [name] * (n + 1), "draw": np.arange(-1, n), "overlap": overlaps})

    schema = T.StructType([T.StructField(key, frame.schema[key].dataType), *T.StructType.fromDDL("draw int, overlap double").fields])
    return frame.select(key, direction).mapInPandas(run, schema)


def marginal_null(frame: DataFrame, key: str, dimension: str, n: int, seed: int) -> DataFrame:
    """(key, draw, overlap): overlaps of uniform directions of ``dimension`` components with any fixed one.

    Drawn from their exact law, a normal component over its length with the others' chi-square, and so at the same
    cost in any dimension. One component alone always overlaps fully. Draws depend on the seed and the dimension.
    """

    def run(batches):
        for pdf in batches:
            for name, d in zip(pdf[key], pdf[dimension].astype(int), strict=True):
                random = np.random.default_rng([seed, d])
                a, rest = random.standard_normal(n), random.chisquare(d - 1, n) if d > 1 else np.zeros(n)
                yield pd.DataFrame({key: [name] * n, "draw": np.arange(n), "overlap": np.abs(a) / np.sqrt(a**2 + rest)})

    schema = T.StructType([T.StructField(key, frame.schema[key].dataType), *T.StructType.fromDDL("draw int, overlap double").fields])
    return frame.select(key, dimension).mapInPandas(run, schema)
