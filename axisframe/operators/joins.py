"""Joins with stated multiplicity, precedence and treatment of absence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from axisframe.store import block_pairs, blocks_of, dealt_by_pair, tasks, written

from axisframe.operators.gates import require_same_keys, require_unique

#: Vectors of a block whose pairs a task takes (at least, while blocks are few), rows of it taken at once, and pairs worked out or rows handed over at once.
_BLOCK, _SLICE, _PAIRS = 4096, 512, 1 << 16
#: Vectors of a block at most, its bytes, and rows and columns of a matrix of distances.
_WIDE, _HELD, _ROWS, _COLUMNS = 65536, 1 << 26, 256, 256
#: Pairs whose distances are all kept, distances held by a task, and vectors for each place by which a sample pairs them.
_FEW, _KEPT, _SHARE = 1 << 21, 1 << 20, 512
#: Trailing bits of a distance that a sample's count leaves out.
_BITS = 34


def join_exact(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two sides with the same keys, each once."""
    require_same_keys(require_unique(left, keys), require_unique(right, keys), keys)
    return left.join(right, keys)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that repeat on neither side."""
    return require_unique(left, keys).join(require_unique(right, keys), keys, "left")


def join_with_precedence(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which the base's own columns win wherever they are not null; an empty string wins too."""
    shared = [c for c in extra.columns if c in base.columns and c not in keys]
    renamed = extra.select(*[F.col(c).alias(f"_x_{c}" if c in shared else c) for c in extra.columns])
    joined = base.join(renamed, keys, "left")
    return joined.select(*[F.coalesce(c, f"_x_{c}").alias(c) if c in shared else F.col(c) for c in base.columns], *[c for c in extra.columns if c not in base.columns])


def override_join(rows: DataFrame, overrides: DataFrame, key: str, value: str, valid: Column, name: str) -> DataFrame:
    """``name``: the override's value for the key, else the row's own where it is valid, else null."""
    given = require_unique(overrides, [key]).select(F.col(key).alias("_k"), F.col(value).alias("_given"))
    return rows.join(given, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_given", F.when(valid, F.col(value)))).drop("_k", "_given")


def join_or_none(left: DataFrame, right: DataFrame, on: Column, marker: str, **defaults) -> DataFrame:
    """One-to-many left join: a row without a match comes once, ``marker`` says which, and defaults fill it."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}).withColumn(marker, F.coalesce("_hit", F.lit(False))).drop("_hit")


def universe_join(universe: DataFrame, conditions: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every member of the universe under every condition, with ``status`` observed or missing; absence stays null."""
    grid = universe.crossJoin(F.broadcast(conditions))  # conditions are a short list by contract
    joined = grid.join(facts.withColumn("_seen", F.lit(True)), keys, "left")
    return joined.withColumn("status", F.when(F.col("_seen"), "observed").otherwise("missing")).drop("_seen")


def pairs_across(frame: DataFrame, state: str, first, second, id_column: str) -> DataFrame:
    """Ordered pairs (a_*, b_*) of a row in the first state and a row in the second."""
    names = frame.columns
    a = frame.where(F.col(state) == first).select(*[F.col(c).alias(f"a_{c}") for c in names])
    b = frame.where(F.col(state) == second).select(*[F.col(c).alias(f"b_{c}") for c in names])
    return a.crossJoin(b).where(F.col(f"a_{id_column}").isNotNull() & F.col(f"b_{id_column}").isNotNull())


def _apart(n: int) -> Column:
    return F.sqrt(sum(((F.col(f"a_x{i}") - F.col(f"b_x{i}")) ** 2 for i in range(n)), F.lit(0.0)))


def contacts(points: DataFrame, id_column: str, coordinates: list[str], cutoff: float, *, least: float = 1e-6, groups: list[str] = ()) -> DataFrame:
    """Pairs i < j of points with least < r <= cutoff, as groups, i, j, r: an equi-join on grid cells.

    Each point lies in one cell of side ``cutoff``; one copy of the points is dealt to that cell and its neighbours,
    so every pair in reach meets in the first point's cell, once.
    """
    n = len(coordinates)
    cell = [F.floor(F.col(c) / cutoff).cast("long") for c in coordinates]
    base = points.select(*groups, F.col(id_column).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coordinates)], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    a = base.select(*groups, F.col("id").alias("i"), *[F.col(f"x{k}").alias(f"a_x{k}") for k in range(n)], *[f"c{k}" for k in range(n)])
    b = base
    for k in range(n):
        b = b.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    b = b.select(*groups, F.col("id").alias("j"), *[F.col(f"x{k}").alias(f"b_x{k}") for k in range(n)], *[f"c{k}" for k in range(n)])
    met = a.join(b, [*groups, *[f"c{k}" for k in range(n)]]).where("i < j").withColumn("r", _apart(n))
    return met.where((F.col("r") > least) & (F.col("r") <= cutoff)).select(*groups, "i", "j", "r")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all of b; near and unbounded ones, which products would blur, from differences."""
    lengths = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    square = lengths - 2 * (a @ b.T)
    one, two = np.nonzero(~(square > 1e-6 * lengths) | ~np.isfinite(square))
    for at in range(0, len(one), _PAIRS):
        i, j = one[at : at + _PAIRS], two[at : at + _PAIRS]
        square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(square)


def _matrices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    """(first row, first column, distances) of a's rows from b's; where a is b, only of columns from the first row on."""
    la, lb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    bounded = len(a) and len(b) and np.isfinite(la.max() * 4 + lb.max() * 4)
    # products with lengths as two more components are the squares
    left, right = np.column_stack([-2 * a, la, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), lb])
    for at in range(0, len(a), _ROWS):
        for to in range(at if a is b else 0, len(b), _COLUMNS):
            i, j = slice(at, at + _ROWS), slice(to, to + _COLUMNS)
            if not bounded:
                yield at, to, _distances(a[i], b[j])
                continue
            square = left[i] @ right[j].T
            near = np.flatnonzero(square.min(axis=1) <= 1e-6 * (la[i] + lb[j].max()))  # rows with pairs that products would blur
            if len(near):
                one, two = np.nonzero(square[near] <= 1e-6 * (la[i][near, None] + lb[j]))
                for k in range(0, len(one), _PAIRS):
                    x, y = near[one[k : k + _PAIRS]], two[k : k + _PAIRS]
                    square[x, y] = ((a[at + x] - b[to + y]) ** 2).sum(axis=1)
            yield at, to, np.sqrt(square, out=square)


def _whole_vectors(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the vectors that have pairs, their number, and the blocks to deal them to."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    return rows, seen["n"], blocks_of(seen["n"], _BLOCK, max(1, min(_WIDE, _HELD // (8 * max(1, seen["d"] or 0)))))


def _by_length(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[tuple]:
    """(columns of these names, vectors) of the rows of each length of a partition."""
    held: dict[int, list] = {}
    for batch in batches:
        size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for k in np.unique(size):
            own = batch if (size == k).all() else batch.filter(pa.array(size == k))
            v = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(own.num_rows, k)
            held.setdefault(int(k), []).append((*(own.column(c).to_numpy(zero_copy_only=False) for c in names), v))
    return [tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for parts in held.values()]


def _vector_pairs(vectors: DataFrame, id_column: str, vector: str, schema: T.StructType, found: Callable[[Iterator[tuple]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Rows that found(slices) gives of each two blocks of vectors; a slice is (ids of a, ids of b, distances), where a's ids
    are smaller or the blocks differ; pairs that don't count have the distance NaN.

    Blocks are dealt by a hash of ids, and each two meet in a task: memory is bounded, the work is that of all pairs.
    Vectors that are null or hold a null have no pairs, nor have those of different lengths.
    """
    rows, _, blocks = _whole_vectors(vectors, id_column, vector)
    dealt = dealt_by_pair(block_pairs(rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "own", blocks), blocks)
    kinds = to_arrow_schema(schema)

    def slices(parts: list[tuple]) -> Iterator[tuple]:
        for low, high, own, ids, v in parts:
            if low[0] != high[0]:
                one, two = own == low[0], own == high[0]
                a, b, i, j = v[one], v[two], ids[one], ids[two]
                for at, to, r in _matrices(a, b):
                    yield i[at : at + _ROWS], j[to : to + _COLUMNS], r
                continue
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            place = np.unique(ids, return_inverse=True)[1]
            for at, to, r in _matrices(v, v):
                i, j = place[at : at + _ROWS], place[to : to + _COLUMNS]
                if i[-1] >= j[0]:
                    r[i[:, None] >= j[None, :]] = np.nan
                yield ids[at : at + _ROWS], ids[to : to + _COLUMNS], r

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found(slices(_by_length(batches, ["low", "high", "own", "id"]))):
            yield from pa.Table.from_pandas(rows, schema=kinds, preserve_index=False).to_batches()

    return dealt.select("low", "high", "own", "id", "v").mapInArrow(meet, schema)


def vector_contacts(vectors: DataFrame, id_column: str, vector: str, cutoff: float, *, least: float = 1e-6) -> DataFrame:
    """Pairs i < j of vectors with least < r <= cutoff: i, j, r. For vectors of many dimensions, all of which meet."""
    kind = vectors.schema[id_column].dataType

    def found(slices: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for one, two, r in slices:
            at, to = np.nonzero((r > least) & (r <= cutoff))
            if len(at):
                i, j = one[at], two[to]
                out.append(pd.DataFrame({"i": np.where(i < j, i, j), "j": np.where(i < j, j, i), "r": r[at, to]}))
                held += len(at)
            if held >= _PAIRS:
                yield pd.concat(out, ignore_index=True)
                out, held = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return _vector_pairs(vectors, id_column, vector, T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("r", T.DoubleType())]), found)


def _bits(r) -> np.ndarray:
    """Whole numbers in the order of these distances."""
    return np.asarray(r, dtype=float).view(np.int64)


def _holding(counts: DataFrame, key: str, ranks: list[int]) -> list:
    """(key, below) of the keys that hold these ranks (from 0), given each key's ``n``; ``below`` counts what lies before."""
    upto, holds = F.col("upto"), F.lit(False)
    for m in ranks:
        holds = holds | ((upto > m) & (upto - F.col("n") <= m))
    summed = counts.withColumn("upto", F.sum("n").over(Window.orderBy(key)))
    return summed.where(holds).select(key, (upto - F.col("n")).alias("below")).orderBy(key).collect()  # as many as ranks at most


def _about_the_median(vectors: DataFrame, id_column: str, vector: str, margin: float) -> tuple[float, float]:
    """Bounds between which the median of all pairs' distances all but surely lies; no bounds for few pairs or a wide margin.

    Vectors are dealt to tasks, and each meets those that are some random numbers of rows on. So each is in as many pairs
    of the sample, in which the median's rank strays by half the root of their number; ``margin`` is in such roots.
    """
    rows, count, blocks = _whole_vectors(vectors, id_column, vector)
    if count * (count - 1) // 2 <= _FEW:
        return -np.inf, np.inf
    rounds = max(16, count // _SHARE)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _by_length(batches, [])
        whole = sum(len(v) for (v,) in parts)
        for (v,) in parts:
            if len(v) < 2:
                continue
            random, twice, held, counted = np.random.default_rng(len(v)), np.concatenate([v, v]), [], pd.Series(dtype="int64")
            times = -(-rounds * len(v) // whole)
            for k in range(times):
                by = int(random.integers(1, len(v)))
                for at in range(0, len(v), _SLICE):
                    gap = v[at : at + _SLICE] - twice[at + by : min(at + _SLICE, len(v)) + by]
                    held.append(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
                if len(held) * _SLICE >= _KEPT or k == times - 1:
                    r = np.concatenate(held)
                    bucket, n = np.unique(_bits(r[~np.isnan(r)]) >> _BITS, return_counts=True)
                    held, counted = [], counted.add(pd.Series(n, bucket), fill_value=0)
            yield pa.RecordBatch.from_arrays([pa.array(counted.index.to_numpy(np.int64)), pa.array(counted.to_numpy(np.int64))], ["bucket", "n"])

    sample = written(rows.repartition(blocks, F.xxhash64("id")).select("v").mapInArrow(paired, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "sample")
    seen = sample.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranks = [int(seen / 2 + k * margin * seen**0.5 / 2) for k in (-1, 1)]
    if ranks[0] <= 0 or ranks[1] >= seen - 1:
        return -np.inf, np.inf
    found = _holding(sample, "bucket", ranks)
    low, high = (np.array([found[0]["bucket"] << _BITS, ((found[-1]["bucket"] + 1) << _BITS) - 1])).view(float)
    return float(low), float(high) if high == high else np.inf


def vector_pair_statistics(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(median, max, mean, n) of the distances of all pairs of vectors, exact.

    A sample gives bounds of the median; tasks then count all pairs below them and hand over only the distances between
    them, with their counts. Bounds that don't hold the median, as the counts show, are drawn wider and all is done anew.
    """
    margin = 12.0
    while True:
        low, high = _about_the_median(vectors, id_column, vector, margin)
        shift = max(0, int(_bits(high) - _bits(max(low, 0.0))).bit_length() - 16)

        def rows(r: list, low=low, shift=shift) -> pd.DataFrame:
            value, n = np.unique(np.concatenate(r), return_counts=True)
            return pd.DataFrame({"bucket": _bits(value) >> shift, "r": value, "n": n, "below": 0, "total": 0.0, "top": 0.0})

        def counted(slices: Iterator[tuple], low=low, high=high, rows=rows) -> Iterator[pd.DataFrame]:
            n, below, total, top, kept, held = 0, 0, 0.0, np.nan, [], 0
            for _, _, r in slices:
                r = r.ravel()
                if np.isnan(most := r.max()):
                    r = r[~np.isnan(r)]
                    if not len(r):
                        continue
                    most = r.max()
                n, total, top = n + len(r), total + float(r.sum()), np.fmax(top, most)
                inside = r >= low
                below += len(r) - np.count_nonzero(inside)
                inside &= r <= high
                kept.append(r[inside])
                held += len(kept[-1])
                if held >= _KEPT:
                    yield rows(kept)
                    kept, held = [], 0
            if held:
                yield rows(kept)
            yield pd.DataFrame({"bucket": [-1], "r": [np.nan], "n": [n], "below": [below], "total": [total], "top": [top]})

        per = written(_vector_pairs(vectors, id_column, vector, T.StructType.fromDDL("bucket long, r double, n long, below long, total double, top double"), counted), "distances")
        sums, values = per.where("bucket < 0"), per.where("bucket >= 0")
        s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "below")], F.sum("total").alias("total"), F.max("top").alias("top")).first()
        spark = vectors.sparkSession
        schema = "median double, max double, mean double, n long"
        if not s["n"]:
            return spark.createDataFrame([(None, None, None, 0)], schema)
        middle = [(s["n"] - 1) // 2 - s["below"], s["n"] // 2 - s["below"]]
        held = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if middle[0] >= 0 and middle[1] < held:
            break
        margin *= 16
    found = _holding(values.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket", middle)
    exact = values.where(F.col("bucket").isin([r["bucket"] for r in found])).groupBy("r").agg(F.sum("n").alias("n"))
    ends = _holding(exact, "r", [m - found[0]["below"] for m in middle])
    return spark.createDataFrame([((ends[0]["r"] + ends[-1]["r"]) / 2, s["top"], s["total"] / s["n"], s["n"])], schema)


def partner_census(receptor: DataFrame, partners: DataFrame, groups: list[str], role: str, point_id: str, coordinates: list[str], cutoff: float) -> DataFrame:
    """(groups, role, n, min_distance, n_pairs_within, reaches): how near each partner comes to its receptor.

    Points of a structure (``groups``) meet in cells; ids are distinct in each table. ``reaches`` says whether any pair
    is within the cutoff. A partner without a receptor has a null distance and doesn't reach.
    """
    met = nearest(partners, receptor, point_id, point_id, [(c, c) for c in coordinates], cutoff, groups=groups)
    each = partners.dropna(subset=coordinates).select(*groups, role, point_id).join(met, point_id, "left")
    least = F.min("min_distance")
    return each.groupBy(*groups, role).agg(F.count(F.lit(1)).alias("n"), least.alias("min_distance"), F.coalesce(F.sum("n_within"), F.lit(0)).alias("n_pairs_within"), F.coalesce(least <= cutoff, F.lit(False)).alias("reaches"))


def contact_groups(pairs: DataFrame, labels: DataFrame, id_column: str, label: str, *, position: str, apart: int = 2) -> DataFrame:
    """(group, residue, contact_class, n_edges): contacts between points more than ``apart`` positions from one another.

    Each contact counts at both of its ends; a group is an end's position and the contact's class.
    """
    typed = typed_contacts(pairs, labels, id_column, label)
    places = [labels.select(F.col(id_column).alias(end), F.col(position).alias(f"_p{end}")) for end in ("i", "j")]
    far = typed.join(places[0], "i").join(places[1], "j").where(F.abs(F.col("_pi") - F.col("_pj")) > apart)
    ends = far.select("contact_class", F.explode(F.array("_pi", "_pj")).alias("residue"))
    counted = ends.groupBy("residue", "contact_class").agg(F.count(F.lit(1)).alias("n_edges"))
    return counted.select(F.concat_ws(":", "residue", "contact_class").alias("group"), "residue", "contact_class", "n_edges")


def typed_contacts(pairs: DataFrame, labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Each pair with its ``contact_class``: the two ends' labels, smaller first."""
    one = labels.select(F.col(id_column).alias("i"), F.col(label).alias("_li"))
    two = labels.select(F.col(id_column).alias("j"), F.col(label).alias("_lj"))
    joined = pairs.join(one, "i").join(two, "j")
    return joined.withColumn("contact_class", F.concat_ws("-", F.least("_li", "_lj"), F.greatest("_li", "_lj"))).drop("_li", "_lj")


def _crowded(here: DataFrame, there: DataFrame, sizes: DataFrame, cells: list[str], n: int, cutoff: float) -> DataFrame:
    """(_id, _best, _k) of each row of ``here`` in each of these cells and each tile of the cell's rows ``there``.

    A cell's rows are dealt by a hash of ids into tiles of about ``_BLOCK`` on both sides, and each two meet in a task as
    matrices: no task holds a whole cell, and no pair leaves its task.
    """
    of = {"_na": "_own_a", "_nb": "_own_b"}
    tiled = lambda frame, own, other, key: frame.join(sizes, cells).withColumn(of[own], F.pmod(F.xxhash64(key), F.ceil(F.col(own) / _BLOCK)).cast("int")).withColumn(of[other], F.explode(F.sequence(F.lit(0), (F.ceil(F.col(other) / _BLOCK) - 1).cast("int")))).drop("_na", "_nb")
    one, two = tiled(here, "_na", "_nb", "_id"), tiled(there, "_nb", "_na", "_to")
    one = one.select(*cells, *of.values(), "_id", *[f"a_x{i}" for i in range(n)])

    def meet(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_id": [], "_d": [], "_to": [], "_k": []}).astype({"_id": a["_id"].dtype, "_to": b["_to"].dtype, "_k": "int64"})
        b = b.sort_values("_to")  # of equally near ones, the first is the smallest
        to, parts = b["_to"].to_numpy(), []
        for at in range(0, len(a), _SLICE):
            some = a.iloc[at : at + _SLICE]
            square = np.zeros((len(some), len(b)))
            for i in range(n):
                square += (some[f"a_x{i}"].to_numpy()[:, None] - b[f"b_x{i}"].to_numpy()[None, :]) ** 2
            d = np.sqrt(square)
            least = d.argmin(axis=1)
            parts.append(pd.DataFrame({"_id": some["_id"].to_numpy(), "_d": d[np.arange(len(some)), least], "_to": to[least], "_k": (d <= cutoff).sum(axis=1)}))
        return pd.concat(parts)

    schema = T.StructType([T.StructField("_id", here.schema["_id"].dataType), T.StructField("_d", T.DoubleType()), T.StructField("_to", there.schema["_to"].dataType), T.StructField("_k", T.LongType())])
    keys = [*cells, *of.values()]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(meet, schema).select("_id", F.struct("_d", "_to").alias("_best"), "_k")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, coordinates: list[tuple[str, str]], cutoff: float, *, groups: list[str] = ()) -> DataFrame:
    """Per left row: its nearest right row (ties to the smaller id), the distance, and how many lie within cutoff.

    With ``groups`` (columns of both sides), only rows of one group meet, and a row whose group has none on the right
    has nulls and 0.

    Points meet in cells of side ``cutoff`` and their neighbours; rows whose nearest is not surely among those go on to
    cells four times as large, and so on, so only far-off rows meet many others. Crowded cells are cut into tiles, whose
    memory is bounded; what lies within the cutoff is counted, so their work is that of all pairs. Rows without a coordinate are left
    out; ids are distinct. An empty right side gives no rows.
    """
    n = len(coordinates)
    # groups get names of their own: where both sides come from one table, they would be ambiguous in a cogroup
    named = [F.col(g).alias(g) for g in groups]
    a = left.select(*named, F.col(left_id).alias("_id"), *[F.col(c[0]).cast("double").alias(f"a_x{i}") for i, c in enumerate(coordinates)]).dropna()
    b = right.select(*named, F.col(right_id).alias("_to"), *[F.col(c[1]).cast("double").alias(f"b_x{i}") for i, c in enumerate(coordinates)]).dropna()
    spans = [x.agg(*[f(c) for c in x.columns[1 + len(groups) :] for f in (F.min, F.max)]).first() for x in (a, b)]
    empty = a.select(F.col("_id").alias(left_id)).limit(0).crossJoin(b.select(F.col("_to").alias("nearest_id")).limit(0)).select(left_id, "nearest_id", F.lit(0.0).alias("min_distance"), F.lit(0).cast("long").alias("n_within"))
    if any(v is None for s in spans for v in s):
        return empty
    extent = max(max(s[2 * i + 1] for s in spans) - min(s[2 * i] for s in spans) for i in range(n))
    side, found, left_over = float(cutoff), empty, a.withColumn("_near", F.lit(None).cast("long"))
    while True:
        here = left_over
        for i in range(n):
            here = here.withColumn(f"c{i}", F.explode(F.array(*[F.floor(F.col(f"a_x{i}") / side).cast("long") + d for d in (-1, 0, 1)])))
        there = b.withColumns({f"c{i}": F.floor(F.col(f"b_x{i}") / side).cast("long") for i in range(n)})
        cells = [*groups, *[f"c{i}" for i in range(n)]]
        sizes = here.groupBy(*cells).agg(F.count(F.lit(1)).alias("_na")).join(there.groupBy(*cells).agg(F.count(F.lit(1)).alias("_nb")), cells)
        sizes = written(sizes.where(F.col("_na") * F.col("_nb") > _BLOCK), "cells")
        met = here.join(there, cells) if sizes.isEmpty() else here.join(sizes, cells, "left_anti").join(there, cells)
        found_here = met.withColumn("_d", _apart(n)).groupBy("_id").agg(F.min(F.struct("_d", "_to")).alias("_best"), F.count_if(F.col("_d") <= cutoff).alias("_k"))
        crowded = _crowded(here, there, sizes, cells, n, cutoff)
        best = found_here.union(crowded).groupBy("_id").agg(F.min("_best").alias("_best"), F.sum("_k").alias("_k"))
        # the first cells hold all that lies within the cutoff
        tried = written(left_over.join(best, "_id", "left").withColumn("_near", F.coalesce("_near", "_k", F.lit(0))).drop("_k"), "nearest")
        last = side >= extent
        sure = F.lit(last) | F.coalesce(F.col("_best._d") <= side, F.lit(False))
        found = found.union(tried.where(sure).select(F.col("_id").alias(left_id), "_best._to", "_best._d", "_near"))
        left_over = tried.where(~sure).drop("_best")
        if last or left_over.isEmpty():
            return found
        side *= 4


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int, keys: list[str] = ()) -> DataFrame:
    """Points with the intervals [low, high] that hold them: an equi-join on bins of ``width``."""
    binned = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    dealt = points.withColumn("_bin", F.floor(F.col(point) / width))
    return dealt.join(binned, [*keys, "_bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_bin")


def best_partner(left: DataFrame, right: DataFrame, left_id: str, right_id: str, member: str, least: int = 1) -> DataFrame:
    """Per left id: the right id that shares most members (ties to the smaller id), with ``n_shared`` >= least."""
    parts = max(tasks(left), tasks(right))  # a task's share stays the same as tables grow
    a, b = (x.repartition(parts, member).distinct() for x in (left.select(left_id, member), right.select(right_id, member)))
    shared = a.join(b, member).select(left_id, right_id).repartition(parts, left_id).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("n_shared"))
    w = Window.partitionBy(left_id).orderBy(F.col("n_shared").desc(), right_id)
    return shared.where(F.col("n_shared") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
