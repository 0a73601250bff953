"""Exact top-k search: tiles of queries times shards of candidates, partial selection per tile, and a tree of merges.

Vectors hold integers. Rows are packed into tiles (one row each: ids and a matrix); every query tile meets every
candidate tile once, one matrix product each, and only the best k of each query in each tile go on. Lists of up to
``fan_in`` tiles are then merged at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.llm.common import written

_TILE = "dim int, ids binary, kind string, matrix binary"


def scaled(frame: DataFrame, vector: str, factor: int) -> DataFrame:
    """The rows whose vector has components, all finite, each turned into floor(factor * x) as a double."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor of a double column is a long in Spark, beyond which a product could not be exact anyway
    return frame.where(usable).withColumn(vector, F.transform(v, lambda x: F.floor(x.cast("double") * float(factor))))


def _packed(frame: DataFrame, rows: int, total: int) -> DataFrame:
    def pack(batches):
        held: dict[int, list] = {}

        def tile(dim):
            ids, matrix = (np.concatenate([x[i] for x in held[dim]]) for i in (0, 1))
            held[dim] = []
            for low in range(0, len(ids), rows):
                m = matrix[low : low + rows]
                kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or (m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max))
                yield dim, ids[low : low + rows].astype("<i8").tobytes(), kind, m.astype(kind).tobytes()

        for pdf in batches:
            dims = pdf["v"].map(len)
            for dim, part in pdf.groupby(dims):
                held.setdefault(int(dim), []).append((part["i"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.int64)))
                if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                    yield pd.DataFrame(list(tile(int(dim))), columns=["dim", "ids", "kind", "matrix"])
        left = [t for dim in held if held[dim] for t in tile(dim)]
        if left:
            yield pd.DataFrame(left, columns=["dim", "ids", "kind", "matrix"])

    return frame.repartition(max(1, -(-total // rows))).mapInPandas(pack, _TILE)


def _best(q_ids, q, c_ids, c, k):
    """(query, candidate, score) of each query's k best, ties to the smaller id, its own id left out."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if most * len(c_ids) < 2**52:  # sums and keys are exact in doubles
        key = (q.astype(np.float64) @ c.astype(np.float64).T) * len(c_ids) + np.arange(len(c_ids) - 1, -1, -1)
        key[q_ids[:, None] == c_ids[None, :]] = -np.inf
        n = min(k, len(c_ids))
        at = np.argpartition(key, len(c_ids) - n, axis=1)[:, len(c_ids) - n :]
        rows, at = np.repeat(np.arange(len(q_ids)), n), at.ravel()
        good = np.isfinite(key[rows, at])
        rows, at = rows[good], at[good]
    else:
        picked = []
        for i in range(len(q_ids)):
            own = np.flatnonzero(c_ids != q_ids[i])
            exact = c[own].astype(object) @ q[i].astype(object)
            picked += [(i, own[j]) for j in sorted(range(len(own)), key=lambda j: (-exact[j], c_ids[own[j]]))[:k]]
        rows, at = np.array([p[0] for p in picked], dtype=int), np.array([p[1] for p in picked], dtype=int)
    return q_ids[rows], c_ids[at], (q[rows].astype(np.int64) * c[at].astype(np.int64)).sum(axis=1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, id_column: str, vector: str, tile_rows: int = 4096, query_rows: int = 512, fan_in: int = 64) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): the k candidates of highest inner product of each query.

    ``vector`` is an array of whole numbers whose products fit a long. Ties go to the smaller id. Candidates that
    bear the query's id are its own and left out. Rows with a null id or vector take no part; vectors of different
    lengths never meet. A query id that repeats is asked once, with its smallest vector; repeated candidates all
    count. A query with fewer candidates has fewer rows. An empty side gives no rows. Other columns are ignored.
    """
    wanted = [F.col(id_column).cast("long").alias("i"), F.col(vector).cast("array<bigint>").alias("v")]
    asked = queries.select(*wanted).where("i is not null and v is not null").groupBy("i").agg(F.min("v").alias("v"))
    there = candidates.select(*wanted).where("i is not null and v is not null")
    n_asked, n_there = asked.count(), there.count()
    tiles = written(_packed(asked, query_rows, n_asked), "query-tiles")
    shards = written(_packed(there, tile_rows, n_there).withColumn("shard", F.monotonically_increasing_id()), "candidate-tiles")
    # every query tile meets every candidate tile once: the stated query set against all rows, in blocks
    met = shards.crossJoin(tiles.select(*[F.col(c).alias(f"q_{c}") for c in tiles.columns]))

    def multiply(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                if row.dim != row.q_dim:
                    continue
                q_ids, c_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                q = np.frombuffer(row.q_matrix, row.q_kind).reshape(len(q_ids), row.dim)
                c = np.frombuffer(row.matrix, row.kind).reshape(len(c_ids), row.dim)
                a, b, s = _best(q_ids, q.astype(np.int64), c_ids, c.astype(np.int64), k)
                yield pd.DataFrame({"query_id": a, "node": np.full(len(a), row.shard), "vec_id": b, "score": s})

    lists = met.mapInPandas(multiply, "query_id long, node long, vec_id long, score long")
    best_first = (F.col("score").desc(), F.col("vec_id"))
    # shard numbers are (partition << 33) + position
    lists = lists.withColumn("node", F.shiftright("node", 33))
    nodes = max(1, -(-n_there // tile_rows))
    while nodes > fan_in:
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*best_first))).where(F.col("rank") <= k).drop("rank")
        nodes = -(-nodes // fan_in)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
