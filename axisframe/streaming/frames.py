"""Frames of trajectories as a stream: the first frame of each is kept as state, and later ones are told against it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axisframe.store import fresh_path


def change_from_first(frames: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, order, rmsd) of each frame against its key's first, over a stream or a table.

    ``vector`` is an array of coordinates. A key's first frame is the one of least ``order`` in the batch that first
    brings it; trajectories arrive in order. The state is one frame a key and never expires. Rows that repeat are
    each answered; a null vector has a null result and is never the reference.
    """
    schema = T.StructType([frames.schema[key], frames.schema[order], T.StructField("rmsd", T.DoubleType())])
    held = T.StructType([T.StructField("first", T.ArrayType(T.DoubleType()))])

    def score(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        known = rows[vector].notna()
        if not state.exists:
            if not known.any():
                yield pd.DataFrame({key: rows[key], order: rows[order], "rmsd": [None] * len(rows)})
                return
            state.update(([float(x) for x in rows[vector][known].iloc[0]],))
        first = np.asarray(state.get[0], dtype=float)
        away = [float(np.sqrt(np.mean((np.asarray(v, float) - first) ** 2))) if ok else None for v, ok in zip(rows[vector], known, strict=True)]
        yield pd.DataFrame({key: rows[key], order: rows[order], "rmsd": away})

    return frames.select(key, order, vector).groupBy(key).applyInPandasWithState(score, schema, held, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, kind: str) -> DataFrame:
    """What a bounded stream gives, written to the shared folder with its checkpoint beside it and read back."""
    spark = stream.sparkSession
    path = fresh_path(spark, kind)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
