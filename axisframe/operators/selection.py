"""Top-k, representatives, set operations, division, pivots and packed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(frame: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with ``rank`` from 1."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def top_fraction(frame: DataFrame, keys: list[str], order: list[Column], fraction: float) -> DataFrame:
    """Rows whose rank over their group's size is at most the fraction."""
    w = Window.partitionBy(*keys)
    ranked = frame.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rank") <= F.col("_n") * fraction).drop("_n")


def representatives(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first, quarter, middle, three-quarter and last row of each group, with ``place`` from 0."""
    w = Window.partitionBy(*keys)
    out = frame.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = [F.lit(0), F.floor(F.col("_n") / 4), F.floor(F.col("_n") / 2), F.floor(3 * F.col("_n") / 4), F.col("_n") - 1]
    hit = at[0] == F.col("place")
    for x in at[1:]:
        hit = hit | (x == F.col("place"))
    return out.where(hit).drop("_n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables over the union of their columns, in the order they are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_first(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    return top_k(frame, keys, order, 1).drop("rank")


def divide(frame: DataFrame, item: str, holder: str, share: float = 1.0) -> DataFrame:
    """Items that at least this share of all holders have, with ``n_holders``."""
    total = frame.agg(F.count_distinct(holder).alias("_all"))
    each = frame.groupBy(item).agg(F.count_distinct(holder).alias("n_holders"))
    return each.crossJoin(F.broadcast(total)).where(F.col("n_holders") >= F.col("_all") * share).drop("_all")  # one row


def pivoted(frame: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One row a key, one column a value; absent cells stay null."""
    return frame.groupBy(*keys).pivot(column, values).agg(F.first(value))


def packed(column: Column, pairs: str = ";", between: str = "=") -> Column:
    """'key=value;...' as a map."""
    return F.str_to_map(column, F.lit(pairs), F.lit(between))


def status_matrix(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per packed entry: condition and 1 for pass, -1 for fail, 0 for anything else."""
    long = frame.select(*keys, F.explode(packed(F.col(column))).alias("condition", "status"))
    return long.withColumn("code", F.when(F.col("status") == "pass", 1).when(F.col("status") == "fail", -1).otherwise(0))


def long_panel(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key and named value: record, value."""
    return frame.unpivot(keys, values, "record", "value")


#: Columns of a panel's records.
PANEL = {"panel": "string", "record_type": "string", "series": "string", "identifier": "string", "index": "long", "x": "double", "y": "double", "z": "double", "dx": "double", "dy": "double", "dz": "double", "value": "double", "unit": "string", "notes": "string"}


def panel_records(frame: DataFrame, panel: str, record_type: str, *, each: str | None = None, **given: Column | str) -> DataFrame:
    """One record of the fourteen ``PANEL`` columns per row, or per element of the array column ``each``.

    ``given`` names columns' values, as columns or constant texts; those left out are null. An array's elements are
    the values, and their places from 0 the index; empty and null arrays give no records.
    """
    if unknown := set(given) - set(PANEL):
        raise ValueError(f"no panel columns: {sorted(unknown)}")
    fixed = {"panel": F.lit(panel), "record_type": F.lit(record_type)}
    cells = {n: F.lit(c) if isinstance(c, str) else c for n, c in given.items()}
    if each is not None:
        frame = frame.select(*frame.columns, F.posexplode(each).alias("_index", "_value"))
        cells = {"index": F.col("_index"), "value": F.col("_value"), **cells}
    cells = {**cells, **fixed}
    return frame.select(*[cells.get(n, F.lit(None)).cast(t).alias(n) for n, t in PANEL.items()])
