"""Fail-closed checks. Each returns the frame unchanged or raises ``GateError`` naming the fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table broke its contract."""


def _shown(faults: DataFrame, most: int = 5) -> str:
    return "; ".join(str(tuple(r)) for r in faults.limit(most).collect())


def require_columns(frame: DataFrame, columns: list[str], finite: list[str] = ()) -> DataFrame:
    """All columns are there, and those of ``finite`` hold no null and no NaN."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")
    if finite:
        bad = frame.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in finite]).first()
        if any(bad):
            raise GateError(f"not finite: {[c for c in finite if bad[c]]}")
    return frame


def require_rows(frame: DataFrame) -> DataFrame:
    """At least one row."""
    if frame.isEmpty():
        raise GateError("no rows")
    return frame


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are blank or occur more than once, with ``n_rows``."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | blank)


def require_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """No blank and no repeated key."""
    faults = duplicate_keys(frame, keys)
    if not faults.isEmpty():
        raise GateError(f"blank or repeated {keys}: {_shown(faults)}")
    return frame


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks, with ``missing_from`` (left or right)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_from", F.lit("right")).unionByName(b.join(a, keys, "left_anti").withColumn("missing_from", F.lit("left")))


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides have the same keys; the left side comes back."""
    faults = key_differences(left, right, keys)
    if not faults.isEmpty():
        raise GateError(f"unmatched {keys}: {_shown(faults)}")
    return left


def completeness(actual: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Cells of the product of the axes that are missing, repeated or unexpected, with ``fault``."""
    expected = axes[0]
    for axis in axes[1:]:  # axes are small lists of conditions
        expected = expected.crossJoin(axis)
    keys = expected.columns
    counted = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    marked = expected.withColumn("due", F.lit(True)).join(counted, keys, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return marked.select(*keys, fault.alias("fault")).where("fault is not null")


def require_complete(actual: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """Every cell of the product occurs once and no other does."""
    faults = completeness(actual, axes)
    if not faults.isEmpty():
        raise GateError(f"incomplete: {_shown(faults)}")
    return actual


def require_derived(frame: DataFrame, stored: str, derived: Column, tolerance: float = 1e-9) -> DataFrame:
    """A stored column equals its derivation within a tolerance."""
    wrong = frame.where(F.coalesce(F.abs(F.col(stored) - derived) > tolerance, F.col(stored).isNull() != derived.isNull()))
    if not wrong.isEmpty():
        raise GateError(f"{stored} differs from its derivation: {_shown(wrong)}")
    return frame


def table_differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """One row per differing cell: keys, column, left and right as text. A null never equals a number."""
    if left.columns != right.columns:
        raise GateError("columns differ")
    values = [c for c in left.columns if c not in keys]
    numeric = {f.name for f in left.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    a = left.select(*keys, F.lit(True).alias("_in_left"), *[F.col(c).alias(f"_l_{c}") for c in values])
    b = right.select(*keys, F.lit(True).alias("_in_right"), *[F.col(c).alias(f"_r_{c}") for c in values])

    def differs(c: str) -> Column:
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        if c in numeric:
            return F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(F.abs(x.cast("double") - y.cast("double")) > tolerance)
        return ~x.eqNullSafe(y)

    cells = [F.when(differs(c) | F.col("_in_left").isNull() | F.col("_in_right").isNull(), F.struct(F.lit(c).alias("column"), F.col(f"_l_{c}").cast("string").alias("left"), F.col(f"_r_{c}").cast("string").alias("right"))) for c in values]
    return a.join(b, keys, "full").select(*keys, F.inline(F.array_compact(F.array(*cells))))
