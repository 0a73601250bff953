"""Column functions on arrays of doubles, and small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its norm; null for the zero vector."""
    n = F.nullif(norm(v), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cross3(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def angle_degrees(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b) of positive numbers, else null."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def permissive_bool(text: Column) -> Column:
    """1, true, yes and y are true, in any case and padding; all else is false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def finite(text: Column) -> Column:
    """The text as a finite double, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def iso_date(text: Column) -> Column:
    """The ISO date that a text starts with, else null."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def edge_key(a: Column, b: Column) -> Column:
    """The two names in order, joined by '--'."""
    return F.concat_ws("--", F.least(a, b), F.greatest(a, b))


def signed_angle_about(rotation: Column, axis: Column) -> Column:
    """Degrees by which a rotation (nine numbers row by row) turns about a unit axis, by the right hand; in (-180, 180]."""
    r, a = [F.get(rotation, i) for i in range(9)], [F.get(axis, i) for i in range(3)]
    skew = a[0] * (r[7] - r[5]) + a[1] * (r[2] - r[6]) + a[2] * (r[3] - r[1])
    along = sum((a[i] * a[j] * r[3 * i + j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.atan2(skew, r[0] + r[4] + r[8] - along))


def _in_order(value: Column, kind: T.DataType) -> Column:
    """The value with its names sorted at every level and its numbers checked."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_in_order(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _in_order(e["value"], kind.valueType))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("JSON has no such number"))).otherwise(value)
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A struct, map or array as JSON with sorted names, no blanks and its nulls; NaN and infinities fail the query."""
    return F.to_json(_in_order(value, kind), {"ignoreNullFields": "false"})


def json_hash(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical JSON, in hex."""
    return F.sha2(canonical_json(value, kind).cast("binary"), 256)
