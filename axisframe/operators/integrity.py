"""Checks of documents, decisions, paths and rigid placements."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _leaves(value, path: str = "$"):
    if isinstance(value, dict):
        yield path, "object", str(len(value))
        for k in sorted(value):
            yield from _leaves(value[k], f"{path}.{k}")
    elif isinstance(value, list):
        yield path, "array", str(len(value))
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        yield path, kind, json.dumps(value)


def json_leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value): every node of each JSON document; objects and arrays have their size as value."""

    def run(batches):
        for pdf in batches:
            rows = [(k, *leaf) for k, t in zip(pdf[key], pdf[text], strict=True) if t is not None for leaf in _leaves(json.loads(t))]
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "value"])

    return documents.select(key, text).mapInPandas(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, path string, kind string, value string")


def tree_differences(left: DataFrame, right: DataFrame, key: str, text: str, tolerance: float = 1e-10) -> DataFrame:
    """(key, path, left, right, fault) of nodes that differ: ``missing``, ``unexpected``, ``kind``, ``size`` or ``value``."""
    a = json_leaves(left, key, text).withColumnsRenamed({"kind": "kind_l", "value": "left"})
    b = json_leaves(right, key, text).withColumnsRenamed({"kind": "kind_r", "value": "right"})
    met = a.join(b, [key, "path"], "full")
    far = F.abs(F.col("left").try_cast("double") - F.col("right").try_cast("double")) > tolerance
    differs = F.when(F.col("kind_l") == "number", far).otherwise(F.col("left") != F.col("right"))
    fault = F.when(F.col("kind_r").isNull(), "missing").when(F.col("kind_l").isNull(), "unexpected").when(F.col("kind_l") != F.col("kind_r"), "kind").when(differs, F.when(F.col("kind_l").isin("object", "array"), "size").otherwise("value"))
    return met.select(key, "path", "left", "right", fault.alias("fault")).where("fault is not null")


def path_faults(frames: DataFrame, key: str, frame: str, least: int, flags: list[str]) -> DataFrame:
    """(key, fault): paths whose frames don't run on from the first without a gap, are too few, or raise a flag."""
    w = Window.partitionBy(key).orderBy(frame)
    step = F.col(frame) - F.lag(frame).over(w)
    raised = [F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f"_f_{f}") for f in flags]
    per = frames.withColumn("_step", step).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_step") != 1).alias("_gaps"), *raised)
    fault = F.when(F.col("_gaps") > 0, "gap or repeat").when(F.col("_n") < least, "short")
    for f in flags:
        fault = fault.when(F.col(f"_f_{f}") > 0, f)
    return per.select(key, fault.alias("fault")).where("fault is not null")


def fit_decision(angle: Column, spread: Column, supported: Column, *, most_angle: float = 10.0, most_spread: float = 0.1) -> Column:
    """``stable``, or the first reason why a fit is not: orientation, coordinate, density, or not assessed (a null)."""
    return (
        F.when(angle.isNull() | spread.isNull() | supported.isNull(), "not assessed")
        .when(angle > most_angle, "orientation varies")
        .when(spread > most_spread, "coordinate varies")
        .when(~supported, "density does not support it")
        .otherwise("stable")
    )


def fit_tables(documents: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of nested fit summaries: (state, n_fits), (state, fit, score, coordinate), (state, fit, residue, value)."""
    schema = "state string, fits array<struct<fit:string,score:double,coordinate:double,residues:map<string,double>>>"
    one = documents.select(F.from_json(text, schema).alias("d")).select("d.*")
    fits = one.select("state", F.explode("fits").alias("f")).select("state", "f.*")
    return one.select("state", F.size("fits").alias("n_fits")), fits.select("state", "fit", "score", "coordinate"), fits.select("state", "fit", F.explode("residues").alias("residue", "value"))


def placement_audit(frame: DataFrame, state: str, rotation: str, coordinate: str, expected: int, *, most_angle: float = 10.0, most_spread: float = 0.1) -> DataFrame:
    """(state, n, worst_angle, spread, verdict) over the rotations (nine numbers, by rows) of each state's placements.

    A rotation must be proper and orthogonal to 1e-6. Placements are few a state; the angle is the largest of any two.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.stack([np.asarray(v, float).reshape(3, 3) for v in pdf[rotation]])
        proper = np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3), atol=1e-6) and np.allclose(np.linalg.det(r), 1, atol=1e-6)
        angle = float(np.degrees(np.arccos(np.clip((np.einsum("aij,bij->ab", r, r) - 1) / 2, -1, 1))).max())
        spread = float(pdf[coordinate].max() - pdf[coordinate].min())
        verdict = "improper rotation" if not proper else "wrong count" if len(pdf) != expected else "orientation varies" if angle > most_angle else "coordinate varies" if spread > most_spread else "pass"
        return pd.DataFrame({state: [pdf[state].iloc[0]], "n": [len(pdf)], "worst_angle": [angle], "spread": [spread], "verdict": [verdict]})

    return frame.groupBy(state).applyInPandas(run, f"`{state}` {frame.schema[state].dataType.simpleString()}, n int, worst_angle double, spread double, verdict string")


def matching_stretches(pairs: DataFrame, key: str, first: str, second: str, *, least: int = 4) -> DataFrame:
    """(key, start, other_start, length): every stretch of at least ``least`` letters that two sequences share and that is not part of a longer one.

    Sequences meet in a join on their words of ``least`` letters; words that follow one another on one diagonal are one
    stretch. Starts count from 1. Null and shorter sequences have none; keys are distinct.
    """
    word = lambda c, name, at: pairs.select(F.col(key).alias("k"), F.posexplode(F.transform(F.when(F.length(c) >= least, F.sequence(F.lit(1), F.length(c) - (least - 1))), lambda i: F.substr(F.col(c), i, F.lit(least)))).alias(at, name))
    met = word(first, "w", "i").join(word(second, "w", "j"), ["k", "w"]).select("k", "i", (F.col("j") - F.col("i")).alias("diagonal"))
    along = Window.partitionBy("k", "diagonal").orderBy("i")
    run = met.withColumn("run", F.col("i") - F.row_number().over(along))
    found = run.groupBy("k", "diagonal", "run").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    return found.select(F.col("k").alias(key), (F.col("i") + 1).cast("int").alias("start"), (F.col("i") + F.col("diagonal") + 1).cast("int").alias("other_start"), (F.col("n") + (least - 1)).cast("int").alias("length"))


def _in_order(stretches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """The longest stretch (ties to the first), then the longest before it in both sequences and after it, and so on."""
    found, todo = [], [(stretches, 0, 1 << 31, 0, 1 << 31)]
    while todo:
        some, low, high, other_low, other_high = todo.pop()
        inside = []
        for i, j, n in some:
            cut = max(0, low - i, other_low - j)
            size = min(i + n, high) - i - cut
            size = min(size, min(j + n, other_high) - j - cut)
            if size >= least:
                inside.append((i + cut, j + cut, size))
        if inside:
            i, j, n = min(inside, key=lambda s: (-s[2], s[0], s[1]))
            found.append((i, j, n))
            todo += [(inside, low, i, other_low, j), (inside, i + n, high, j + n, other_high)]
    return sorted(found)


def sequence_blocks(pairs: DataFrame, key: str, first: str, second: str, *, least: int = 4, anchor: int = 50) -> DataFrame:
    """(key, start, other_start, length): the matching stretches that follow one another in both sequences, if one is ``anchor`` long.

    Of all ``matching_stretches`` the longest stands, then the longest of what lies before it on both sides and of what
    lies after it, and so on. Starts count from 1; short chance matches alone map nothing.
    """
    stretches = matching_stretches(pairs, key, first, second, least=least)
    anchored = stretches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "other_start", "length"))).alias("all"), F.max("length").alias("longest")).where(F.col("longest") >= anchor)

    @F.pandas_udf("array<struct<start:int,other_start:int,length:int>>")
    def chosen(batch: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "other_start", "length"), s, strict=True)) for s in _in_order([(int(x["start"]), int(x["other_start"]), int(x["length"])) for x in rows], least)] for rows in batch])

    return anchored.select(key, F.inline(chosen("all")))


def two_grain(coarse: DataFrame, fine: DataFrame, pair: list[str], distance: str, limit: float) -> DataFrame:
    """Coarse pairs with ``least_fine``, the smallest fine distance of the same pair, and ``touching`` (at most ``limit``)."""
    least = fine.groupBy(*pair).agg(F.min(distance).alias("least_fine"))
    return coarse.join(least, pair, "left").withColumn("touching", F.coalesce(F.col("least_fine") <= limit, F.lit(False)))


def recomputed_differences(found: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that one of two plans for the same result has more often than the other, with ``only_in``."""
    return found.exceptAll(again).withColumn("only_in", F.lit("first")).unionByName(again.exceptAll(found).withColumn("only_in", F.lit("second")))


def new_since(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys a frozen snapshot has not: to be scored in its frame, never to refit it."""
    return current.join(snapshot.select(*keys).distinct(), keys, "left_anti")
