"""Row rules: eligibility with reasons, classes, bands, flags and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_reasons(frame: DataFrame, rules: dict[str, Column], flag: str = "eligible", reasons: str = "reasons") -> DataFrame:
    """``flag`` is true if every rule holds; ``reasons`` names those that fail or are null, joined by '; '."""
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    named = F.array_compact(F.array(*failed))
    return frame.withColumn(reasons, F.concat_ws("; ", named)).withColumn(flag, F.size(named) == 0)


def variants(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule and row that the rule keeps, with ``variant``."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return frame.withColumn("variant", F.explode(names))


def three_state(value: Column, low: float, high: float, names: tuple[str, str, str] = ("closed", "intermediate", "open")) -> Column:
    """First name up to ``low``, last from ``high`` on, else the middle one; null stays null."""
    return F.when(value <= low, names[0]).when(value >= high, names[2]).when(value.isNotNull(), names[1])


def adjudicate(frame: DataFrame, value: str, state: str, group: list[str], margin: float, first="closed", second="open") -> DataFrame:
    """``verdict`` of each value against its group's bands of the two states, widened by ``margin``, with ``why``."""
    bands = frame.groupBy(*group).agg(*[f(F.when(F.col(state) == s, F.col(value))).alias(n) for f, s, n in ((F.min, first, "_lo1"), (F.max, first, "_hi1"), (F.min, second, "_lo2"), (F.max, second, "_hi2"))])
    in1 = F.col(value).between(F.col("_lo1") - margin, F.col("_hi1") + margin)
    in2 = F.col(value).between(F.col("_lo2") - margin, F.col("_hi2") + margin)
    known = F.col("_lo1").isNotNull() & F.col("_lo2").isNotNull() & F.col(value).isNotNull()
    verdict = F.when(~known, "indeterminate").when(in1 & in2, "indeterminate").when(in1, first).when(in2, second).otherwise("intermediate")
    why = F.when(~known, "a band is missing").when(in1 & in2, "in both bands").when(in1 | in2, "in one band").otherwise("outside both bands")
    return frame.join(bands, group).withColumn("verdict", verdict).withColumn("why", why).drop("_lo1", "_hi1", "_lo2", "_hi2")


def bucket(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound that the value is under, else ``last``."""
    out = None
    for bound, name in bounds:
        out = F.when(value < bound, name) if out is None else out.when(value < bound, name)
    return out.when(value.isNotNull(), last)


def window_flag(members: Column, window: Column) -> Column:
    """inside, outside, mixed, or not_applicable for no members."""
    inside = F.size(F.array_intersect(members, window))
    distinct = F.size(F.array_distinct(members))
    return F.when(members.isNull() | (F.size(members) == 0), "not_applicable").when(inside == distinct, "inside").when(inside == 0, "outside").otherwise("mixed")


def preferred(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in an order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def resolve_altloc(atoms: DataFrame, keys: list[str], occupancy: str = "occupancy", altloc: str = "altloc", serial: str = "serial") -> DataFrame:
    """The highest occupancy of each atom; ties go to location A, then to the first record."""
    return preferred(atoms, keys, [F.col(occupancy).desc_nulls_last(), F.coalesce((F.col(altloc) == "A").cast("int"), F.lit(0)).desc(), F.col(serial)])


def flags(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order, joined by ';'."""
    return F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))


def class_of_largest(frame: DataFrame, keys: list[str], size: str, excluded: DataFrame, on: str, limit: float, names: tuple[str, str, str]) -> DataFrame:
    """Largest ``size`` per key after dropping excluded members: none left, above the limit, or up to it."""
    kept = frame.join(excluded.select(on).distinct(), on, "left_anti").groupBy(*keys).agg(F.max(size).alias("largest"))
    every = frame.select(*keys).distinct().join(kept, keys, "left").withColumn("largest", F.coalesce("largest", F.lit(0.0)))
    return every.withColumn("size_class", F.when(F.col("largest") == 0, names[0]).when(F.col("largest") > limit, names[1]).otherwise(names[2]))


def validated(value: Column, pattern: str, name: str) -> Column:
    """The value where it matches the whole pattern; anything else fails the query."""
    return F.when(value.rlike(f"^(?:{pattern})$"), value).otherwise(F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(value, F.lit("null")))))


def role(path: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """The role of the first pattern found in a path."""
    out = None
    for pattern, name in patterns:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise(other)


def curated(residues: DataFrame, structures: DataFrame, window: list[int], rules: list[dict], *, slack: int = 5) -> DataFrame:
    """(variant, structure, chain): the structures that each curation rule keeps, with the chain it takes them by.

    ``residues`` has (structure, chain, position), ``structures`` (structure, resolution, primary). A rule is a dict with
    ``name`` and, where it differs from the default, ``coverage`` (1.0: the share of the window that must be resolved),
    ``terminal`` (False: instead of a share, any gaps within ``slack`` positions of the window's ends), ``ceiling``
    (None: the largest resolution; null resolutions pass only without one), ``chain`` (``primary``, or ``best``: the
    one that resolves most of the window, ties to the first) and ``drop`` (positions that the rule's window leaves out).
    """
    inside = residues.where(F.col("position").isin([int(p) for p in window])).groupBy("structure", "chain").agg(F.collect_set("position").alias("seen"))
    met = structures.join(inside, "structure")
    out = None
    for rule in rules:
        own = [p for p in window if p not in set(rule.get("drop", ()))]
        places = F.array(*[F.lit(int(p)) for p in own])
        seen = F.array_intersect(places, "seen")
        gaps = F.array_except(places, F.col("seen"))
        if rule.get("terminal"):
            ends = F.array(*[F.lit(int(p)) for p in [*own[:slack], *own[-slack:]]])
            whole = F.size(F.array_except(gaps, ends)) == 0
        else:
            whole = F.size(seen) >= rule.get("coverage", 1.0) * len(own) - 1e-9
        good = whole if rule.get("ceiling") is None else whole & F.coalesce(F.col("resolution") <= rule["ceiling"], F.lit(False))
        if rule.get("chain") == "best":
            most = F.size(F.array_intersect(F.array(*[F.lit(int(p)) for p in window]), "seen"))
            rows = met.withColumn("_n", F.row_number().over(Window.partitionBy("structure").orderBy(most.desc(), "chain"))).where("_n = 1")
        else:
            rows = met.where("chain = primary")
        one = rows.where(good).select(F.lit(rule["name"]).alias("variant"), "structure", "chain")
        out = one if out is None else out.unionByName(one)
    return out


def common_positions(kept: DataFrame, residues: DataFrame, rules: list[dict]) -> DataFrame:
    """(variant, n_structures, n_positions): how many positions every structure that a rule keeps resolves.

    Positions that the rule drops don't count. A rule that keeps nothing has no row.
    """
    dropped = [(r["name"], int(p)) for r in rules for p in r.get("drop", ())]
    gone = kept.sparkSession.createDataFrame(dropped, "variant string, position int")
    sizes = kept.groupBy("variant").agg(F.count(F.lit(1)).alias("n_structures"))
    seen = kept.join(residues.select("structure", "chain", "position").distinct(), ["structure", "chain"]).join(gone, ["variant", "position"], "left_anti")
    full = seen.groupBy("variant", "position").agg(F.count(F.lit(1)).alias("k")).join(sizes, "variant").where("k = n_structures").groupBy("variant").agg(F.count(F.lit(1)).alias("n_positions"))
    return sizes.join(full, "variant", "left").select("variant", "n_structures", F.coalesce("n_positions", F.lit(0)).alias("n_positions"))


def fragment_filter(frame: DataFrame, structure: str, entity: str, length: str, least: int) -> DataFrame:
    """(structure, n_entities, n_fragments, shortest, kept): entities shorter than ``least`` are fragments.

    A structure is kept if an entity is left. Entities count once, by their greatest length; a null length is 0.
    """
    each = frame.groupBy(structure, entity).agg(F.max(F.coalesce(F.col(length), F.lit(0))).alias("_length"))
    short = F.col("_length") < least
    sums = each.groupBy(structure).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(short).alias("n_fragments"), F.min("_length").alias("shortest"))
    return sums.withColumn("kept", F.col("n_fragments") < F.col("n_entities"))


def gap_bands(reference: DataFrame, keys: list[str], value: str, first_gaps: int = 15) -> DataFrame:
    """(keys, n_closed, closed_min, closed_max, closed_mean, closed_sd, n_open, open_min, open_max): each group's two bands.

    From the largest value down, the widest of the first gaps parts open from closed; of equal gaps the first does.
    ``closed_sd`` is by n. Null values don't count, and groups with fewer than two values have no row.
    """
    rows = reference.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    down = Window.partitionBy(*keys).orderBy(F.col("_v").desc())
    top = rows.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= first_gaps + 1)
    top = top.withColumn("_next", F.lead("_v").over(Window.partitionBy(*keys).orderBy("_n"))).where("_next is not null")
    cut = top.groupBy(*keys).agg(F.max_by((F.col("_v") + F.col("_next")) / 2, F.struct(F.col("_v") - F.col("_next"), -F.col("_n"))).alias("_cut"))
    cut = cut.select(*[F.col(k).alias(f"_by_{k}") for k in keys], "_cut")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    low, high = F.when(F.col("_v") < F.col("_cut"), F.col("_v")), F.when(F.col("_v") >= F.col("_cut"), F.col("_v"))
    found = [F.count(low).alias("n_closed"), F.min(low).alias("closed_min"), F.max(low).alias("closed_max"), F.avg(low).alias("closed_mean"), F.stddev_pop(low).alias("closed_sd")]
    return rows.join(cut, same).groupBy(*keys).agg(*found, F.count(high).alias("n_open"), F.min(high).alias("open_min"), F.max(high).alias("open_max"))


def band_calls(frame: DataFrame, bands: DataFrame, keys: list[str], value: str, *, present: Column, margin: float = 1.0, nearest: str | None = None, unit: str = "A") -> DataFrame:
    """Append ``z``, ``verdict`` and ``reason``: each value against its group's bands as ``gap_bands`` gives them.

    Up to ``margin`` beyond the closed band is closed, from as much below the open one on is open, and between them
    intermediate; closed goes first. Without a coordinate (``present`` false or null), a value or a band it is
    indeterminate. The reason has the numbers; ``nearest`` is a column that it quotes.
    """
    theirs = bands.select(*[F.col(k).alias(f"_by_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("closed_min", "closed_max", "closed_mean", "closed_sd", "open_min", "open_max")])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    v, there = F.col(value).cast("double"), F.coalesce(present, F.lit(False))
    known = there & v.isNotNull() & F.col("_open_min").isNotNull()
    z = F.when(known & (F.col("_closed_sd") > 0), (v - F.col("_closed_mean")) / F.col("_closed_sd"))
    verdict = F.when(~known, "indeterminate").when(v <= F.col("_closed_max") + margin, "closed").when(v >= F.col("_open_min") - margin, "open").otherwise("intermediate")
    number = lambda c: F.format_string("%.2f", c)
    in_band = lambda name, a, b: F.concat(number(v), F.lit(f" {unit} is in the {name} band "), number(F.col(a)), F.lit(" to "), number(F.col(b)), F.lit(", z "), F.when(F.col("z").isNull(), "n/a").otherwise(F.format_string("%+.1f", F.col("z"))))
    quoted = F.lit("") if nearest is None else F.concat(F.lit("; nearest approach "), F.when(F.col(nearest).isNull(), "n/a").otherwise(number(F.col(nearest).cast("double"))))
    reason = (
        F.when(~there, "the coordinate does not exist for this entry")
        .when(F.col("verdict") == "indeterminate", "too few positions or reference values")
        .when(F.col("verdict") == "closed", F.concat(in_band("closed", "_closed_min", "_closed_max"), quoted))
        .when(F.col("verdict") == "open", F.concat(in_band("open", "_open_min", "_open_max"), quoted))
        .otherwise(F.concat(number(v), F.lit(f" {unit} is between the closed band's end "), number(F.col("_closed_max")), F.lit(" and the open band's start "), number(F.col("_open_min"))))
    )
    met = frame.join(theirs, same, "left")
    return met.withColumn("z", z).withColumn("verdict", verdict).withColumn("reason", reason).select(*frame.columns, "z", "verdict", "reason")
