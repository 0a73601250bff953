"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. A source of weight w has its j-th block released at floor(j / w) and due by
ceil((j + 1) / w), in slots of one block each; the released block that is due first goes next. At no time is a
source a whole block ahead of or behind its weight. Weights are multiples of 1 / frame, so the schedule repeats
every ``frame`` slots: it is worked out for one frame, and each document's place follows from its number alone.

Very many sources are scheduled by classes of about equal weight. The blocks of a class's m sources take its slots in
turn: the class's block j * m + r is block j of its r-th source. With the class's weight w, that block's release and
deadline, floor((j * m + r) / w) and ceil((j * m + r + 1) / w), lie within those of the source's own weight w / m, so
each source is still less than a block from its weight, and the schedule grows with the classes alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.llm.common import free_name, ordinals, written

#: Sources that are scheduled one by one, and classes that more of them are put into: small tables by these bounds.
MOST_SOURCES = 10_000
MOST_CLASSES = 2048
#: Weights of a class differ by less than this factor; those too small for the last class are in it.
CLASS_STEP = 1.02
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def apportioned(weights: list[float], frame: int) -> list[int]:
    """Whole slots of a frame for each weight: one at least, the rest by largest remainder."""
    total = sum(weights)
    exact = [w / total * (frame - len(weights)) for w in weights]
    slots = [1 + int(x) for x in exact]
    by_remainder = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in by_remainder[: frame - sum(slots)]:
        slots[i] += 1
    return slots


def frame_schedule(slots: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block in the frame, slot, release, deadline) of one frame: earliest deadline first."""
    frame = sum(slots)
    due = lambda s, j: -(-(j + 1) * frame // slots[s])
    waiting = [(0, s, 0) for s in range(len(slots))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, slot, release, deadline))
        if j + 1 < slots[s]:
            heapq.heappush(waiting, ((j + 1) * frame // slots[s], s, j + 1))
    return out


def _weighed(counts: DataFrame, name: str, given: dict, temperature: float) -> DataFrame:
    """``counts`` (the source in column ``name``, source_rows) with source_weight."""
    if not given:
        return counts.withColumn("source_weight", F.col("source_rows").cast("double") ** temperature)
    schema = T.StructType([T.StructField("given_source", counts.schema[name].dataType), T.StructField("given_weight", T.DoubleType())])
    table = counts.sparkSession.createDataFrame([(s, float(w)) for s, w in given.items()], schema)
    met = counts.join(table, F.col(name).eqNullSafe(F.col("given_source")), "left")
    return met.select(name, "source_rows", F.coalesce("given_weight", F.lit(float(min(given.values())))).alias("source_weight"))


def _classed(weighed: DataFrame, name: str, at: str, member: str, rows_per_bucket: int) -> DataFrame:
    """Each source's class, by the logarithm of its weight, and its number in the class from 0."""
    most = weighed.agg(F.max("source_weight")).first()[0]
    step = F.floor(F.log(F.lit(most) / F.col("source_weight")) / F.log(F.lit(CLASS_STEP)))
    classed = weighed.withColumn(at, F.least(F.greatest(step, F.lit(0)), F.lit(MOST_CLASSES - 1)).cast("int"))
    classed = classed.withColumn("source_key", F.xxhash64(name))
    return written(ordinals(classed, [at], "source_key", [F.col(name)], rows_per_bucket, member).drop("source_key"), "sources")


def _with_sources(keyed: DataFrame, source: str, sources: DataFrame, name: str, total: int) -> DataFrame:
    """Rows with their source's columns. Sources of over a thousandth of all rows, less than 1,000, go to every task."""
    large, small = (sources.where(c).drop("source_rows") for c in (F.col("source_rows") * 1000 > total, F.col("source_rows") * 1000 <= total))
    same = F.col(source).eqNullSafe(F.col(name))
    rest = keyed.join(F.broadcast(large.select(name)), same, "left_anti").join(small, same)
    return keyed.join(F.broadcast(large), same).unionByName(rest).drop(name)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, temperature: float = 1.0, block_rows: int = 64, frame: int = 1024, seed: int = 41, source: str = "source", doc_id: str = "doc_id", rows_per_bucket: int = 4096) -> DataFrame:
    """Append mix_block, mix_release, mix_deadline, mix_slot and mix_place (longs); order by slot, then place.

    Without ``weights``, a source's weight is its number of rows to the power ``temperature``. A source without a
    given weight takes the least given one. Weights are rounded to multiples of 1 / frame, one at least. Every row
    is placed once: a source that has run out leaves its slots empty, and the others keep their order and their
    proportions to each other. Rows of a source go in an order drawn by hash. A null source is a source of its
    own; null and repeated ids and rows are placed like any other. An empty table gives no rows. The schedule is worked
    out for a frame of at least four slots a source. Of more than ``MOST_SOURCES`` sources, those whose weights differ
    by less than the factor ``CLASS_STEP`` are a class: they share its weight evenly, and release and deadline are
    those of the class's blocks.
    """
    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    given = weights or {}
    if any(not w > 0 for w in given.values()):
        raise ValueError("weights must be positive")
    number, key, tie, at, own, known_as, p_at, p_block, p_slot, p_release, p_deadline, member, members, nth = (free_name(docs, stem=s) for s in ("ordinal", "key", "tie", "source_number", "own_slots", "known_source", "plan_source", "plan_block", "plan_slot", "plan_release", "plan_deadline", "member", "members", "nth_block"))
    sizes = docs.groupBy(F.col(source).alias(known_as)).agg(F.count(F.lit(1)).alias("source_rows"))
    head = {r[0]: r[1] for r in sizes.limit(MOST_SOURCES + 1).collect()}
    single = len(head) <= MOST_SOURCES
    if single:
        total = sum(head.values())
        names = sorted(head, key=lambda s: (s is not None, s))
        chosen = [given.get(s, min(given.values())) if given else head[s] ** temperature for s in names]
    else:
        sources = _classed(_weighed(sizes, known_as, given, temperature), known_as, at, member, rows_per_bucket)
        # a row a class
        classes = sources.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum("source_weight").alias("w"), F.sum("source_rows").alias("r")).orderBy(at).collect()
        total = sum(c["r"] for c in classes)
        names, chosen = [c[at] for c in classes], [c["w"] for c in classes]
    while frame < 4 * len(names):
        frame *= 2
    slots = apportioned(chosen, frame) if names else []
    plan = spark.createDataFrame(frame_schedule(slots) if names else [], T.StructType([T.StructField(c, T.IntegerType()) for c in (p_at, p_block, p_slot, p_release, p_deadline)]))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = docs.withColumns({key: F.xxhash64(F.lit(seed), doc_id), tie: F.xxhash64(F.lit(seed + 1), *hashed)})
    if single:
        table = spark.createDataFrame([(s, i, slots[i]) for i, s in enumerate(names)], T.StructType([T.StructField(known_as, docs.schema[source].dataType), T.StructField(at, T.IntegerType()), T.StructField(own, T.IntegerType())]))
        # both tables are bounded: MOST_SOURCES rows, and a frame of some slots for each of them
        known = keyed.join(F.broadcast(table), F.col(source).eqNullSafe(F.col(known_as))).drop(known_as)
        groups, turn = [at], F.col("mix_block")
    else:
        # plan sources are the classes' places in their list
        table = spark.createDataFrame([(c[at], i, slots[i], c["n"]) for i, c in enumerate(classes)], T.StructType([T.StructField(p_at, T.IntegerType()), T.StructField(known_as, T.IntegerType()), T.StructField(own, T.IntegerType()), T.StructField(members, T.LongType())]))
        ours = F.broadcast(table.withColumnsRenamed({p_at: "class", known_as: "place"}))
        placed = sources.drop("source_weight").join(ours, F.col(at) == F.col("class")).drop("class", at).withColumnRenamed("place", at)
        known = _with_sources(keyed, source, placed, known_as, total)
        groups, turn = [at, member], F.col("mix_block") * F.col(members) + F.col(member)
    numbered = ordinals(known, groups, key, [F.col(tie)], rows_per_bucket, number, total=total)
    numbered = numbered.withColumn("mix_block", F.floor(F.col(number) / block_rows)).withColumn(nth, turn)
    dealt = numbered.join(F.broadcast(plan), (F.col(at) == F.col(p_at)) & (F.col(nth) % F.col(own) == F.col(p_block)))
    base = F.floor(F.col(nth) / F.col(own)) * frame
    return dealt.select(
        *docs.columns,
        "mix_block",
        (base + F.col(p_release)).alias("mix_release"),
        (base + F.col(p_deadline)).alias("mix_deadline"),
        (base + F.col(p_slot)).alias("mix_slot"),
        (F.col(number) % block_rows).alias("mix_place"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows laid out by slot and place, without the schedule's columns; files keep this order."""
    names = [c for c in mixed.columns if c not in ADDED]
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*names)
