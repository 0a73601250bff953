"""Mixing of more sources than are scheduled one by one."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from axisframe.llm import mixing


def _classes(weights):
    """Class of each source by the stated rule, restated in plain Python."""
    most = max(weights.values())
    return {s: min(math.floor(math.log(most / w) / math.log(mixing.CLASS_STEP)), mixing.MOST_CLASSES - 1) for s, w in weights.items()}


@pytest.mark.parametrize("given", [None, {"a": 30.0, "b": 8.0, None: 2.0, "c": 1.0}])
def test_sources_of_a_class_stay_within_a_block(spark, monkeypatch, given):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    rows = {"a": 900, "b": 240, None: 60, "c": 30, "d": 30, "e": 30, "f": 29, "g": 1}
    frame = spark.createDataFrame([(i if i % 5 else None, s, "x") for s, n in rows.items() for i in range(n)], "doc_id long, source string, source_rows string")
    got = mixing.mix(frame, given, block_rows=2, frame=64, rows_per_bucket=64).collect()
    assert len(got) == sum(rows.values()) == len({(r.mix_slot, r.mix_place) for r in got})
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline and r.source_rows == "x" for r in got)
    weights = {s: given.get(s, 1.0) for s in rows} if given else {s: float(n) for s, n in rows.items()}
    classes = _classes(weights)
    order = sorted(set(classes.values()))
    slots = mixing.apportioned([sum(w for s, w in weights.items() if classes[s] == c) for c in order], 64)
    slot_of = defaultdict(dict)
    for r in got:
        assert slot_of[r.source].setdefault(r.mix_block, r.mix_slot) == r.mix_slot
    taken = [x for own in slot_of.values() for x in own.values()]
    assert len(taken) == len(set(taken))
    for s, own in slot_of.items():
        m = sum(c == classes[s] for c in classes.values())
        w = slots[order.index(classes[s])] / 64 / m
        assert sorted(own) == list(range(-(-rows[s] // 2)))
        for j, slot in own.items():
            assert math.floor(j / w + 1e-9) <= slot < math.ceil((j + 1) / w - 1e-9)
        assert sorted((r.mix_block, r.mix_place) for r in got if r.source == s) == [(i // 2, i % 2) for i in range(rows[s])]


def test_twenty_thousand_sources_and_a_hot_one(spark):
    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    got = mixing.mix(frame, block_rows=4).toPandas()
    assert len(got) == 40_000 and not got.duplicated(["mix_slot", "mix_place"]).any()
    hot = got[got["source"] == "hot"]
    assert sorted(4 * hot["mix_block"] + hot["mix_place"]) == list(range(20_000))
    # equal weights of both halves: every second slot is the hot source's, until it has run out
    mine = sorted(hot["mix_slot"].unique())
    assert all(abs(2 * i - slot) <= 2 for i, slot in enumerate(mine))


def test_few_sources_are_placed_as_before(spark, monkeypatch):
    frame = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    one = {tuple(r) for r in mixing.mix(frame, block_rows=8, frame=32).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    two = {tuple(r) for r in mixing.mix(frame, block_rows=8, frame=32).collect()}
    own = lambda rows: {(r[0], r[1], r[2], r[6]) for r in rows}
    assert own(one) == own(two)
