"""The pipeline's stages on their own inputs, against plain restatements."""

import re
from collections import Counter

import corpus_pipeline
from axisframe.llm import resample
from axisframe.llm.common import written
from axisframe.llm.queries import tokenizer_path

from plain import windows

SF = "/root/testdata/sf0.001"


def _shingles(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_each_stage_on_all_that_came_before(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    quality, dedup, clean, mix, ids = stages.values()

    kept = written(quality(spark, docs, SF), "test-stage")
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in resample.resample(docs, labels).collect())
    assert set(kept.collect()) <= set(given)

    before = kept.collect()
    sets = {r.doc_id: _shingles(r.text) for r in before}
    linked = {i: [j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    least = {i: i for i in sets}
    while True:  # the least id spreads over links until none changes
        new = {i: min(least[j] for j in linked[i]) for i in sets}
        if new == least:
            break
        least = new
    single = written(dedup(spark, kept, SF), "test-stage")
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(set(least.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, *_, hit in windows([(r.doc_id, r.text) for r in single.collect()], items) if hit}
    untouched = written(clean(spark, single, SF), "test-stage")
    assert sorted(r.doc_id for r in untouched.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in bad)

    mixed = written(mix(spark, untouched, SF), "test-stage")
    assert mixed.columns == docs.columns and Counter(mixed.collect()) == Counter(untouched.collect())

    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = ids(spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    start = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start and list(r.ids) == [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        start += r.n_tokens


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, "other " + text[::-1], "en", None), (None, None, None, None), (None, "", "de", "a"), (2, text + " more", "en", "b"), (3, " \t ", "en", "b"), (4, "x" * 200_000, "en", "a"), (None, text, None, "b"), (5, "one two", "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "z", "z", "z") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string, mix_key string, r string")
    quality, dedup, clean, mix, ids = (f for _, f in corpus_pipeline.STAGES)
    for stage in (quality, dedup, clean, mix):
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    single = [(r.doc_id, r.text) for r in dedup(spark, docs, SF).collect()]
    assert Counter(single) == Counter([(1, text), (1, "other " + text[::-1]), (3, " \t "), (4, "x" * 200_000), (5, "one two")])
    assert clean(spark, docs, SF).count() == len(rows)
    assert Counter((r.doc_id, r.text) for r in mix(spark, docs, SF).collect()) == Counter((r[0], r[1]) for r in rows)
    assert ids(spark, docs, SF).count() == len(rows) and ids(spark, docs.limit(0), SF).count() == 0


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "part", "start", "n_tokens", "ids"] and out.count() > 0
