"""What language identification learns from: a full sample of each language, and every letter in it."""

import numpy as np

from axisframe.llm import langid


def _texts(letters, count, size, seed):
    random = np.random.default_rng(seed)
    return ["".join(random.choice([*letters, " "], size)) for _ in range(count)]


def test_long_texts_do_not_shrink_the_sample(spark):
    rows = [("x", t) for t in [*_texts("abcd", 40, 100, 1), *["ab" * 300_000] * 4]]
    rows += [("y", t) for t in _texts("efgh", 3, 5000, 2)] + [("z", "ij" * 20), ("z", "kl" * 9000)]
    frame = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(frame, sample_chars=1024)
    assert model.languages == ["x", "y", "z"]
    assert all(b > 9.8 for b in model.bits)  # log2 of the sample's length, in which a run of spaces is one
    got = {r.text[:1]: r.lang_pred for r in langid.identify(frame.where("length(text) < 6000"), model).collect() if r.text.strip()}
    assert {got.get(c, k) for c, k in (("a", "x"), ("b", "x"))} == {"x"} and {got.get(c, "y") for c in "efgh"} == {"y"} and got["i"] == "z"


def test_every_sampled_letter_counts(spark):
    letters = {"common": [chr(0x430 + i) for i in range(32)] + [chr(0x5D0 + i) for i in range(27)] + [chr(0x10D0 + i) for i in range(33)] + list("abcdefgh")}
    letters |= {"p": [chr(0x4E00 + i) for i in range(200)], "q": [chr(0x4E00 + 200 + i) for i in range(200)], "r": [chr(0x20000 + i) for i in range(150)], "s": [chr(0x20000 + 150 + i) for i in range(150)]}
    rows = [(t, k) for at, (k, own) in enumerate(letters.items()) for t in _texts(own, 200 if k == "common" else 20, 300, at)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(frame.where("doc_id % 5 <> 0"))
    out = langid.identify(frame.where("doc_id % 5 = 0"), model).collect()
    assert {r.lang for r in out} == set(letters) and all(r.lang == r.lang_pred for r in out)


def test_null_and_repeated_ids_bring_no_more_to_the_driver(spark, monkeypatch):
    texts = _texts("abcdefgh", 20_000, 60, 3)
    many = spark.createDataFrame([(None, t, "x") for t in texts] + [(7, texts[0], "y")] * 5000 + [(7, t, "z") for t in texts[:50]], "doc_id long, text string, lang string").repartition(4)
    kept = {}

    def model(texts):
        kept.update(texts)

    monkeypatch.setattr(langid, "Model", model)
    langid.fit(many, sample_chars=2048)
    assert {k: 2048 <= sum(map(len, v)) <= 3200 for k, v in kept.items()} == {"x": True, "y": False, "z": True}
    assert kept["y"] == [texts[0]] and len(set(kept["x"])) == len(kept["x"])
