"""Collocations against loops over whole word lists."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from axisframe.llm import collocations


def _plain(docs, most=3, least=10, covered=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", small):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *words), a in found.items():
        k = len(words)
        inside = lambda long: any(long[i : i + k] == tuple(words) for i in range(len(long) - k + 1))  # noqa: B023, E731
        if any(g[0] == lang and len(g) > k + 1 and 100 * b >= covered * a and inside(g[1:]) for g, b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:j]] * f[lang, *words[j:]]), j) for j in range(1, k)]
        score, j = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, *words[:j]], f[lang, *words[j:]], n[lang], score))
    return sorted(out)


def _docs(seed, count=60):
    r = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "漢字", "x\x1cy", "a b", "I", "I"]
    phrases = ["new York city", "of the", "of the city", "state of the art", "i i i i"]
    out = []
    for _ in range(count):
        text = "".join(r.choice([r.choice(words), r.choice(phrases)]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b!"]) for _ in range(r.randint(0, 60)))
        out.append((r.choice(["en", "en", "fr", None, "und"]), text))
    return [*out, ("en", None), ("en", ""), (None, "..,"), ("de", "only here"), *[("it", "uno due tre quattro")] * 12]


def _frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, l, t, 1, "z") for i, (l, t) in enumerate(docs)], "doc_id long, lang string, text string, n int, chunk string").repartition(parts)


COLUMNS = ["lang", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("seed,most,size,segment", [(1, 3, 1 << 21, 1 << 22), (2, 3, 50, 1 << 22), (3, 3, 7, 5), (4, 4, 20, 11), (5, 2, 9, 3)])
def test_rows_equal_loops(spark, seed, most, size, segment):
    """Also where texts go over many chunks, and with longer and shorter phrases."""
    docs = _docs(seed)
    got = collocations.collocations(_frame(spark, docs), max_words=most, min_count=4, chunk_words=size, segment_bytes=segment)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == _plain(docs, most, 4)


def test_covered_phrases_go(spark):
    docs = [("en", "alpha beta gamma")] * 10 + [("en", "alpha beta")] * 10 + [("en", "beta gamma")] * 11
    got = {r.phrase: r.a for r in collocations.collocations(_frame(spark, docs)).collect()}
    assert got == {"alpha beta gamma": 10, "beta gamma": 21}


def test_ranks_and_ties(spark):
    rows = [("en", f"p{i:02}", 10 + i % 3, 1, 1, 5, i // 6) for i in range(30)] + [("fr", "é", 1, 1, 1, 1, 1), ("fr", "z", 1, 1, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = [tuple(r) for r in collocations.ranked(frame, 7).select("lang", "rank", "phrase").collect()]
    want = []
    for lang in ("en", "fr"):
        order = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        want += [(lang, i + 1, r[1]) for i, r in enumerate(order[:7])]
    assert sorted(got) == sorted(want)


def test_large_numbers_are_exact(spark):
    """The score's products pass 64 bits."""
    a, l, r = 3_000_000_007, 3_000_000_019, 9_000_000_011
    number = "cast({} as decimal(38, 0))"
    got = spark.sql(f"select {number.format(1000000)} * ({number.format(a)} * {number.format(a)}) div ({number.format(l)} * {number.format(r)}) as x").first().x
    assert got == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    assert collocations.ranked(collocations.collocations(_frame(spark, _docs(1)).where("false"))).count() == 0


def test_order_of_shuffled_names_does_not_matter():
    """A chunk's names come in any order; phrases of three words are counted by the numbers of the round before."""
    words = [1, 2, 3, 1, 2, 3, 0, 4, 2, 3, 1, 2]
    codes = zstandard.ZstdCompressor().compress(np.array(words, np.int32).tobytes())
    text = pa.table({"chunk": [5], "context": pa.array([0], pa.int32()), "codes": [codes]})
    names = [(1, i, 100 + i) for i in (1, 2, 3, 4)] + [(2, i, 200 + i) for i in range(4)]  # pairs (1,2) (2,3) (3,1) (4,2)
    wanted = {(200, 201): 2, (201, 202): 2, (202, 200): 2, (203, 201): 1}
    for seed in range(6):
        mixed = random.Random(seed).sample(names, len(names))
        right = pa.table({"level": pa.array([r[0] for r in mixed], pa.int32()), "inside": pa.array([r[1] for r in mixed], pa.int32()), "id": [r[2] for r in mixed]})
        got = collocations._neighbours(3)(text, right).to_pylist()
        assert {(r["left"], r["right"]): r["n"] for r in got} == wanted
