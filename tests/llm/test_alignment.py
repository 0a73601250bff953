"""Cross-tokenizer alignment against loops over single tokens."""

import hashlib
from collections import Counter

import pytest

from axisframe.llm import alignment, queries

BOTH = queries.aligned_tokenizers()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _tokens(text):
    """Each side's (id, start, end), or None."""
    import tokenizers
    from sentencepiece import SentencePieceProcessor

    if not text:
        return None
    raw, out = b" " + text.encode(), []
    a = tokenizers.Tokenizer.from_file(BOTH[0])
    a.encode_special_tokens = True
    letters = alignment._byte_of_letter()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    spelt = [bytes([letters[c] for c in a.id_to_token(i)]) for i in ids]
    b = SentencePieceProcessor(model_file=BOTH[1])
    more = b.encode(text)
    names = [b.id_to_piece(i) for i in more]
    for found, parts in ((ids, spelt), (more, [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(more, names)])):
        if b"".join(parts) != raw:
            return None
        at, side = 0, []
        for i, p in zip(found, parts):
            side.append((i, at, at + len(p)))
            at += len(p)
        out.append(side)
    return out


def _plain(docs):
    found = [(d, _tokens(t)) for d, t in docs]
    linked, counts = [], Counter()
    for _, both in found:
        pairs = [(x, y) for x in both[0] for y in both[1] if x[1] < y[2] and y[1] < x[2]] if both else []
        linked.append(pairs)
        counts.update((x[0], y[0]) for x, y in pairs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (d, both), pairs in zip(found, linked):
        if not both:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in both[0]} & {e for _, _, e in both[1]})
        texts, low = [], 0
        for cut in cuts:
            texts.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in both))
            low = cut
        n = [counts[x[0], y[0]] for x, y in pairs]
        good = sum(counts[x[0], y[0]] == best[y[0]] for x, y in pairs)
        out.append((d, len(both[0]), len(both[1]), len(cuts), len(pairs), good, sum(n), hashlib.sha256(";".join(texts).encode()).hexdigest()))
    return out


DOCS = [
    (1, "Plain words, and more words: it's 12.5% of 漢字 \U0001f600!"),
    (2, None),
    (3, ""),
    (4, "two  blanks   and\n\n lines \t tabs "),
    (5, " leading and trailing "),
    (6, "<|endoftext|> <s> </s> <unk> <0x41> [CLS]"),
    (7, "a ▁ mark that is not a blank"),
    (8, "Plain words, and more words: it's 12.5% of 漢字 \U0001f600!"),
    (9, "x" * 300 + " internationalisation supercalifragilistic é́   nbsp"),
    (None, "no id"),
    (None, "no id"),
    (None, "another"),
    (10, "same id"),
    (10, "other text of the same id"),
    (11, "repeated row, words and words"),
    (11, "repeated row, words and words"),
    (11, "repeated row, words and words"),
    (12, " "),
    (13, "\n"),
    (14, "naïve straße Ünïcode ﬁ ligature ½ Å"),
]


def _sorted(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: (r[0] is None, str(r)))


def _frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, mark string, part int").repartition(parts)


def test_digest_equals_loops_over_tokens(spark):
    got = alignment.digest(alignment.align(_frame(spark, DOCS), BOTH), BOTH)
    assert got.columns == COLUMNS and _sorted(got.collect()) == _sorted(_plain(DOCS))


def test_pairs_beyond_the_table_join_their_counts(spark):
    packs = alignment.align(_frame(spark, DOCS), BOTH)
    counts = alignment.pair_counts(packs, BOTH, held=5)
    for most in (0, 3, 20):
        assert _sorted(alignment.scores(packs, counts, BOTH, table_pairs=most).collect()) == _sorted(_plain(DOCS))


def test_long_texts_cross_runs_and_packs(spark):
    texts = ["internationalisation of words, " * 9 + "漢字" * 30, "short", "y" * 999]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 2
    packs = alignment.sweep(alignment.token_runs(_frame(spark, rows, 2), BOTH, run_ids=7), BOTH, pack_ids=20)
    assert packs.count() > 2
    assert _sorted(alignment.digest(packs, BOTH).collect()) == _sorted(_plain(rows))


@pytest.mark.parametrize("size", [1, 3, 8])
def test_the_machine_takes_any_runs(size):
    """The sweep's parts in one process: runs of any length close the same groups."""
    import numpy as np

    sides = [alignment._side(p) for p in BOTH]
    text = "internationalisation of words, " * 5 + "漢字 \U0001f600" * 8
    ids = [np.frombuffer(s.ids([text])[0], s.dtype) for s in sides]
    runs = []
    for at, (side, x) in enumerate(zip(sides, ids)):
        ends = np.concatenate(([0], np.cumsum(side.lengths[x])))
        runs += [(int(ends[low]), at, x[low : low + size]) for low in range(0, len(x), size)]
    packs, doc = alignment._Packs(sides), alignment._Document((1, 2, 3))
    for start, at, x in sorted(runs, key=lambda r: r[:2]):
        if start > 0 and (done := doc.closed(sides, False)):
            packs.add(*done)
        doc.take(start, at, x)
    packs.add(*doc.closed(sides, True))
    row = packs.give()
    plain = _plain([(1, text)])[0]
    assert len(row.column("n_a")[0]) > 1
    assert (sum(row.column("n_a")[0].as_py()), sum(row.column("n_b")[0].as_py()), sum(row.column("n_groups")[0].as_py())) == plain[1:4]
    assert row.column("groups_sha256")[0].as_py()[-1] == plain[-1]


def test_links_and_groups(spark):
    packs = alignment.align(_frame(spark, DOCS), BOTH)
    got = {(r.doc_id, r.a_at, r.b_at, r.a, r.b, r["from"], r.upto) for r in alignment.links(packs, BOTH).where("doc_id in (1, 4, 9)").collect()}
    want = set()
    for d in (1, 4, 9):
        a, b = _tokens(dict(DOCS)[d])
        want |= {(d, i, j, x[0], y[0], max(x[1], y[1]), min(x[2], y[2])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
    assert got == want
    for d in (1, 4, 9):
        rows = alignment.groups(packs, BOTH).where(f"doc_id = {d}").orderBy("a_at").collect()
        a, b = _tokens(dict(DOCS)[d])
        assert [i for r in rows for i in r.a] == [x[0] for x in a] and [i for r in rows for i in r.b] == [x[0] for x in b]
        assert [r.a_at for r in rows] == [sum(len(x.a) for x in rows[:i]) for i in range(len(rows))]
        text = ";".join(",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b)) for r in rows)
        assert hashlib.sha256(text.encode()).hexdigest() == _plain([(d, dict(DOCS)[d])])[0][-1]


def test_empty_table(spark):
    assert alignment.digest(alignment.align(_frame(spark, DOCS).where("false"), BOTH), BOTH).count() == 0


def test_fast_ways_equal_the_libraries(spark):
    """Small-table texts, and every settled letter beside letters, digits, blanks and signs."""
    import tokenizers

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    a, b = (alignment.Side(p) for p in BOTH)
    assert a.coder.fast is not None and b.coder.by_words
    for side in (a, b):
        assert side.coder.by_words and side.ids(texts) == [side.coder.whole(t, side.code) for t in texts]
    plain = tokenizers.Tokenizer.from_file(BOTH[0])
    plain.encode_special_tokens = True
    letters = [c for c in map(chr, range(0x9FFF)) if alignment._SETTLED.fullmatch(c)]
    assert len(letters) > 20_000
    texts += ["".join(f"{c}a {c}{c} 1{c} .{c}\n{c} " for c in letters[i : i + 100]) for i in range(0, len(letters), 100)]
    assert all(a.coder.encode([t])[0] == plain.encode(" " + t, add_special_tokens=False).ids for t in texts)
