"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

import corpus_pipeline
from axisframe.llm import nearcopies, simhash
from axisframe.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


def _shingles(text):
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept(rows):
    """(doc_id, text) of the least row of each group, ids distinct."""
    sets = [_shingles(t) for _, t in rows]
    least = list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0] for a in sets]
    while True:
        new = [min(least[j] for j in near[i]) for i in range(len(rows))]
        if new == least:
            return [rows[i] for i in sorted(set(least))]
        least = new


def test_near_dedup_stage_against_brute_force_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _kept(sorted((r.doc_id, r.text) for r in docs.collect()))
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want


def test_near_dedup_stage_at_the_threshold_and_beyond_three_bits(spark):
    random = np.random.default_rng(3)
    line = "this very common line is in most of the texts of this table and means nothing"
    rows = []
    for group in range(12):
        base = [f"w{x}" for x in random.integers(0, 5000, 60)]
        for copy in range(6):
            words = list(base)
            for at in random.integers(0, 60, copy % 4):
                words[at] = f"changed{group}x{copy}"
            rows.append((len(rows), " ".join(words[: 60 - 3 * (copy % 3)]) + (" " + line if copy % 2 else "")))
    rows += [(100, "four words are here"), (101, "Four  WORDS are\there"), (102, ""), (103, " \n"), (104, line), (105, line + " so"), (106, "é " * 9)]
    pairs = [(a, b) for a in rows for b in rows if a < b and _shingles(a[1]) and 5 * len(_shingles(a[1]) & _shingles(b[1])) >= 4 * len(_shingles(a[1]) | _shingles(b[1]))]
    assert any(bin(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).count("1") > 3 for a, b in pairs)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, frame, SF).collect())) == _kept(rows)


def test_near_dedup_stage_loses_no_short_text(spark):
    """Texts of 5 to 12 words and the same with a word more or less: similarity 0.8 exactly, or just beside it."""
    random = np.random.default_rng(17)
    rows = []
    for pair in range(400):
        words = [f"w{pair}x{x}" for x in random.integers(0, 9999, 5 + pair % 8)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "more"] if pair % 3 else words[:-1]))]
    sets = [_shingles(t) for _, t in rows]
    exact = sum(5 * len(a & b) == 4 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert exact > 40
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, frame, SF).collect())) == _kept(rows)


def test_near_dedup_stage_tells_rows_apart_by_text(spark):
    one, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "xy")
    rows = [(1, one), (1, other), (1, other), (None, "alone without an id"), (None, one), (None, "alone also, of other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[3], rows[5]], key=str)  # the null id's copy of row 0 goes
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), SF).count() == 0


def test_sketches_lose_no_pair_and_spare_whole_sets():
    random = np.random.default_rng(11)
    for n in (1, 3, 40, 65, 300, 1025, 9000):
        x = np.unique(random.integers(0, 2**63, n).astype(np.uint64))
        for apart in (0, n // 9, n // 5, n):
            y = np.unique(np.concatenate((x[apart:], random.integers(0, 2**63, random.integers(0, apart + 1)).astype(np.uint64))))
            truly = len(np.setxor1d(x, y))
            least = nearcopies.least_difference(nearcopies.sketch(x), nearcopies.sketch(y))
            assert least == nearcopies.least_difference(nearcopies.sketch(y), nearcopies.sketch(x)) <= truly
            assert truly > 0 or least == 0
        other = np.unique(random.integers(0, 2**63, n).astype(np.uint64))
        assert n < 40 or 9 * nearcopies.least_difference(nearcopies.sketch(x), nearcopies.sketch(other)) > len(x) + len(other)


def test_near_dedup_leaves_one_table_of_its_own(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    disk = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {f.getPath().getName() for f in disk.listStatus(folder)} if disk.exists(folder) else set()
    rows = [(1, "one text of a few words"), (1, "one text of a few words"), (2, "one text of a few words"), (3, "another text"), (None, "another text"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (None, 0.8):
        before = tables()
        out = simhash.deduplicate(docs, similarity=similarity)
        assert {name.split("-")[0] for name in tables() - before} == {"kept"}
        assert sorted(out.collect()) == [(1, rows[0][1]), (3, "another text"), (4, None)]
