"""The ten operators against plain restatements, on fixtures with nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from axisframe.llm import decontaminate, langid, mixing, resample, sharding, simhash, suffixes, tokens, topk, warc
from axisframe.llm.common import fresh_path
from axisframe.llm.graph import components
from axisframe.llm.queries import tokenizer_path

from plain import windows

SF = "/root/testdata/sf0.001"
WORDS = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
SENTENCE = " ".join(WORDS)
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
TEXTS = [
    (1, SENTENCE),
    (2, SENTENCE),
    (2, SENTENCE),
    (3, None),
    (4, ""),
    (None, SENTENCE + " and more of it"),
    (None, None),
    (5, LONG),
    (6, " \t\n\r "),
    (7, "Ünï çödé straße 漢字 \U0001f600 İ " * 6),
    (8, "ab"),
    (9, "x" + LONG[:4000]),
    (10, "y " + SENTENCE.upper() + " " + LONG[1000:1300]),
    (11, "two words"),
    (12, "<|endoftext|> a<|ENDOFTEXT|>b don't stop... 12.5% 'S <|startoftext|>"),
]
EXTRA = "shard string, slot string, component_id string, fp string, key string, t string, d string, bucket string, mix_slot string, lang_pred string, score string, log_weight string, place string, doc string, __s string, __m_block string, __identified string, __o_0 string, __keep string, __fp string, __bad string, row_key string, nth string, stays string, sender string, source_number string, bucket_rows string, offset string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    n = len(EXTRA.split(","))
    rows = [(i, t, "en" if k % 2 else None, "hot" if k % 3 else None, None if t is None else len(t), *["z"] * n) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


# 1 -------------------------------------------------------------------------------------------------------------------
def _bin(text: str) -> int:
    h = 0
    for i, ch in enumerate(text):
        h += (ord(ch) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)
    h &= (1 << 64) - 1
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & ((1 << 64) - 1)
    return h ^ (h >> 32)


def test_features_are_those_of_words_pairs_and_stems():
    text = "Hello, strange World. hello"
    words = re.findall(r"\w+|[^\w\s]+", text)
    want = Counter(_bin(w) % resample.WORD_BINS for w in words)
    for i, size in enumerate(resample.STEMS):
        want.update(_bin(w[:size].lower()) % resample.STEM_BINS + resample.WORD_BINS + resample.PAIR_BINS + i * resample.STEM_BINS for w in words if len(w) >= size)
    for a, b in zip(words, words[1:]):
        pair = ((_bin(a) * 0x9E3779B97F4A7C15 ^ _bin(b)) & ((1 << 64) - 1)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
        want[(pair >> 40) % resample.PAIR_BINS + resample.WORD_BINS] += 1
    got = Counter()
    for bins, whose in resample.features([None, text, ""]):
        assert set(whose.tolist()) <= {1}
        got.update(bins.tolist())
    assert got == want


def test_resample_takes_the_k_largest_keys(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    everything = resample.resample(docs, labels, k=10**9).select("doc_id", "gumbel_key").collect()
    assert len(everything) == docs.count()
    best = sorted((r.gumbel_key for r in everything), reverse=True)[:17]
    assert sorted((r.gumbel_key for r in resample.resample(docs, labels, k=17).collect()), reverse=True) == best


def test_resample_keeps_good_and_drops_toxic(spark):
    # a toxic word is told from chance once the raw model has counted it some hundred times
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in resample.resample(docs, labels).select("doc_id").collect()}
    each = labels.collect()
    good = [r.doc_id for r in each if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id for r in each if r.toxic == 1]
    assert np.mean([i in kept for i in good]) > 0.95
    assert np.mean([i in kept for i in toxic]) < 0.1


def test_resample_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (2, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for found in (resample.resample(docs, labels.limit(0)), resample.resample(docs, labels, k=10**6)):
        assert found.count() == len(TEXTS)
    assert resample.resample(docs, labels, k=0).count() == 0
    assert resample.resample(empty, labels).count() == 0


def test_features_do_not_depend_on_slices(monkeypatch):
    random = np.random.default_rng(8)
    texts = ["".join(random.choice(list("ab ,x\n"), 4000)), "q" * 900 + " a b", None, "   "]

    def counted(size):
        monkeypatch.setattr(resample, "_CHUNK", size)
        resample._tables.cache_clear()
        got = Counter()
        for bins, whose in resample.features(texts):
            got.update(zip(bins.tolist(), whose.tolist()))
        return got

    whole = counted(1 << 20)
    assert all(counted(size) == whole for size in (7, 50, 300))
    monkeypatch.undo()
    resample._tables.cache_clear()


# 2 -------------------------------------------------------------------------------------------------------------------
def _print(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _classes(found):
    """{position: least id reachable} by comparing all pairs."""
    label = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if bin(found[i][1] ^ found[j][1]).count("1") <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = defaultdict(list)
    for at, (i, _) in zip(label, found):
        least[at].append(i)
    return [min((x for x in least[at] if x is not None), default=None) for at in label]


def test_simhash_against_all_pairs(spark, docs, empty):
    few = docs.where(F.length("text") < 100_000).unionByName(docs.where("text is null"))
    texts = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    prints = [(i, _print(t)) for i, t in texts]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, _classes(prints))), key=str)
    assert sorted(map(tuple, simhash.digest(simhash.near_duplicates(few)).collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    assert simhash.fingerprint(LONG) == _print(LONG)


def test_simhash_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r.doc_id, _print(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, _classes(prints)))
    assert sorted(map(tuple, simhash.digest(simhash.near_duplicates(docs)).collect())) == want
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs).select("doc_id").collect())
    assert kept == sorted({c for _, _, c in want})


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_lose_no_class_in_hot_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    random = np.random.default_rng(3)
    base = int(random.integers(1 << 62))
    prints = [base ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 6), replace=False)) for _ in range(60)]
    label = _classes(list(enumerate(prints)))
    signed = [int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for p in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs)
    assert [r.component_id for r in simhash.near_duplicates(frame).orderBy("doc_id").collect()] == label


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(edges.limit(0)).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("n", "k", "m"), [(10, 4, 3), (50, 20, 25), (7, 7, 3), (5, 0, 2), (9, 3, 9)])
def test_hypergeometric_draw_is_the_inverse_cdf(spark, n, k, m):
    low, high = max(0, m + k - n), min(k, m)
    chance = [math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(low, high + 1)]
    us = [0.001, 0.1, 0.37, 0.5, 0.81, 0.99]
    cdf = np.cumsum(chance)
    want = [low + int(np.searchsorted(cdf, u)) for u in us]
    column = sharding.hypergeometric(*[F.lit(x).cast("long") for x in (n, k, m)], F.col("u"))
    assert [r.x for r in spark.createDataFrame([(u,) for u in us], "u double").select(column.alias("x")).collect()] == want


@pytest.mark.parametrize("per_block", [16384, 4])
def test_shards_have_exact_sizes(spark, docs, empty, per_block):
    wide = docs.unionByName(docs).unionByName(docs)
    found = sharding.shuffle_into_shards(wide, 7, rows_per_block=per_block)
    assert found.columns == [c for c in wide.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = found.collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in TEXTS * 3)
    assert sorted((r["size"], r.text_crc32) for r in sharding.digest(found).collect()) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in TEXTS * 3)
    assert sharding.shuffle_into_shards(empty, 7).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
def _removed(texts, length=50):
    """[(id, n_bytes, n_removed, n_spans, sha)] by looking up every string."""
    first = {}
    for i, t in texts:
        raw = (t or "").encode()
        for a in range(len(raw) - length + 1):
            if i is not None:
                first[raw[a : a + length]] = min(i, first.get(raw[a : a + length], i))
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            if i is not None and first[raw[a : a + length]] < i:
                gone[a : a + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def test_repeated_spans_against_every_string(spark, docs, empty):
    assert rows(suffixes.digest(suffixes.repeated_spans(docs))) == sorted(_removed(TEXTS), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert suffixes.repeated_spans(empty).count() == 0


def test_repeated_spans_overlaps_runs_and_periods(spark):
    random = np.random.default_rng(5)
    base = "".join(random.choice(list("ab c"), 900))
    texts = [(k, base[(a := int(random.integers(0, 700))) : a + int(random.integers(0, 300))] + "".join(random.choice(list("ab c"), 30)) + base[a // 2 : a // 2 + 70]) for k in range(40)]
    texts += [(50, "a" * 49), (51, "a" * 50), (52, "a" * 51), (53, "ab" * 200), (54, "b" + "ab" * 100), (49, "a" * 300), (55, "é" * 60), (56, "xé" + "é" * 30)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffixes.digest(suffixes.repeated_spans(frame)).collect())) == sorted(_removed(texts))


# 5 -------------------------------------------------------------------------------------------------------------------
ITEMS = [(1, SENTENCE), (10, SENTENCE.upper() + " x"), (2, "two words"), (3, None), (None, SENTENCE), (4, ""), (5, "word0 word2916"), (6, "ab"), (6, "ab"), (7, "... !!")]


@pytest.mark.parametrize("set_bytes", [16 << 20, 100])
def test_decontamination_against_plain_windows(spark, docs, empty, set_bytes):
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, spans string")
    got = rows(decontaminate.digest(decontaminate.find_hits(docs, bench, set_bytes=set_bytes)))
    assert got == sorted(windows(TEXTS, ITEMS), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.find_hits(docs, bench.limit(0))).collect())


def test_decontamination_removes_documents_or_spans(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    stay = [t for t, (*_, hit) in zip(TEXTS, windows(TEXTS, ITEMS), strict=True) if not hit]
    assert (None, None) in stay  # a clean row without an id beside a contaminated one
    for set_bytes in (16 << 20, 100):
        clean = decontaminate.decontaminate(docs, bench, set_bytes=set_bytes)
        assert clean.columns == docs.columns and rows(clean.select("doc_id", "text")) == sorted(stay, key=lambda r: tuple((x is not None, str(x)) for x in r))
        cut = decontaminate.decontaminate(docs, bench, remove="spans", set_bytes=set_bytes)
        assert cut.count() == len(TEXTS)
        assert [r.text for r in cut.where("doc_id in (1, 8, 11)").orderBy("doc_id").collect()] == ["", "", ""]
        assert cut.where("doc_id = 10").first().text.startswith("y ")


@pytest.mark.parametrize("set_bytes", [16 << 20, 100])
def test_rows_that_share_an_id_are_judged_apart(spark, set_bytes):
    words = WORDS[:12]
    texts = [(2, " ".join(words)), (2, " ".join(reversed(words))), (None, " ".join(words)), (None, " ".join(w + "x" for w in words))]
    items = [(1, " ".join(words)), (2, "other words of the second part " * 3), (3, "third " * 12)]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.digest(decontaminate.find_hits(frame, bench, set_bytes=set_bytes))) == sorted(windows(texts, items), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert rows(decontaminate.decontaminate(frame, bench, set_bytes=set_bytes)) == rows(frame.where("text not like 'Alpha beta%'"))


# 6 -------------------------------------------------------------------------------------------------------------------
def test_cross_parsing_is_greedy_longest_match():
    model = langid.Model({"x": ["abracadabra cadabra", "bandana"], "y": ["zzyzx zyzzyva"]})
    for language, source in enumerate((["abracadabra cadabra", "bandana"], ["zzyzx zyzzyva"])):
        inside = chr(0xFFFF).join(source)
        text = "abracazyz bandabra qq zyzz xdana"
        want, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in inside:
                n += 1
            want, at = want + 1, at + n
        codes = model.encoded(text)
        got = langid.phrases(langid.dense(model.edges[language]), codes.reshape(-1, 1), np.array([len(codes)]))
        assert got[0] == want


def test_language_accuracy_and_edges(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(table.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(table, model).where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    edges = langid.identify(docs, model)
    assert edges.columns.count("lang_pred") == 1 and edges.count() == len(TEXTS)
    for r in edges.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_whole_texts_are_parsed_across_segments(monkeypatch):
    random = np.random.default_rng(1)
    model = langid.Model({"x": ["".join(random.choice(list("ab c"), 400))], "y": ["".join(random.choice(list("abd "), 300))]})
    texts = ["".join(random.choice(list("abcd "), int(n))) for n in random.integers(1, 400, 30)] + [("ab ac" * 3 + "b") * 100, "b" * 300]
    tables = [langid.dense(e) for e in model.edges]
    monkeypatch.setattr(langid, "_SEGMENT", 1 << 30)
    whole = langid.classify(model, tables, texts)
    for size in (1, 3, 50):
        monkeypatch.setattr(langid, "_SEGMENT", size)
        assert langid.classify(model, tables, texts) == whole


# 7 -------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    big, other = "<p>same page</p>" * 90, "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2", "small"), (3, None, "small"), (4, "http://a/ 4", big), (9, "http://a/9", big), (9, "http://a/9", big), (5, "http://b", other), (6, "", None), (7, "http://c\r\nX: y", ""), (8, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "http://e", big), (10, "http://f", other)]
    frame = spark.createDataFrame([(*p, "z", "z") for p in pages], "page_id long, url string, html string, body string, sha1 string")
    path = fresh_path(spark, "warc-test")
    warc.write_captures(warc.with_revisits(frame), path, records_per_file=5)
    captures = warc.assemble(spark, path)
    first = {}
    for i, _, body in pages:
        if body is not None and len(body.encode()) >= 1000 and i is not None:
            first[body] = max(i, first.get(body, i))
    want = []
    for i, _, body in pages:
        raw = (body or "").encode()
        revisit = i is not None and body in first and i < first[body]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    assert sorted(map(str, map(tuple, warc.digest(captures).collect()))) == sorted(map(str, want))
    for r in captures.collect():
        assert r.response is not None and len(r.requests) == 1 and len(r.metadata) == 1
    path = fresh_path(spark, "warc-test")
    warc.write_captures(warc.with_revisits(frame.limit(0)), path)
    assert warc.assemble(spark, path).count() == 0


def test_damaged_archives_are_errors():
    whole = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r[-1] for r in warc.parse_records(whole * 2)] == [b"hello"] * 2
    for bad in (whole[:-8], whole[:20], b"junk" + whole):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


# 8 -------------------------------------------------------------------------------------------------------------------
def _encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*x.ids, 1] for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _token_rows(texts):
    out, start = [], 0
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    for (i, _), ids in zip(order, _encoded([t for _, t in order])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file_against_the_tokenizer(spark, docs, empty):
    path = fresh_path(spark, "tokens-test")
    named = docs.where("doc_id is not null")
    tokens.write_tokens(named, path, tokenizer_path(), part_bytes=100_000)
    got = sorted(map(tuple, tokens.digest(tokens.read_tokens(spark, path)).collect()))
    assert got == sorted(_token_rows([x for x in TEXTS if x[0] is not None]))
    everything = fresh_path(spark, "tokens-test")
    tokens.write_tokens(docs, everything, tokenizer_path())
    assert tokens.read_tokens(spark, everything).count() == len(TEXTS)
    assert {r.doc_id for r in tokens.token_slice(spark, everything, 4, 7).collect()} == {4, 5, 6, 7}
    none = fresh_path(spark, "tokens-test")
    tokens.write_tokens(empty, none, tokenizer_path())
    assert tokens.digest(tokens.read_tokens(spark, none)).count() == 0


def test_other_tokenizers_are_left_to_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["Some  text with\n\nlines, don't ", "", "漢字 \U0001f600 x"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(path).ids(texts) == want
    assert tokens.Encoder(tokenizer_path()).by_words


def test_tokens_of_whole_tables(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        path = fresh_path(spark, "tokens-test")
        tokens.write_tokens(docs, path, tokenizer_path(), part_bytes=1 << 20)
        want = _token_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(map(tuple, tokens.digest(tokens.read_tokens(spark, path)).collect())) == want


def test_token_files_have_their_encodings_and_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens.write_tokens(docs, path := str(tmp_path / "tokens"), tokenizer_path())
    for p in (tmp_path / "tokens").glob("*.parquet"):
        group = pq.ParquetFile(p).metadata.row_group(0)
        by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in by["ids.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in by["n_tokens"].encodings and by["doc_id"].has_column_index


# 9 -------------------------------------------------------------------------------------------------------------------
def _best(queries, vectors, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [4096, 7])
def test_top_k_with_ties_and_unusable_vectors(spark, size):
    random = np.random.default_rng(2)
    good = [(i, [float(x) for x in random.integers(-3, 4, 6) / 4]) for i in range(120)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, "z") for i, v in good + bad], "vec_id long, embedding array<float>, node string")
    scaled = topk.scaled(frame, "embedding", 256)
    got = topk.top_k(scaled.where("vec_id % 10 = 0"), scaled, 5, id_column="vec_id", vector="embedding", tile_rows=size, query_rows=4, fan_in=3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    assert sorted(map(tuple, got.collect())) == _best([x for x in whole if x[0] % 10 == 0], whole, 5)
    assert topk.top_k(scaled.limit(0), scaled, 5, id_column="vec_id", vector="embedding").count() == 0
    few = topk.top_k(scaled.where("vec_id < 2"), scaled.where("vec_id < 3"), 5, id_column="vec_id", vector="embedding")
    assert few.count() == 4


def test_top_k_beyond_exact_doubles(spark):
    vectors = [(i, [(1 << 28) + i * 3, -(1 << 28) + i, i]) for i in range(12)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<long>")
    got = topk.top_k(frame.where("vec_id < 3"), frame, 4, id_column="vec_id", vector="embedding")
    assert sorted(map(tuple, got.collect())) == _best(vectors[:3], vectors, 4)


# 10 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("slots", [[1], [3, 1], [5, 3, 2, 6], [97, 1, 1, 1, 28], [7] * 9])
def test_schedule_never_deviates_a_block(slots):
    plan, frame = mixing.frame_schedule(slots), sum(slots)
    done = [0] * len(slots)
    for s, j, slot, release, deadline in plan:
        assert release <= slot < deadline and j == done[s]
        done[s] += 1
        for i, w in enumerate(slots):
            assert abs(done[i] * frame - w * (slot + 1)) < frame
    assert done == slots


def test_mix_places_every_row_once(spark, docs, empty):
    wide = docs.drop("source").crossJoin(spark.range(40)).withColumn("source", F.when(F.col("id") < 25, "hot").when(F.col("id") < 38, "cold"))
    got = mixing.mix(wide, block_rows=8, frame=16, rows_per_bucket=64).collect()
    assert len(got) == len(TEXTS) * 40 == len({(r.mix_slot, r.mix_place) for r in got})
    for source in {r.source for r in got}:
        own = sorted((r.mix_block, r.mix_place) for r in got if r.source == source)
        assert own == [(i // 8, i % 8) for i in range(len(own))]
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert mixing.mix(empty).count() == 0
    laid = mixing.in_order(mixing.mix(wide, block_rows=8))
    assert laid.count() == len(got) and laid.columns == [c for c in wide.columns if not c.startswith("mix_")]


def test_mix_follows_given_weights(spark):
    frame = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(4000)], "doc_id long, source string")
    got = sorted(mixing.mix(frame, {"a": 3.0, "b": 1.0}, block_rows=10, frame=16).collect(), key=lambda r: (r.mix_slot, r.mix_place))
    head = Counter(r.source for r in got[:1600])
    assert abs(head["a"] - 1200) < 2 * 10 + 160  # slots are rounded to sixteenths, one at least
    with pytest.raises(ValueError):
        mixing.mix(frame, {"a": 0.0})


def test_words_with_signs_spare_the_library_and_memory_is_bounded_in_one_text(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [head + sign * n + tail for head in ("ab", "É", "don") for sign in map(chr, range(33, 127)) for n in (1, 3) for tail in ("", " c", "é")]
    texts += [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "long" * 20 + " " + "long" * 20, "é!! á"]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "_KEPT_WORDS", 100)
    encoder = tokens.Encoder(tokenizer_path())
    assert encoder.ids(texts) == want
    assert max(len(encoder.known), len(encoder.known.before)) <= 100 and not encoder.known.long
    monkeypatch.setattr(encoder, "whole", None)
    assert encoder.ids(["what?! yes***"]) == [np.array(library.encode("what?! yes***", add_special_tokens=False).ids, dtype="<u4").tobytes()]
