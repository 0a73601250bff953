"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training token windows.

Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Every window of ``size``
consecutive words of a test item goes into the set (an item with fewer words is one shorter window). Windows
of a document whose 64-bit hash is in the set are compared word by word before they count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import written

# every byte that is neither an ASCII letter or digit nor part of a non-ASCII character becomes a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_WORDS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class NgramSet:
    """The windows of a part of the benchmark, looked up by rolling hash and verified by their word numbers."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.number: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                windows[n][tuple(ids[i : i + n])].add(item_id)
        self.reach = max(windows, default=0)
        self.tables = []
        for n, found in sorted(windows.items()):
            keys = list(found)
            hashes = self.rolled(np.array(keys, dtype=np.uint64), n)
            by_hash: dict[int, list[tuple[int, ...]]] = defaultdict(list)
            for h, k in zip(hashes.tolist(), keys, strict=True):
                by_hash[h].append(k)
            self.tables.append((n, np.unique(hashes), by_hash, dict(found)))

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of each row of n word numbers."""
        h = np.zeros(len(ids), dtype=np.uint64)
        for j in range(n):
            h = h * _BASE + ids[:, j]
        return h

    def hits(self, tokens: list[bytes]) -> list[tuple[int, int, set[int]]]:
        """(first word, words, items) of each window of the tokens that is in the set."""
        found = []
        get = self.number.get
        for low in range(0, len(tokens), _BLOCK_WORDS):
            # blocks overlap by a window, so a text of any length is scanned whole in bounded memory
            part = tokens[low : low + _BLOCK_WORDS + self.reach]
            ids = np.fromiter((get(t, 0) for t in part), dtype=np.uint64, count=len(part))
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            for n, hashes, by_hash, owners in self.tables:
                if len(ids) < n:
                    continue
                starts = np.flatnonzero(known[n:] - known[:-n] == n)
                starts = starts[starts < _BLOCK_WORDS]
                if not len(starts):
                    continue
                h = np.zeros(len(starts), dtype=np.uint64)
                for j in range(n):
                    h = h * _BASE + ids[starts + j]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for s in starts[hashes[at] == h].tolist():
                    key = tuple(ids[s : s + n].tolist())
                    if key in owners:
                        found.append((low + s, n, owners[key]))
        return found


def _parts(benchmark: DataFrame, item_id: str, text: str, set_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in parts of at most ``set_bytes`` of text each (one longer item is a part of its own)."""
    part, held = [], 0
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text)
    for row in rows.toLocalIterator():
        size = len(row[1]) * 4
        if part and held + size > set_bytes:
            yield part
            part, held = [], 0
        part.append((row[0], row[1]))
        held += size
    yield part


def find_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", set_bytes: int = 16 << 20) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of first, end word; sorted, disjoint), items (sorted distinct ids).

    The benchmark is shipped to the executors in parts of at most ``set_bytes``, and no task holds two parts at once.
    One part is one scan of the documents. Beyond one, rows are written with a number of their own, each part is a
    scan of them, and what the parts found is put together by row number, so a benchmark of any size gives the same
    result, also for documents that share an id.

    Null text has no words. Test items with a null id or text, or without words, take no part; repeated items
    count once. Repeated documents are each reported. Columns of any other name pass by unread.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    parts = _parts(benchmark, item_id, item_text, set_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return source.withColumn("row", F.lit(0).cast("long")).mapInPandas(_scan(spark, first, size), _FOUND).drop("row")
    rows = written(source.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    scans = rows.mapInPandas(_scan(spark, first, size), _FOUND)
    for part in chain([second], parts):
        scans = scans.unionByName(rows.mapInPandas(_scan(spark, part, size), _FOUND))
    scans = written(scans, "part-hits")
    hit = scans.where(F.size("spans") > 0).groupBy(F.col("row").alias("r")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    joined = F.expr(
        "aggregate(array_sort(s), cast(array() as array<struct<first:bigint,end:bigint>>), (a, x) -> "
        "if(size(a) > 0 and x.first <= element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, x.end)))), "
        "concat(a, array(x))))"
    )
    each = scans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    none, nobody = F.array().cast("array<struct<first:bigint,end:bigint>>"), F.array().cast("array<bigint>")
    return each.join(hit, F.col("row") == F.col("r"), "left").select("doc_id", "n_words", F.coalesce(joined, none).alias("spans"), F.coalesce(F.array_sort(F.array_distinct("i")), nobody).alias("items"))


_FOUND = "row long, doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<long>"


def _scan(spark, part: list[tuple[int, str]], size: int):
    held = spark.sparkContext.broadcast(NgramSet(part, size))

    def run(batches):
        for pdf in batches:
            out = []
            for row, d, t in zip(pdf["row"], pdf["d"], pdf["t"], strict=True):
                tokens = words(t)
                spans, items = [], set()
                for first, n, owners in sorted(held.value.hits(tokens), key=lambda x: x[:2]):
                    items |= owners
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], first + n)
                    else:
                        spans.append([first, first + n])
                out.append((row, d, len(tokens), [{"first": a, "end": b} for a, b in spans], sorted(items)))
            yield pd.DataFrame(out, columns=["row", "doc_id", "n_words", "spans", "items"]).astype({"doc_id": "Int64"})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", set_bytes: int = 16 << 20) -> DataFrame:
    """The documents without benchmark text; rows are judged by their own text, and no row moves.

    ``remove="documents"`` drops each row with a hit; a clean row stays whatever its id. ``remove="spans"`` keeps every
    row and cuts the characters from the first to the last word of each hit run, all runs judged on the text as
    given. Null texts and texts without words are kept as they are, repeated rows are judged alike, and columns of any
    other name pass through. The benchmark comes in parts as in ``find_hits``; each further part is another pass.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(NgramSet(p, size)) for p in _parts(benchmark, item_id, item_text, set_bytes)]
    if remove == "documents":
        for at, part in enumerate(parts):
            docs = (written(docs, "clean-rows") if at else docs).where(~_hit(part)(F.col(text)))
        return docs

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _cut(t, parts))

    return docs.withColumn(text, cut(F.col(text)))


def _hit(part):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(part.value.hits(words(t))))

    return hit


def _cut(text: str, parts: list) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    tokens = words(text)
    keep = np.ones(len(raw), dtype=bool)
    for part in parts:
        for first, n, _ in part.value.hits(tokens):
            keep[starts[first] : ends[first + n - 1]] = False
    return np.frombuffer(raw, dtype=np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")


def digest(hits: DataFrame) -> DataFrame:
    """The reported columns of ``find_hits``."""
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.first)")
    joined = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
