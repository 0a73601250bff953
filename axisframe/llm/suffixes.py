"""Repeated byte strings across documents, by blockwise sorting of suffix buckets.

A suffix is looked at for its first ``length`` bytes: two that agree in them repeat one another. Not every suffix
is sorted. A cover sample of positions is taken such that any two equal strings of ``length`` bytes have a sampled
position at the same distance from their starts: the positions whose ``SEED``-byte hash is least in some window.
Sampled suffixes go to buckets by that hash. Buckets are sorted one at a time; a sampled suffix whose bucket-mates
come from one text alone takes no further part. Around the others, all suffixes that run through the same sample
are sorted by their whole first ``length`` bytes, again a bucket at a time, which gives each the least document
that has it. A task holds one bucket in memory, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.llm.common import written

#: Bytes of a sampled suffix that choose its bucket.
SEED = 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_CHUNK = 4 << 20
_RESOLVED = np.uint32(0xFFFFFFFF)
_BUCKET_BYTES = 12 << 20
#: Strings whose bytes are compared at once.
_VERIFIED = 1 << 14


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at each position, built by doubling."""
    step = {1: data.astype(np.uint64) + np.uint64(1)}
    for n in (1, 2, 4, 8):
        step[2 * n] = step[n][:-n] * _power(n) + step[n][n:]
    return _mixed(step[16][:-4] * _power(4) + step[4][16:]) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick() of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def cover_sample(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the cover sample of texts laid end to end, the i-th in starts[i]:starts[i + 1].

    A string of ``length`` bytes holds length - SEED + 1 seeds; those of least hash are sampled. Equal strings have
    equal least seeds, and strings across two texts are left out.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = seed_hashes(data)
    width = length - SEED + 1
    least = _sliding(h, width, np.minimum)  # of the string that starts here
    whole = np.zeros(len(least) + 1, dtype=np.int32)
    ends = np.maximum(starts[:-1], starts[1:] - length + 1)
    np.add.at(whole, np.minimum(starts[:-1], len(least)), 1)
    np.add.at(whole, np.minimum(ends, len(least)), -1)
    least[np.cumsum(whole[:-1]) == 0] = 0
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)))
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    return at, h[at]


def _chunks(pdf: pd.DataFrame, columns: list[str]):
    """Rows of a batch in chunks of some MB: (columns' lists, texts as bytes)."""
    rows, held, size = [], [], 0
    for row in pdf[columns].itertuples(index=False):
        rows.append(row[:-1])
        held.append(row[-1])
        size += len(row[-1])
        if size > _CHUNK:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _sample_rows(length: int, buckets: int):
    """Map texts to (bucket, kind, blob): kind 0 entries to sort, kind 1 positions that a chunk has shown shared."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(b=[t.encode("utf-8", "surrogatepass") for t in pdf["t"]])
            for _, texts in _chunks(pdf, ["b"]):
                keys = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64)
                starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                at, h = cover_sample(np.frombuffer(b"".join(texts), np.uint8), starts, length)
                if not len(at):
                    continue
                who = np.searchsorted(starts, at, side="right") - 1
                pos = (at - starts[who]).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                same = np.concatenate(([True], np.diff(h[order]) != 0))
                run_of = np.cumsum(same) - 1
                first = np.flatnonzero(same)
                differs = keys[who[order]] != keys[who[order[first]]][run_of]
                others, second = np.unique(run_of[differs], return_index=True)
                shared = np.isin(run_of, others)
                if shared.any():
                    found = order[shared]
                    yield pd.DataFrame({"bucket": [int(keys[0] % np.uint64(buckets))], "kind": [1], "blob": [keys[who[found]].tobytes() + pos[found].tobytes()]})
                    # two texts stand for a hash that the chunk shares: other chunks learn of it, however many have it
                    witness = np.zeros(len(order), bool)
                    witness[first[others]] = witness[np.flatnonzero(differs)[second]] = True
                    pos[found] = _RESOLVED
                    order = order[~shared | witness]
                order = np.sort(order)
                bucket = (_mixed(h[order]) >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                order, bucket = order[by], bucket[by]
                cuts = np.flatnonzero(np.diff(bucket, prepend=buckets + 1))
                out = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                    out.append((int(bucket[a]), 0, _packed(h[order[a:b]], who[order[a:b]], keys, pos[order[a:b]])))
                yield pd.DataFrame(out, columns=["bucket", "kind", "blob"])

    return run


def _packed(h: np.ndarray, who: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries in order of text: 40 bits of each hash, the texts' keys once each, positions by halves."""
    texts, counts = np.unique(who, return_counts=True)
    head = np.array([len(h), len(texts)], dtype=np.uint32).tobytes()
    five = h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return head + keys[texts].tobytes() + counts.astype(np.uint32).tobytes() + five + (pos & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (pos >> np.uint32(16)).astype(np.uint16).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, texts = np.frombuffer(blob, np.uint32, 2).tolist()
    at = 8
    keys = np.frombuffer(blob, np.uint64, texts, at)
    counts = np.frombuffer(blob, np.uint32, texts, at := at + 8 * texts)
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at := at + 4 * texts).reshape(-1, 5)
    low = np.frombuffer(blob, np.uint16, n, at := at + 5 * n)
    high = np.frombuffer(blob, np.uint16, n, at + 2 * n)
    return h.view(np.uint64).ravel(), np.repeat(keys, counts), low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))


def _by_bucket(batches, work):
    """work(blobs) for each bucket of a partition sorted by bucket."""
    bucket, blobs = None, []
    for pdf in batches:
        for b, kind, blob in zip(pdf["bucket"], pdf["kind"], pdf["blob"], strict=True):
            if b != bucket and blobs:
                yield from work(blobs)
                blobs = []
            bucket = b
            blobs.append((kind, blob))
    if blobs:
        yield from work(blobs)


def _shared_positions(batches):
    """(key, pos) of sampled suffixes whose bucket-mates of equal hash come from other texts too."""

    def work(blobs):
        for kind, blob in blobs:
            if kind == 1:
                n = len(blob) // 12
                yield pd.DataFrame({"key": np.frombuffer(blob, np.int64, n), "pos": np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64)})
        parts = [_unpacked(blob) for kind, blob in blobs if kind == 0]
        if not parts:
            return
        h, key, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, key, pos = h[order], key[order], pos[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(h) != 0)))
        shared = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
        take = np.repeat(shared, np.diff(np.concatenate((first, [len(h)])))) & (pos != _RESOLVED)
        order = np.argsort(key[take], kind="stable")
        yield pd.DataFrame({"key": key[take][order].view(np.int64), "pos": pos[take][order].astype(np.int64)})

    yield from _by_bucket(batches, work)


def _record(length: int) -> np.dtype:
    side = length - SEED
    return np.dtype([("doc", "<i8"), ("key", "<i8"), ("pos", "<u4"), ("low", "u1"), ("high", "u1"), ("bytes", "u1", (2 * side + SEED,))])


def _context_rows(length: int, buckets: int):
    """Map texts with shared positions to (bucket, kind, blob): kind 0 contexts to sort, kind 1 intervals found."""
    side, kind = length - SEED, _record(length)

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            pdf = pdf.assign(b=[unzip.decompress(z) for z in pdf["z"]])
            for rows, texts in _chunks(pdf, ["doc_id", "key", "positions", "b"]):
                records = []
                for (doc, key, positions), text in zip(rows, texts, strict=True):
                    p = np.unique(np.asarray(positions, dtype=np.int64))
                    p = p[p + SEED <= len(text)]
                    data = np.zeros(len(text) + 2 * side, np.uint8)
                    data[side : side + len(text)] = np.frombuffer(text, np.uint8)
                    one = np.zeros(len(p), kind)
                    one["doc"], one["key"], one["pos"] = doc, key, p
                    # the strings through the sample start low..high bytes before it
                    one["low"], one["high"] = np.maximum(0, p + length - len(text)), np.minimum(side, p)
                    one["bytes"] = np.lib.stride_tricks.sliding_window_view(data, 2 * side + SEED)[p]
                    records.append(one[one["low"] <= one["high"]])
                found = np.concatenate(records)
                if not len(found):
                    continue
                weights = np.array([int(_power(i)) for i in range(2 * side + SEED)], dtype=np.uint64)
                mark = (found["bytes"].astype(np.uint64) + np.uint64(1)) @ weights + found["low"].astype(np.uint64) * np.uint64(31) + found["high"]
                order = np.lexsort((found["doc"], mark))
                found, mark = found[order], mark[order]
                first = np.flatnonzero(np.concatenate(([True], np.diff(mark) != 0)))
                head = found[np.repeat(first, np.diff(np.concatenate((first, [len(found)]))))]
                # where a chunk has the same context in an earlier document, the later ones are settled at once
                done = (found["doc"] > head["doc"]) & (found["low"] == head["low"]) & (found["high"] == head["high"]) & (found["bytes"] == head["bytes"]).all(axis=1)
                if done.any():
                    yield pd.DataFrame({"bucket": [int(found["pos"][0]) % buckets], "kind": [1], "blob": [_intervals(found[done], found["low"][done].astype(np.int64), found["high"][done].astype(np.int64), length)]})
                found = found[~done]
                h = _mixed((found["bytes"][:, side : side + SEED].astype(np.uint64) + np.uint64(1)) @ weights[:SEED])
                bucket = (h >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                found, bucket = found[by], bucket[by]
                cuts = np.flatnonzero(np.diff(bucket, prepend=buckets + 1))
                out = [(int(bucket[a]), 0, found[a:b].tobytes()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True)]
                yield pd.DataFrame(out, columns=["bucket", "kind", "blob"])

    return run


def _intervals(found: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> bytes:
    """doc, key, start, end of the bytes under the strings that start low..high bytes before each sample."""
    out = np.zeros((len(found), 4), dtype=np.int64)
    out[:, 0], out[:, 1] = found["doc"], found["key"]
    out[:, 2], out[:, 3] = found["pos"].astype(np.int64) - high, found["pos"].astype(np.int64) - low + length
    return out.tobytes()


def _covered(length: int):
    """(doc_id, key, start, end): bytes under strings that an earlier document has, from contexts sorted a bucket at a time."""
    side, kind = length - SEED, _record(length)

    def frame(blob: bytes) -> pd.DataFrame:
        return pd.DataFrame(np.frombuffer(blob, np.int64).reshape(-1, 4), columns=["doc_id", "key", "start", "end"])

    def work(blobs):
        for k, blob in blobs:
            if k == 1:
                yield frame(blob)
        found = np.frombuffer(b"".join(blob for k, blob in blobs if k == 0), kind)
        blobs.clear()
        if not len(found):
            return
        text = found["bytes"]
        at = lambda j: text[:, j].astype(np.uint64) + np.uint64(1)
        # one hash a context, rolled on by a byte for each start: a bucket's memory is its contexts and little more
        rolled = np.zeros(len(found), np.uint64)
        for j in range(length):
            rolled = rolled * np.uint64(_MULTIPLIER) + at(j)
        low, high = np.full(len(found), 255, np.int64), np.full(len(found), -1, np.int64)
        for a in range(side + 1):
            if a:
                rolled = (rolled - at(a - 1) * _power(length - 1)) * np.uint64(_MULTIPLIER) + at(a - 1 + length)
            back = side - a
            rows = np.flatnonzero((found["low"] <= back) & (found["high"] >= back))
            if len(rows) < 2:
                continue
            h = _mixed(rolled[rows])
            rows = rows[order := np.lexsort((found["doc"][rows], h))]
            h = h[order]
            first = np.flatnonzero(np.concatenate(([True], np.diff(h) != 0)))
            head = rows[np.repeat(first, np.diff(np.concatenate((first, [len(rows)]))))]
            later = found["doc"][rows] > found["doc"][head]
            rows, head = rows[later], head[later]
            sure = [(text[rows[i : i + _VERIFIED], a : a + length] == text[head[i : i + _VERIFIED], a : a + length]).all(axis=1) for i in range(0, len(rows), _VERIFIED)]
            if sure:
                rows = rows[np.concatenate(sure)]
            low[rows], high[rows] = back, np.maximum(high[rows], back)
        # strings through one sample start less than a string's length apart, so together they cover one run
        take = high >= 0
        if take.any():
            yield frame(_intervals(found[take], low[take], high[take], length))

    return lambda batches: _by_bucket(batches, work)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of a set of intervals; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, key, z): texts deflated for a shuffle."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["d"], "key": pdf["key"], "z": [pack.compress(t.encode("utf-8", "surrogatepass")) for t in pdf["t"]]})

    return docs.select("d", "key", "t").mapInPandas(run, "doc_id long, key long, z binary")


def repeated_spans(docs: DataFrame, *, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (maximal removed runs of bytes), n_removed, kept_sha256.

    A byte is removed if it is under a string of ``length`` bytes that also starts in a document with a smaller
    doc_id, judged on whole texts as given. Null texts are empty. A text equal to that of a smaller doc_id goes
    whole (if it has ``length`` bytes). Rows of one doc_id never remove from one another, rows without a doc_id
    neither lose nor cause a removal, and repeated rows are each answered. An empty table gives no rows.
    """
    if length < SEED + 1 or length - SEED > 250:
        raise ValueError(f"length is {SEED + 1} to {SEED + 250}")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), body.alias("t")).withColumn("key", F.xxhash64("t"))
    facts = written(rows.select(F.col("d").alias("doc_id"), "key", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("sha")), "texts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // _BUCKET_BYTES))
    tasks = max(1, min(buckets, 1 << 20))
    usable = rows.where(F.col("d").isNotNull() & (F.octet_length("t") >= length))
    firsts = facts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.min("key").alias("first_key"))

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    sample = usable.select("t").mapInPandas(_sample_rows(length, buckets), "bucket long, kind int, blob binary")
    shared = dealt(sample).mapInPandas(_shared_positions, "key long, pos long")
    shared = shared.groupBy(F.col("key").alias("k")).agg(F.collect_list("pos").alias("positions"))
    wanted = shared.join(firsts.where("first is not null"), F.col("k") == F.col("first_key")).select(F.col("first").alias("f"), "first_key", "positions")
    texts = _zipped(usable)
    near = texts.join(wanted, (F.col("doc_id") == F.col("f")) & (F.col("key") == F.col("first_key"))).select("doc_id", texts["key"], "positions", "z")
    contexts = near.mapInPandas(_context_rows(length, buckets), "bucket long, kind int, blob binary")
    covered = dealt(contexts).mapInPandas(_covered(length), "doc_id long, key long, start long, end long")
    runs = covered.groupBy(F.col("doc_id").alias("r"), F.col("key").alias("rk")).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    schema = T.StructType.fromDDL("c_doc long, c_key long, c_spans array<struct<start:long,end:long>>, c_removed long, c_sha string")

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for d, key, z, found in zip(pdf["doc_id"], pdf["key"], pdf["z"], pdf["runs"], strict=True):
                raw = unzip.decompress(z)
                spans = merged([(x["start"], x["end"]) for x in found])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((d, key, [{"start": a, "end": b} for a, b in spans], sum(b - a for a, b in spans), kept.hexdigest()))
            yield pd.DataFrame(out, columns=schema.names)

    cuts = _zipped(usable).join(runs, (F.col("doc_id") == F.col("r")) & (F.col("key") == F.col("rk"))).select("doc_id", "key", "z", "runs").mapInPandas(cut, schema)
    cuts = written(cuts.distinct(), "cuts")
    known = facts.join(firsts.select(F.col("sha").alias("s"), "first"), F.col("sha") == F.col("s"), "left")
    answered = known.join(cuts, (F.col("doc_id") == F.col("c_doc")) & (F.col("key") == F.col("c_key")), "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return answered.select(
        "doc_id",
        "n_bytes",
        F.when(copy, whole).otherwise(F.coalesce("c_spans", none)).alias("spans"),
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("c_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("c_sha", "sha")).alias("kept_sha256"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The reported columns."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
