"""URL filters: which urls a list of hosts and path rules allows or blocks, by cascades of Bloom filters.

A cascade answers membership exactly for every key of a known universe. Its first level encodes the listed keys; the
keys of the universe that pass it wrongly are encoded by the second; listed keys that pass that one, by the third;
and so on until none passes wrongly. The first level that a key fails tells which kind it is. The universe here is
every key that any url of the table can ask for, so urls are judged without a join. Lists of more than ``part_keys``
keys are dealt by hash into parts, each a cascade of its own and a pass over the urls.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import written

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASHES = "k string, h1 long, h2 long"
#: A cascade halves what is left at each level; one that has not ended by then never will.
_MOST_LEVELS = 200


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path up to ``?``, ``#`` or the end.

    Both are empty where the url is null or has no ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _CAPITALS, _SMALL), path


def _with_hashes(keys: DataFrame) -> DataFrame:
    return keys.select("k", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit function of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, tries: int) -> list[np.ndarray]:
    """The bits of each key at a level: another draw at each level."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = _mixed(h1.view(np.uint64) ^ salt), _mixed(h2.view(np.uint64) + salt) | np.uint64(1)
    return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(tries)]


class Level:
    """One Bloom filter: ``words`` of 64 bits, ``tries`` bits a key."""

    def __init__(self, at: int, bits: int, tries: int, words: np.ndarray):
        self.at, self.bits, self.tries, self.words = at, bits, tries, words

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for place in _places(h1, h2, self.at, self.bits, self.tries):
            out &= ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


class Cascade:
    """Levels in turn; ``contains`` is exact for keys of the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        left = np.arange(len(h1))
        for at, level in enumerate(self.levels):
            passed = level.has(h1[left], h2[left])
            out[left[~passed]] = at % 2 == 1
            left = left[passed]
        return out


def _encode(keys: DataFrame, at: int, count: int, rate: float) -> Level:
    """The filter of the keys: tasks set bits of words, words meet by or, and at most one row a word comes back."""
    tries = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(count * tries / math.log(2)))

    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            place = np.unique(np.concatenate([*_places(h1, h2, at, bits, tries), np.zeros(0, np.uint64)]))
            word = (place >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(-(-bits // 64), dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return Level(at, bits, tries, words)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The rows (k, h1, h2) that pass a level."""
    shipped = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shipped.value.has(*(batch.column(c).to_numpy() for c in ("h1", "h2")))))

    return keys.mapInArrow(run, _HASHES)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the column ``k`` of ``listed``, exact for its keys and for all keys of ``universe``.

    Null keys are left out; keys may repeat. An empty list gives a cascade that contains nothing.
    """
    listed = written(_with_hashes(listed.where("k is not null").select("k").distinct()), "listed-keys")
    count = listed.count()
    if not count:
        return Cascade([])
    asked = _with_hashes(universe.where("k is not null").select("k"))
    others = max(1, (asked.agg(F.approx_count_distinct("h1")).first()[0] or 0) - count)
    levels = [_encode(listed, 0, count, min(0.5, max(2.0**-20, count / (math.sqrt(2) * others))))]
    # the one pass over the universe; what it lets through is the list and a like number of others
    wrong = written(_passing(asked, levels[0]).distinct().join(listed.select("k"), "k", "left_anti"), "passing-keys")
    right = listed
    while n := wrong.count():
        if len(levels) > _MOST_LEVELS:
            raise ValueError("two keys share both of their hashes")
        levels.append(_encode(wrong, len(levels), n, 0.5))
        right, wrong = wrong, written(_passing(right, levels[-1]), "passing-keys")
    return Cascade(levels)


def contains(frame: DataFrame, keys: str, name: str, listed: DataFrame, universe: DataFrame, *, part_keys: int = 1 << 21) -> DataFrame:
    """The frame with ``name``: for each entry of the array column ``keys`` (of strings), whether it is listed.

    Tasks hold one part's cascade at a time: some 40 bits a key, ``part_keys`` keys at most, give or take the deal.
    """
    count = listed.where("k is not null").select("k").distinct().count()
    parts = max(1, -(-count // part_keys))
    part = lambda k: F.pmod(F.xxhash64(F.lit("part"), k), F.lit(parts))
    frame = frame.withColumn(name, F.transform(keys, lambda k: F.lit(False)))
    for at in range(parts):
        cascade = build(listed.where(part(F.col("k")) == at), universe.where(part(F.col("k")) == at))
        frame = _look_up(frame, keys, name, cascade, F.transform(keys, lambda k: part(k) == at))  # noqa: B023
        if parts > 1:  # the next part's pass starts from a table, and this part's cascade can go
            frame = written(frame, "listed-urls")
    return frame


def _look_up(frame: DataFrame, keys: str, name: str, cascade: Cascade, mine: Column) -> DataFrame:
    shipped = frame.sparkSession.sparkContext.broadcast(cascade)
    schema, names = frame.schema, frame.columns

    def run(batches):
        for batch in batches:
            lists, h1, h2, own = (batch.column(f"__{c}") for c in ("seen", "h1", "h2", "own"))
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (lists, h1, h2, own)]
            seen = flat[0].astype(bool)
            at = np.flatnonzero(flat[3].astype(bool))
            seen[at] = shipped.value.contains(flat[1][at].astype(np.int64), flat[2][at].astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
            done = pa.ListArray.from_arrays(pa.array(offsets), pa.array(seen))
            yield pa.RecordBatch.from_arrays([done if c == name else batch.column(c) for c in names], names=names)

    hashed = frame.withColumns({
        "__seen": F.col(name),
        "__h1": F.transform(keys, lambda k: F.xxhash64(k)),
        "__h2": F.transform(keys, lambda k: F.xxhash64(F.lit("second"), k)),
        "__own": mine,
    })
    return hashed.mapInArrow(run, schema)


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame, *, key: str = "page_id", url: str = "url", part_keys: int = 1 << 21) -> DataFrame:
    """Each url's host and path, the longest rule that fits it, and its verdict: key, host, path, rule, verdict.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest (host and path together) wins, and block wins over allow of one and the same rule. Where no
    rule fits, hosts of ``listed`` (host) and their subdomains are blocked, and all others allowed. A rule is given
    as host and path joined.

    Null urls and such without ``://`` have an empty host and path, which nothing fits: allow. Every row comes back
    once, repeated keys and urls too. Rules and listed hosts that are null or empty are left out, a null path is an
    empty one. An empty table gives no rows; empty lists allow everything. Other columns are left behind.
    """
    rules = rules.where("host is not null and host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    listed = listed.where("host is not null and host <> ''").select("host").distinct()
    labels = lambda host: F.size(F.split(host, r"\."))
    # how many labels, and how long a path: as many pairs as the lists have shapes, whatever their length
    shapes = rules.select(labels(F.col("host")).alias("m"), F.length("path").alias("p")).distinct().collect()
    depths = listed.select(labels(F.col("host")).alias("m")).distinct().collect()
    host, path = split_url(F.col(url))
    rows = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    tail = lambda m: F.substring_index("host", ".", -m)
    asked = [F.when(F.length("path") >= s["p"], F.concat(F.lit("rule "), tail(s["m"]), F.lit("#"), F.substr(F.col("path"), F.lit(1), F.lit(s["p"])))) for s in shapes]
    asked += [F.concat(F.lit("host "), tail(d["m"])) for d in depths]
    asked = [F.when(F.col("host") != "", a) for a in asked]
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__keys", F.array_distinct(F.array_compact(F.array(*asked))) if asked else none)
    universe = rows.select(F.explode("__keys").alias("k"))
    # no host or path of a url has a number sign
    rule_key = F.concat(F.lit("rule "), F.col("host"), F.lit("#"), F.col("path"))
    ours = rules.select(rule_key.alias("k")).union(listed.select(F.concat(F.lit("host "), F.col("host"))))
    found = contains(rows, "__keys", "__in", ours, universe, part_keys=part_keys)
    found = found.withColumn("__keys", F.transform(F.filter(F.arrays_zip("__keys", "__in"), lambda x: x["__in"]), lambda x: x["__keys"]))
    # of the listed keys, those that block: the universe is the list
    blocking = rules.where("verdict = 'block'").select(rule_key.alias("k"))
    found = contains(found, "__keys", "__blocks", blocking, ours, part_keys=part_keys)
    hits = F.filter(F.arrays_zip("__keys", "__blocks"), lambda x: x["__keys"].startswith("rule "))
    best = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["__keys"]).alias("n"), F.replace(F.substr(x["__keys"], F.lit(6)), F.lit("#"), F.lit("")).alias("rule"), x["__blocks"].alias("blocks"))))
    on_list = F.exists("__keys", lambda k: k.startswith("host "))
    judged = found.withColumn("__best", best)
    blocks = F.coalesce(F.col("__best.blocks"), on_list)
    return judged.select(F.col(key), "host", "path", F.col("__best.rule").alias("rule"), F.when(blocks, "block").otherwise("allow").alias("verdict"))
