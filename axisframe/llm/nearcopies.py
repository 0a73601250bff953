"""The near-duplicate operator for a similarity of word shingles: fingerprints and pivot tables, then the sets themselves.

Two sets with a Jaccard similarity of 4/5 or more share a member among the first n // 5 + 1 of each, in any order
common to all, so documents meet in blocks by those members. The order puts members of rarely hit hash slots first:
common lines seldom bring documents together. In a block, each fingerprint has its Hamming distances to reference
fingerprints (fixed pivots, and the member nearest to the block's majority); pairs of larger sets with a larger
difference in any coordinate than ``BITS`` are discarded, survivors are verified bit by bit, and these and all pairs
of small sets by their whole shingle sets. Before whole sets are brought together, their parity sketches are: sets that
differ in few members have sketches that differ in as few bits, so this loses no pair.

Links are sought in three steps, so that a large group costs little more than its size: first each block's stars of
some hubs and neighbours along the pivot coordinates; then, in blocks that these links leave in several components,
each left-out document's nearest in the largest component; at last every pair that is still apart.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm.common import passing, written
from axisframe.llm.graph import components

WIDTH = 5
#: Fingerprints of large sets with a similarity of 4/5 differ in 10 of 64 bits on average, with a standard deviation of
#: 2.9; more than 32 bits are 7.8 of them, about one pair in 10^11 at the very limit.
BITS = 32
#: Sets of up to so many shingles are not judged by their fingerprints, which few shingles decide.
SMALL = 64
#: Members of a block that every other is compared with first.
HUBS = 4
#: Blocks beyond this are cut into tiles; in the last step tiles are compared two by two.
TILE = 4096
#: Rows of an Arrow batch where each carries a whole text or one or two whole shingle sets.
BATCH_ROWS = 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS, _BLOCKS = 18, 16
#: Reference fingerprints besides those of a block: fixed, spread over all 64-bit numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(8)], dtype=np.uint64)


@contextmanager
def _small_batches(spark: SparkSession):
    """Jobs run inside pass at most ``BATCH_ROWS`` rows at once between the JVM and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS if int(before) <= 0 else min(int(before), BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of each five words; a text of fewer words is one shingle, a wordless one has none."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h = h * _BASE + w[j : j + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes: a bit is 1 if set in over half of them (an empty set has 0)."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]


def sketch(h: np.ndarray) -> np.ndarray:
    """Of each residue of the set's hashes whether an odd number has it: a bit for each member at least, a power of two."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Two sets differ in so many members or more: each turns one bit of their sketches, the longer folded to the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _slot_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many shingles of the texts fall in each hash slot. Its size is fixed; it decides on order alone."""

    def count(batches):
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total += np.bincount(_slots(shingles(t)), minlength=len(total)) if t and len(t) > 1 << 20 else 0
            short = [shingles(t) for t in pdf["t"] if t and len(t) <= 1 << 20]
            if short:
                total += np.bincount(_slots(np.concatenate(short)), minlength=len(total))
        yield pd.DataFrame({"block": range(_BLOCKS), "counts": [x.astype(np.int64).tobytes() for x in np.split(total, _BLOCKS)]})

    def add(pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    out = np.zeros((_BLOCKS, (1 << _SLOT_BITS) // _BLOCKS), np.int32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def _prints(keyed: DataFrame, counts) -> DataFrame:
    """(k, d, s, n, fp, prefix, sketch): s names the shingle set, n is its size, prefix its first n // 5 + 1 members in order."""

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf["t"]:
                h = shingles(t)
                first = h[np.lexsort((h, counts.value[_slots(h)]))[: len(h) // 5 + 1]]
                out.append((np.array(xxhash.xxh64_intdigest(h.tobytes()), np.uint64).view(np.int64), len(h), set_fingerprint(h), first.tobytes(), sketch(h).tobytes()))
            s, n, fp, prefix, odd = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pd.DataFrame({"k": pdf["k"], "d": pdf["d"].astype("Int64"), "s": np.array(s, np.int64), "n": np.array(n, np.int32), "fp": np.array(fp, np.int64), "prefix": list(prefix), "sketch": list(odd)})

    return keyed.mapInPandas(run, "k long, d long, s long, n int, fp long, prefix binary, sketch binary")


def _members(batches):
    for pdf in batches:
        parts = [np.frombuffer(p, np.int64) for p in pdf["prefix"]]
        sizes = [len(p) for p in parts]
        if not sum(sizes):
            continue
        yield pd.DataFrame({"m": np.concatenate(parts), "s": np.repeat(pdf["s"].to_numpy(), sizes), "at": np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])})


def _sets(batches):
    for pdf in batches:
        yield pd.DataFrame({"s": pdf["s"], "h": [shingles(t).tobytes() for t in pdf["t"]]})


def _perhaps(batches):
    for pdf in batches:
        # of sets with a similarity of 4/5 or more, at most a ninth of both sizes is in one alone
        least = [least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(pdf["qa"], pdf["qb"], strict=True)]
        yield pdf.loc[9 * np.array(least, np.int64) <= pdf["na"] + pdf["nb"], ["a", "b"]]


def _similar(batches):
    for pdf in batches:
        good = []
        for x, y in zip(pdf["ha"], pdf["hb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield pdf.loc[good, ["a", "b"]]


class _Block:
    """The documents of a block and their pivot table."""

    def __init__(self, rows: np.ndarray):
        self.s, self.n, self.at = rows[:, 0], rows[:, 1], rows[:, 2]
        self.fp = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        self.root = rows[:, 4]

    def hubs(self, rows: np.ndarray) -> np.ndarray:
        """The members nearest to the bitwise majority of these, ties by name, so that blocks of one group agree."""
        ones = np.unpackbits(self.fp[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(ones * 2 > len(rows), bitorder="little").view("<u8")[0]
        return rows[np.lexsort((self.s[rows], np.bitwise_count(self.fp[rows] ^ middle)))[:HUBS]]

    def close(self, x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Which pairs may be similar: by sizes and first common member, the pivot table, then the bits."""
        nx, ny = self.n[x], self.n[y]
        left = np.minimum(nx - self.at[x], ny - self.at[y])
        alive = np.flatnonzero((5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (9 * left >= 4 * (nx + ny)) & (self.s[x] != self.s[y]))
        most = np.where(np.minimum(nx, ny) <= SMALL, 64, BITS)
        for p in range(table.shape[1]):
            alive = alive[np.abs(table[x[alive], p] - table[y[alive], p]) <= most[alive]]
        return alive[np.bitwise_count(self.fp[x[alive]] ^ self.fp[y[alive]]) <= most[alive]]

    def table(self, references: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[:, None] ^ references[None, :]).astype(np.int8)

    def pairs(self, x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
        good = self.close(x, y, table)
        return np.stack((self.s[x[good]], self.s[y[good]]), axis=1)

    def star(self) -> np.ndarray:
        """The hubs with every other, and neighbours along the distance to the first hub and along two pivots."""
        everyone = np.arange(len(self.s))
        hubs = self.hubs(everyone)
        table = self.table(np.concatenate((self.fp[hubs[:1]], PIVOTS)))
        x, y = [np.repeat(hubs, len(everyone))], [np.tile(everyone, len(hubs))]
        for p in range(3):
            order = np.lexsort((self.s, self.n, table[:, p]))
            x.append(order[:-1])
            y.append(order[1:])
        return self.pairs(np.concatenate(x), np.concatenate(y), table)

    def nearest(self) -> np.ndarray:
        """Each document out of the largest component with the nearest inside and with the hubs of that component."""
        names, which = np.unique(self.root, return_inverse=True)
        if len(names) < 2:
            return np.zeros((0, 2), np.int64)
        main = which == np.argmax(np.bincount(which))
        inside, out = np.flatnonzero(main), np.flatnonzero(~main)
        hubs = self.hubs(inside)
        table = self.table(np.concatenate((self.fp[hubs[:1]], PIVOTS)))
        x, y = [np.tile(out, len(hubs))], [np.repeat(hubs, len(out))]
        for low in range(0, len(out), 256):
            part = out[low : low + 256]
            n = min(HUBS, len(inside))
            bits = np.bitwise_count(self.fp[part][:, None] ^ self.fp[inside][None, :])
            x.append(np.repeat(part, n))
            y.append(inside[np.argpartition(bits, n - 1, axis=1)[:, :n]].ravel())
        # the left-out ones among themselves, along their distance to the hub
        order = out[np.lexsort((self.s[out], table[out, 0]))]
        x.append(order[:-1])
        y.append(order[1:])
        return self.pairs(np.concatenate(x), np.concatenate(y), table)

    def apart(self) -> np.ndarray:
        """Every pair of different components."""
        table = self.table(np.concatenate((self.fp[self.hubs(np.arange(len(self.s)))[:1]], PIVOTS)))
        order = np.argsort(table[:, 0], kind="stable")
        reach, found = 64 if (self.n <= SMALL).any() else BITS, []
        for low in range(0, len(order), 256):
            rows = order[low : low + 256]
            end = np.searchsorted(table[order, 0], int(table[rows, 0].max()) + reach, side="right")
            i, j = np.nonzero(self.root[rows][:, None] != self.root[order[low:end]][None, :])
            found.append(self.pairs(rows[i], order[low:end][j], table))
        return np.concatenate(found)


def _searched(dealt: DataFrame, how: str) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the blocks (m, x, y); blocks lie whole and sorted in a partition."""
    columns = ["m", "x", "y", "s", "n", "at", "fp", "r"]

    def run(batches):
        held = np.zeros((0, len(columns)), np.int64)

        def found(rows):
            edge = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
            starts = np.concatenate(([0], edge)).astype(np.int64)
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            out = [np.zeros((0, 2), np.int64)]
            if (sizes == 2).any():  # blocks of two, the commonest, are looked at together
                block, two = _Block(rows[:, 3:]), starts[sizes == 2]
                out.append(block.pairs(two, two + 1, block.table(PIVOTS)))
            out += [getattr(_Block(rows[a : a + n, 3:]), how)() for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True)]
            pairs = np.concatenate(out)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for pdf in batches:
            rows = np.concatenate((held, pdf[columns].to_numpy(dtype=np.int64)))
            change = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            yield found(rows[:cut])
            held = rows[cut:]
        yield found(held)

    return dealt.select(*columns).mapInPandas(run, "a long, b long").distinct()


def _tiled(met: DataFrame, two_by_two: bool) -> DataFrame:
    """Blocks dealt out whole, those beyond a tile in tiles (x), or once for each two tiles (x, y)."""
    tiles = F.ceil(F.col("size") / (TILE // 2 if two_by_two else TILE)).cast("int")
    many = F.col("size") > TILE
    own = F.when(many, F.pmod(F.xxhash64("s"), tiles)).otherwise(0).cast("int")
    if two_by_two:
        other = F.explode(F.sequence(F.lit(0), F.when(many, tiles - 1).otherwise(0)))
        each = met.withColumn("own", own).withColumn("other", other)
        met = each.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("own", "other")
    else:
        met = met.withColumns({"x": own, "y": F.lit(0)})
    return met.repartition("m", "x", "y").sortWithinPartitions("m", "x", "y", "s")


def _verified(pairs: DataFrame, nodes: DataFrame, firsts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 4/5 or more.

    Only documents of pairs that their sketches leave are read for their sets, one for each set.
    """
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("s").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"q{end}")), end)
    with _small_batches(keyed.sparkSession):
        pairs = written(pairs.select("a", "b", "na", "nb", "qa", "qb").mapInPandas(_perhaps, "a long, b long"), "perhaps")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    chosen = written(firsts.join(wanted, F.col("s") == F.col("w"), "left_semi"), "chosen")
    sets = keyed.select("k", "t").join(chosen, F.col("k") == F.col("c")).select("s", "t").mapInPandas(_sets, "s long, h binary")
    with _small_batches(keyed.sparkSession):
        sets = written(sets.dropDuplicates(["s"]), "sets")
    one = pairs.join(sets.select(F.col("s").alias("a"), F.col("h").alias("ha")), "a")
    both = one.join(sets.select(F.col("s").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
    with _small_batches(keyed.sparkSession):
        return written(both.mapInPandas(_similar, "a long, b long"), "links")


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """The blocks whose documents the links leave in more than one component ``r``.

    Of blocks of two or three the star has compared every pair.
    """
    met = met.where("size > 3")
    roots = written(components(links), "roots")
    placed = met.drop("r").join(roots, F.col("s") == F.col("node"), "left").withColumn("r", F.coalesce("root", "s")).drop("node", "root")
    mixed = placed.groupBy("m").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select(F.col("m").alias("mm"))
    return written(placed.join(mixed, F.col("m") == F.col("mm"), "left_semi"), "apart")


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(s, least, root): sets linked, transitively, by a Jaccard similarity of 4/5 or more have one root.

    ``s`` names a set of shingles, so exact copies are one node; ``least`` is the least of its rows (those without an
    id last): their id ``d`` and ``k``, a hash of id and text, by which a row is known, and how many rows (``copies``)
    have it. Wordless texts have one set.
    Sets of up to ``SMALL`` shingles lose no link. Of larger ones a pair is lost whose fingerprints differ in more than
    ``BITS`` of 64 bits (at the very limit of similarity about one in 10^11); no other is. Sets and rows go
    by 64-bit hashes. An empty table gives no rows.
    """
    keyed = docs.select(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("k"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    spark = docs.sparkSession
    with passing(spark):
        with _small_batches(spark):
            counts = spark.sparkContext.broadcast(_slot_counts(docs, text))
            prints = written(_prints(keyed, counts), "prints")
        rows = written(prints.groupBy("k", "d", "s").agg(F.count(F.lit(1)).alias("copies")), "rows", stays=True)
        whole = written(prints.select("s", "n", "fp", "prefix", "sketch").dropDuplicates(["s"]), "whole")
        nodes = written(whole.drop("prefix"), "nodes", stays=True)
        members = whole.select("s", "prefix").mapInPandas(_members, "m long, s long, at int")
        sizes = members.groupBy("m").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("m", "mm")
        shared = written(members.join(sizes, F.col("m") == F.col("mm")).drop("mm"), "shared")
        met = written(shared.join(nodes.drop("sketch"), "s").withColumn("r", F.col("s")), "met", stays=True)
    firsts = written(rows.groupBy("s").agg(F.min("k").alias("c")), "firsts")  # copies fold before any join
    tried = written(_searched(_tiled(met, False), "star"), "pairs")
    links = _verified(tried, nodes, firsts, keyed)
    for how in ("nearest", "apart"):
        met = _apart(met, links)
        new = written(_searched(_tiled(met, how == "apart"), how).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_verified(new, nodes, firsts, keyed))
        tried = tried.unionByName(new)
    least = rows.groupBy("s").agg(F.min(F.struct(F.col("d").isNull().alias("nameless"), "d", "k", "copies")).alias("least"))
    return least.join(written(components(links), "roots"), F.col("s") == F.col("node"), "left").select("s", "least", F.coalesce("root", "s").alias("root"))
