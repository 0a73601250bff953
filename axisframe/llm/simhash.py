"""SimHash near-duplicates by pivot distance tables.

Fingerprints that differ in few bits agree in some of their bit ranges, which deals them into small groups. In a
group, each fingerprint has a row of its Hamming distances to many reference fingerprints (the pivots). By the
triangle inequality no pivot tells two fingerprints further apart than they are, so pairs with a larger difference in
any coordinate are discarded; the pairs that survive are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.llm import nearcopies
from axisframe.llm.common import free_name, passing, written
from axisframe.llm.graph import components

SEED = 42
_BLOCK = 1 << 16
#: Reference fingerprints: fixed, spread over all 64-bit numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(24)], dtype=np.uint64)
#: Six ranges of bits: three differing bits leave three ranges alike, so twenty choices of three find every pair.
_RANGES = (11, 11, 11, 11, 10, 10)
#: Groups beyond this are cut into tiles that are compared two by two.
TILE = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text: lower-cased A-Z, words by ASCII white space, shingles of ``width`` words."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _BLOCK):
        part = words[low : min(n, low + _BLOCK) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document, the fingerprint as a signed long. Null and wordless texts have 0."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["t"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["d"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, fp long")


def _keyed_fingerprints(docs: DataFrame, row, doc_id: str, text: str) -> DataFrame:
    """(k, doc_id, fp): fingerprints beside a row's key."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["t"]], dtype=np.uint64)
            yield pd.DataFrame({"k": pdf["k"], "doc_id": pdf["d"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select(row.alias("k"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(run, "k long, doc_id long, fp long")


def _masks() -> list[int]:
    ends = np.cumsum(_RANGES)
    ranges = [((1 << int(w)) - 1) << int(e - w) for w, e in zip(_RANGES, ends, strict=True)]
    return [int(np.array([a | b | c], dtype=np.uint64).view(np.int64)[0]) for a, b, c in combinations(ranges, 3)]


def _close(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs differ in at most ``bits`` bits: pivots first, then the survivors' own bits."""
    alive = np.arange(len(x))
    for p in PIVOTS[:8]:  # pair by pair, a few pivots discard as much as the check itself costs
        apart = np.abs(np.bitwise_count(x[alive] ^ p).astype(np.int8) - np.bitwise_count(y[alive] ^ p).astype(np.int8))
        alive = alive[apart <= bits]
    return alive[np.bitwise_count(x[alive] ^ y[alive]) <= bits]


def linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: pairs of positions."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    label, edges = np.arange(n), []
    for low in range(0, n, 256):
        rows = slice(low, min(n, low + 256))
        end = np.searchsorted(table[:, 0], table[rows, 0].max() + bits, side="right")
        near = label[rows][:, None] != label[None, low:end]
        for p in range(len(PIVOTS)):
            near &= np.abs(table[rows, p][:, None] - table[None, low:end, p]) <= bits
            if not near.any():
                break
        i, j = np.nonzero(near)
        sure = np.bitwise_count(fps[low + i] ^ fps[low + j]) <= bits
        i, j = low + i[sure], low + j[sure]
        starts = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(i)][: len(starts)], strict=True):
            me = i[a]
            for other in j[a:b][np.unique(label[j[a:b]], return_index=True)[1]]:
                if label[other] != label[me]:
                    edges.append((int(order[me]), int(order[other])))
                    label[label == label[other]] = label[me]
    return edges


def _links(keyed: DataFrame, bits: int) -> DataFrame:
    """Spanning links of each (t, k, tile_a, tile_b) group; groups lie whole and sorted in a partition."""

    def run(batches):
        held = np.zeros((0, 5), dtype=np.int64)

        def found(rows: np.ndarray) -> pd.DataFrame:
            edge = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
            starts = np.concatenate(([0], edge)) if len(rows) else edge
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            fps = rows[:, 4].astype(np.int64).view(np.uint64)
            two = starts[sizes == 2]
            good = two[_close(fps[two], fps[two + 1], bits)]
            a, b = [fps[good]], [fps[good + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = fps[s : s + n]
                pairs = np.array(linked(own, bits), dtype=np.int64).reshape(-1, 2)
                a.append(own[pairs[:, 0]])
                b.append(own[pairs[:, 1]])
            return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        for pdf in batches:
            rows = np.concatenate((held, pdf.to_numpy(dtype=np.int64)))
            change = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            yield found(rows[:cut])
            held = rows[cut:]
        yield found(held)

    return keyed.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at ``bits`` or fewer bits, transitively.

    ``component_id`` is the smallest doc_id reachable. Equal fingerprints are one node, so copies cost no pairs, and
    a group gives a spanning forest of its links, not all of them; no link between different texts is lost. Null,
    empty and wordless texts have fingerprint 0 and link like any other. Rows without an id are answered too, but
    never name a component. Repeated rows are each answered. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, doc_id=doc_id, text=text), "fingerprints")
    nodes, roots = _roots(prints, bits)
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    classes = named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(written(classes, "classes"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def _roots(prints: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(fp, least) of the distinct fingerprints, and (node, root) of those that link."""
    if not 0 <= bits <= 3:
        raise ValueError("bits is 0 to 3")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("t", "k"))
    hot = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    hot = written(hot.select(F.col("t").alias("ht"), F.col("k").alias("hk"), F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("tiles")), "hot-keys")
    known = keys.join(hot, (F.col("t") == F.col("ht")) & (F.col("k") == F.col("hk")), "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    tiled = known.select("t", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"), "fp")
    columns = ["t", "k", "tile_a", "tile_b"]
    paired = tiled.select("t", "k", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), "fp")
    dealt = paired.repartition(*columns).sortWithinPartitions(*columns)
    return nodes, written(components(_links(dealt, bits)), "roots")


def deduplicate(docs: DataFrame, *, bits: int = 3, similarity: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of least id, rows without an id last, then of least text hash.

    Groups are linked by fingerprints of three-word shingles at ``bits`` or fewer bits or, with ``similarity=0.8``, by
    five-word shingle sets of at least that Jaccard similarity (``nearcopies``). Rows are told apart by id and text,
    so a row goes only for another of its own group, and of rows that repeat one stays. Null, empty and wordless
    texts are one group. An empty table gives no rows; columns of any name pass through.
    """
    if similarity not in (None, 0.8):
        raise ValueError("similarity is 0.8")
    key, nth, stays, copies = (free_name(docs, stem=s) for s in ("row_key", "nth", "stays", "copies"))
    row = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    with passing(docs.sparkSession):
        if similarity is None:
            prints = written(_keyed_fingerprints(docs, row, doc_id, text), "fingerprints")
            nodes, roots = _roots(prints, bits)
            counted = prints.groupBy("k", F.col("doc_id").alias("d"), "fp").agg(F.count(F.lit(1)).alias("copies"))
            groups = counted.join(nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root")), F.col("fp") == F.col("f"))
            keep = groups.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("nameless"), "d", "k", "copies")).alias("least"))
        else:
            keep = nearcopies.near_copies(docs, doc_id=doc_id, text=text).groupBy("root").agg(F.min("least").alias("least"))
        keep = written(keep.select(F.col("least.k").alias(stays), F.col("least.copies").alias(copies)), "kept", stays=True)
    rows, met = docs.withColumn(key, row), F.col(key) == F.col(stays)
    # only rows that repeat meet their like; the others stay where they are
    single = rows.join(keep.where(F.col(copies) == 1), met, "left_semi").drop(key)
    several = rows.join(keep.where(F.col(copies) > 1), met, "left_semi")
    several = several.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1).drop(nth, key)
    return single.unionByName(several)


def digest(found: DataFrame) -> DataFrame:
    """The reported columns, the fingerprint as 16 hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
