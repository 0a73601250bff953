"""Importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features of a text are its words, its word pairs, and the first four, five and six characters of its words, each
kind hashed into bins of its own. The target model is counted on documents labelled good, the raw model on all
documents. A document's log weight is the mean log ratio of its features, times a reference number of features.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import free_name, uniform, written

WORD_BINS, PAIR_BINS, STEM_BINS = 1 << 17, 1 << 16, 1 << 16
STEMS = (4, 5, 6)
BINS = WORD_BINS + PAIR_BINS + STEM_BINS * len(STEMS)
#: A bin counts if its ratio is this far from 1 (as a logarithm) and beyond this many standard deviations of chance.
LEAST_RATIO, LEAST_SD, PRIOR = 0.5, 4.0, 1.0
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_BLANKS = " \t\n\r\x0b\x0c"


def _powers(base: int, chunks: int) -> np.ndarray:
    out = np.full(_CHUNK * (chunks + 1) + 8, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _tables(chunks: int = 1):
    """Kinds of characters (0 blank, 1 of words, 2 other), their lower case, and powers of a base and its inverse."""
    kinds = np.full(65536, 1, np.uint8)
    for i in range(128):
        ch = chr(i)
        kinds[i] = _kind(ch)
    lower = np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(65536)], dtype=np.uint64)
    return kinds, lower, _powers(_BASE, chunks), _powers(pow(_BASE, -1, 1 << 64), chunks)


def _kind(ch: str) -> int:
    return 0 if ch in _BLANKS else 2 if ch.isascii() and not ch.isalnum() and ch != "_" else 1


def _last_word(text: str, low: int, high: int) -> str:
    """The last word of text[low:high] and a blank; nothing if there is none."""
    end = high
    while end > low and text[end - 1] in _BLANKS:
        end -= 1
    at = end
    while at > low and _kind(text[at - 1]) == _kind(text[end - 1]):
        at -= 1
    return text[at:end] + " " if at < end else ""


def _slices(text: str):
    """(slice, carried) of a text: cut at blanks, each slice after the first led by the last word of the one before.

    A slice is some ``_CHUNK`` characters long or, where that many hold no blank, as long as the word. Only the pair
    of a carried word counts again, not the word.
    """
    low, lead = 0, ""
    while len(text) - low > _CHUNK:
        cut = text.rfind(" ", low, low + _CHUNK)
        cut = cut if cut > low else text.find(" ", low + _CHUNK)
        if cut < 0:
            break
        yield lead + text[low:cut], bool(lead)
        lead = _last_word(text, low, cut) or lead
        low = cut + 1
    yield lead + text[low:], bool(lead)


def features(texts: list[str | None]):
    """(bins, whose): the feature bins of the texts and each one's text, some ``_CHUNK`` characters at a time."""
    parts: list[str] = []
    whose: list[int] = []
    led: list[bool] = []
    held = 0
    for i, text in enumerate(texts):
        for part, carried in _slices(text or ""):
            if held + len(part) > _CHUNK and parts:
                yield _bins(parts, whose, led)
                parts, whose, led, held = [], [], [], 0
            parts.append(part)
            whose.append(i)
            led.append(carried)
            held += len(part) + 1
    yield _bins(parts, whose, led)


def _bins(parts: list[str], whose: list[int], led: list[bool]):
    kinds, lower, power, inverse = _tables(max(1, sum(map(len, parts)) // _CHUNK + 1))
    points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(points, 65535)
    kind = kinds[small]
    edge = np.diff(kind, prepend=0, append=0) != 0
    starts = np.flatnonzero(edge[:-1] & (kind != 0))
    ends = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    n = len(points)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, side="right")
    owner = np.array(whose, dtype=np.int64)[part]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * power[:n], out=out[1:])
        return out

    def hashed(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (total[b] - total[a]) * inverse[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    word = hashed(sums(points.astype(np.uint64)), starts, ends)
    # the carried word of a slice was counted in the slice before
    own = ~(np.array(led)[part] & np.concatenate(([True], part[1:] != part[:-1])))
    bins, owners = [word[own] % np.uint64(WORD_BINS)], [owner[own]]
    folded = sums(np.where(points < 65536, lower[small], points))
    for i, size in enumerate(STEMS):
        at = np.flatnonzero((ends - starts >= size) & own)
        bins.append(hashed(folded, starts[at], starts[at] + size) % np.uint64(STEM_BINS) + np.uint64(WORD_BINS + PAIR_BINS + i * STEM_BINS))
        owners.append(owner[at])
    inside = np.flatnonzero(part[:-1] == part[1:])
    pair = ((word[inside] * np.uint64(_BASE) ^ word[inside + 1]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    bins.append(pair % np.uint64(PAIR_BINS) + np.uint64(WORD_BINS))
    owners.append(owner[inside + 1])
    return np.concatenate(bins).astype(np.int64), np.concatenate(owners)


def labelled_sample(labels: DataFrame, rows: int, *, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> dict[int, tuple[bool, bool]]:
    """doc_id -> (good, used to fit) of at most ``rows`` labelled documents, those of smallest hash.

    A document is good if all its labels say quality 1 and none says toxic. Null ids are passed over; a null
    quality or toxic counts as not good.
    """
    good = F.min(F.coalesce((F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(1)) == 0), F.lit(False)))
    each = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("i")).agg(good.alias("good"))
    h = F.xxhash64(F.lit(11), "i")
    return {r.i: (r.good, r.h % 2 == 0) for r in each.withColumn("h", h).orderBy("h", "i").limit(rows).collect()}


def _counts(docs: DataFrame, fit: set[int], doc_id: str, text: str) -> np.ndarray:
    """Counts of each bin in all documents and in those to fit."""
    held = docs.sparkSession.sparkContext.broadcast(fit)

    def run(batches):
        raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for pdf in batches:
            fits = pdf["d"].isin(held.value).to_numpy()
            for bins, whose in features(pdf["t"].tolist()):
                raw += np.bincount(bins, minlength=BINS)
                if fits[whose].any():
                    target += np.bincount(bins[fits[whose]], minlength=BINS)
        at = np.flatnonzero(raw)
        for low in range(0, len(at), 50_000):
            a = at[low : low + 50_000]
            yield pd.DataFrame({"bin": a, "n_raw": raw[a], "n_target": target[a]})

    each = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(run, "bin int, n_raw long, n_target long")
    out = np.zeros((BINS, 2))
    total = each.groupBy("bin").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    found = total.toPandas()  # one row a bin at most
    out[found["bin"].to_numpy(int)] = found[["n_raw", "n_target"]].to_numpy(float)
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log ratio of target and raw model of each bin, 0 where chance explains it."""
    raw, target = counts[:, 0], counts[:, 1]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return np.where((np.abs(target - expected) > LEAST_SD * np.sqrt(expected + 1)) & (np.abs(ratio) > LEAST_RATIO), ratio, 0.0)


def _gumbel(seed: int, *columns: Column) -> Column:
    return -F.log(-F.log(uniform(F.lit(seed), *columns)))


def _scored(docs: DataFrame, ratios, text: str, reference: int, name: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weigh(batches: pd.Series) -> pd.Series:
        total, n = np.zeros(len(batches)), np.zeros(len(batches))
        for bins, whose in features(batches.tolist()):
            total += np.bincount(whose, weights=held.value[bins], minlength=len(total))
            n += np.bincount(whose, minlength=len(total))
        return pd.Series(reference * total / np.maximum(n, 1))

    return docs.withColumn(name, weigh(F.col(text)))


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, label_rows: int = 20_000, reference: int = 2000, seed: int = 97, keys_only: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents with the largest log weight plus Gumbel noise, with ``log_weight`` and ``gumbel_key``.

    The target model is fitted on half of at most ``label_rows`` labelled documents; without ``k``, the other half
    sets the weight that best parts good from bad, and k is the number of documents that reach it. Equal keys stay
    together. A null or empty text has weight 0. Without labels of both kinds every document stays. Repeated rows
    are weighed alike and draw the same noise. Columns of the result's own names are replaced; others pass through.
    ``keys_only`` gives doc_id (long), log_weight and gumbel_key of the chosen alone.
    """
    sample = labelled_sample(labels, label_rows, doc_id=doc_id)
    fit = {i for i, (good, fits) in sample.items() if good and fits}
    ratios = log_ratios(_counts(docs, fit, doc_id, text)) if fit else np.zeros(BINS)
    docs = docs.drop("log_weight", "gumbel_key")
    scored = _scored(docs, ratios.astype(np.float32), text, reference, "log_weight")
    noise = _gumbel(seed, F.col(doc_id), F.xxhash64(F.col(text)))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") + noise)
    scores = scored.select(F.col(doc_id).cast("long").alias("doc_id"), "log_weight", "gumbel_key")
    scores = written(scores, "weights")
    if k is None:
        least = _calibrated(scores, sample)
        k = scores.where(F.col("log_weight") >= least).count()
    cut = _kth_largest(scores, "gumbel_key", k)
    # keys alone are read back; whole documents are weighed again, which costs less than to move or to store them
    return (scores if keys_only else scored).where(F.col("gumbel_key") >= cut if cut is not None else F.lit(False))


def _calibrated(scores: DataFrame, sample: dict[int, tuple[bool, bool]]) -> float:
    """The log weight at which the shares of good documents below and of bad ones above are least in sum."""
    spark = scores.sparkSession
    ids = spark.createDataFrame([(i, g) for i, (g, fits) in sample.items() if not fits], "i long, good boolean")
    # one row a labelled document at most, so the sample's bound holds here too
    rows = scores.join(F.broadcast(ids), F.col("doc_id") == F.col("i")).groupBy("i").agg(F.first("good").alias("good"), F.min("log_weight").alias("w")).collect()
    good, bad = (np.sort([r.w for r in rows if r.good == g]) for g in (True, False))
    if not len(good) or not len(bad):
        return float("-inf")
    marks = np.unique(np.concatenate((good, bad)))
    loss = np.searchsorted(good, marks, "left") / len(good) + 1 - np.searchsorted(bad, marks, "left") / len(bad)
    best = int(np.argmin(loss))
    return float((marks[best] + marks[best - 1]) / 2) if best else float("-inf")


def _kth_largest(frame: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest of a double column, by halving the range between counts until the range holds few values."""
    if k <= 0:
        return None
    low, high = frame.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    above = 0  # rows over ``high``
    while True:
        inside = frame.where(F.col(key).between(low, high))
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low  # neighbouring doubles
        bucket = F.least(F.floor((F.col(key) - low) / width), F.lit(4095))
        counts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
        else:
            return low
        if low == high:
            return low
