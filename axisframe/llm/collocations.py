"""Phrase collocations: word sequences that stand together more often than their parts explain.

Phrases are named level by level. A word that is frequent in its language has an id; two neighbouring ids of words make
a pair, and a frequent pair has an id; two neighbouring pairs that share their middle make a phrase of three words; and
so on. A phrase's id is the place that first bears it, and its two parts are its parents: prefixes and suffixes for
the cuts, and the phrases that a longer one covers, are found by following them.

Occurrences stay where they are, in chunks of texts of one language whose words are coded chunk by chunk. What is
shuffled is each chunk's distinct words or pairs with their counts, and the chunks themselves once a level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.llm.common import written

#: Words of a chunk, and bytes of a long text that are taken at once.
CHUNK_WORDS = 1 << 21
SEGMENT_BYTES = 1 << 22
#: A place: the partition and the chunk's number in it (together the chunk), and the number inside the chunk.
_INSIDE_BITS, _NUMBER_BITS = 24, 17
#: Ends of pieces become this byte, which no text has; capitals become small, and tabs blanks.
_END = b"\xff"
_CLASSES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
#: Parts of a language's phrases that are ranked on their own before their first ones meet.
_SALTS = 256


class _Codes(dict):
    """A number for each word, in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class _Chunk:
    """Words of one language, as codes; the first ``context`` of them are counted by the chunk before."""

    def __init__(self, context: list[bytes] = ()):
        self.codes, self.parts, self.size, self.context = _Codes(), [], 0, len(context)
        self.add(context)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def last(self, count: int) -> list[bytes]:
        words = list(self.codes)
        return [words[c] for c in np.concatenate(self.parts)[-count:].tolist()] if count else []


def _segments(text: str, size: int):
    """The text's words and ends of pieces, in lists that each end where a word does."""
    raw, low = text.encode().translate(_CLASSES), 0
    while low < len(raw):
        high = raw.find(b" ", low + size)
        high = len(raw) if high < 0 else high
        yield raw[low:high].replace(_END, b" " + _END + b" ").split()
        low = high


def chunks(docs: DataFrame, *, context: int, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The texts as coded chunks, written to the shared folder: chunk, lang, context, codes (compressed), words, counts.

    ``words`` and ``counts`` are the chunk's own dictionary, from code 1 on. A text that goes over a chunk's end is
    taken up by the next one with the last ``context`` words before it.
    """

    def run(batches):
        pack, open_chunks, number = zstandard.ZstdCompressor(level=3), {}, 0

        def given(part: int, name: str, chunk: _Chunk) -> pa.RecordBatch:
            nonlocal number
            if number >> _NUMBER_BITS:
                raise ValueError("too many chunks in one partition")
            codes = np.concatenate(chunk.parts)
            counts = np.bincount(codes[chunk.context :], minlength=len(chunk.codes))[1:]
            words = pa.array(list(chunk.codes)[1:], pa.binary()).cast(pa.string())
            at, number = (part << _NUMBER_BITS) + number, number + 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([name]), pa.array([chunk.context], pa.int32()), pa.array([pack.compress(codes.tobytes())]), *lists], names=["chunk", "lang", "context", "codes", "words", "counts"])

        part = 0
        for batch in batches:
            for part, name, body in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "text")), strict=True):
                if name not in open_chunks:
                    open_chunks[name] = _Chunk()
                for words in _segments(body, segment_bytes):
                    open_chunks[name].add(words)
                    if open_chunks[name].size >= chunk_words:
                        yield given(part, name, open_chunks[name])
                        open_chunks[name] = _Chunk(open_chunks[name].last(context))
                open_chunks[name].add([_END])
                if sum(c.size for c in open_chunks.values()) >= 2 * chunk_words:  # many languages side by side
                    for other in list(open_chunks):
                        yield given(part, other, open_chunks.pop(other))
        for name, chunk in open_chunks.items():
            yield given(part, name, chunk)

    rows = docs.select(F.spark_partition_id().alias("part"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "chunk long, lang string, context int, codes binary, words array<string>, counts array<long>"), "chunks")


def _named(rows: DataFrame, parts: list[str], min_count: int, last: bool = False) -> DataFrame:
    """Chunks' phrases with their counts over all chunks, where those reach ``min_count``: chunk, inside, id, f, parts.

    The parts stand on the one row a phrase whose place is its id. ``last``: these rows alone.
    """
    if last:
        return rows.groupBy(*parts).agg(F.sum("n").alias("f"), F.min("at").alias("id")).where(F.col("f") >= min_count)
    every = Window.partitionBy(*parts)
    found = rows.withColumn("f", F.sum("n").over(every)).withColumn("id", F.min("at").over(every)).where(F.col("f") >= min_count)
    own = F.col("at") == F.col("id")
    inside = F.col("at").bitwiseAND((1 << _INSIDE_BITS) - 1).cast("int").alias("inside")
    return written(found.select(F.shiftright("at", _INSIDE_BITS).alias("chunk"), inside, "id", "f", own.alias("own"), *[F.when(own, F.col(c)).alias(c) for c in parts]), "phrases")


def _neighbours(level: int):
    """The function that gives a chunk's neighbouring pairs of phrases of ``level - 1`` words: left, right, at, n."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        chunk, context = (left.column(c)[0].as_py() for c in ("chunk", "context"))
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("codes")[0].as_py()), np.int32)
        levels, inside, ids = (right.column(c).to_numpy() for c in ("level", "inside", "id"))
        # phrases are numbered in order of their places, not of the rows, which come as the shuffle brings them
        order = np.argsort(inside, kind="stable")
        here = {at: order[levels[order] == at] for at in range(1, level)}
        # the phrase that starts at each place, as a number among the chunk's own; -1 where it is rare
        names, uniques = codes, None
        for at in range(1, level):
            own = here[at]
            number = np.full((int(codes.max()) + 1 if uniques is None else len(uniques)) + 1, -1, np.int64)
            number[inside[own]] = np.arange(len(own))
            names = number[names]  # -1 finds the -1 at the end
            width = max(1, len(own))
            both = (names[:-1] >= 0) & (names[1:] >= 0)
            keys = np.where(both, names[:-1] * width + names[1:], -1)
            uniques, counts = np.unique(keys[both], return_counts=True)
            if at + 1 < level:
                places = np.full(len(keys), -1, np.int64)
                places[both] = np.searchsorted(uniques, keys[both])
                names = places
        early = keys[: max(0, context - level + 1)]  # whole inside what the chunk before counts
        np.subtract.at(counts, np.searchsorted(uniques, early[early >= 0]), 1)
        found = ids[here[level - 1]]
        at = (chunk << _INSIDE_BITS) + np.arange(len(uniques))
        return pa.table([found[uniques // width], found[uniques % width], at, counts], schema=kinds)

    return run


def phrases(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS, segment_bytes: int = SEGMENT_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to ``max_words`` words, a table for each length, and each language's words (lang, n).

    Words: id, f, lang, word. Longer phrases: id, f, left, right: the ids of the phrases without the last and without
    the first word.
    """
    coded = chunks(docs, context=max_words - 1, text=text, lang=lang, chunk_words=chunk_words, segment_bytes=segment_bytes)
    place = F.shiftleft("chunk", _INSIDE_BITS)
    own = coded.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    words = own.select((place + F.col("code") + 1).alias("at"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = written(coded.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    found = _named(words, ["lang", "word"], min_count)
    names = found.select("chunk", F.lit(1).alias("level"), "inside", "id")
    tables = [found.where("own").select("id", "f", "lang", "word")]
    texts = coded.select("chunk", "context", "codes")
    for level in range(2, max_words + 1):
        pairs = texts.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(_neighbours(level), "left long, right long, at long, n long")
        found = _named(pairs, ["left", "right"], min_count, last=level == max_words)
        if level < max_words:
            names = names.union(found.select("chunk", F.lit(level).alias("level"), "inside", "id"))
            tables.append(found.where("own").select("id", "f", "left", "right"))
        else:
            tables.append(written(found, "phrases").select("id", "f", "left", "right"))
    return tables, totals


def collocations(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, covered: int = 50, scale: int = 1_000_000, text: str = "text", lang: str = "lang", chunk_words: int = CHUNK_WORDS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Every candidate that no longer one covers: lang, phrase, a, l, r, n, score.

    Texts' A-Z are lower-cased, ``[.,;:!?\\x0A-\\x0D]`` ends a piece, and words are what blanks and tabs part. Candidates
    are phrases of 2 to ``max_words`` words that stand ``a`` times, ``min_count`` at least, in a language's pieces,
    overlaps included. Of the cuts into a first part (l times) and the rest (r times) the one of the least
    floor(scale * a * a / (l * r)) counts, ties to the shortest first part. A candidate goes where a longer one that
    holds it stands ``covered`` hundredths as often at least. n: the language's words.

    A null text has no words, a null language is ``und``; rows that repeat count as often as they come. An empty table
    gives no rows. Other columns are left behind. Counts may reach 10^15: numbers are exact.
    """
    tables, totals = phrases(docs, max_words=max_words, min_count=min_count, text=text, lang=lang, chunk_words=chunk_words, segment_bytes=segment_bytes)
    # fronts and backs: how often the first and the last 1, 2, ... words stand
    known = tables[0].select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("ending"), F.array("f").alias("fronts"), F.array("f").alias("backs"))
    out = None
    for level in range(2, max_words + 1):
        table = tables[level - 1]
        first = known.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("before"), "fronts")
        rest = known.select(F.col("id").alias("right"), "ending", "backs")
        known = table.join(first, "left").join(rest, "right").select("id", "f", "lang", F.concat_ws(" ", "before", "ending").alias("phrase"), "ending", F.concat("fronts", F.array("f")).alias("fronts"), F.concat("backs", F.array("f")).alias("backs"))
        if level < max_words:
            known = written(known, "phrases")
        number = "cast({} as decimal(38, 0))"
        product = f"{number.format(scale)} * ({number.format('f')} * {number.format('f')}) div ({number.format('fronts[k - 1]')} * {number.format(f'backs[{level} - k - 1]')})"
        cut = F.expr(f"array_min(transform(sequence(1, {level - 1}), k -> struct({product} as score, k as k, fronts[k - 1] as l, backs[{level} - k - 1] as r)))")
        kept = known
        if level < max_words:
            over = tables[level]
            above = over.select(F.col("left").alias("id"), "f").union(over.select("right", "f")).groupBy("id").agg(F.max("f").alias("above"))
            kept = known.join(above, "id", "left").where(F.coalesce(F.col("above") * 100 < F.col("f") * covered, F.lit(True)))
        rows = kept.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut"))
        out = rows if out is None else out.union(rows)
    return out.join(F.broadcast(totals) if totals.count() < 100_000 else totals, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def ranked(found: DataFrame, first: int = 2000) -> DataFrame:
    """Each language's ``first`` rows by score, then a, both descending, then phrase: lang, rank, phrase, a, l, r, n, score."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
