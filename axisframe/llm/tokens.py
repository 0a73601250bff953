"""Token-ID output: Parquet lists with dictionary or delta encoding, fixed row groups and page indexes.

Documents are encoded in order, one file per range of the order. A file row has the document's id, its number of
tokens, where it starts in its range, and the list of ids. Readers of the small columns never touch the ids, and
the row groups' and pages' statistics lead a reader of some documents to their pages alone.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axisframe.llm.common import written

#: Encoded words of a worker's memory; beyond it, a new one starts and the last is kept beside it.
_KEPT_WORDS = 250_000
_KEPT_BYTES = 48
_TOKENIZERS: dict = {}

#: How the files are laid out. Ids have few values: a dictionary. The other columns run on: deltas.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def _byte_letters() -> dict[int, str]:
    """The tokenizer's letter for each byte: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()
#: Western letters and at most ASCII signs behind them: two pieces, whose lower case is plain. Apostrophes begin pieces of
#: their own, and < and | special tokens.
_SIMPLE = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@\\[-`{}~]*)")


#: Texts that tell a tokenizer of words from others: blanks, case, accents, marks, digits, joined words, specials.
_PROBES = [
    " leading and  double \t blanks\n\nand lines ",
    "Upper CASE McMixed ÀÉÎÕÜ straße ñandú İstanbul",
    "commas, stops... don't 'S we'll (brackets) [x] {y} <z> a-b a_b a/b",
    "12.5% 1,000,000 3rd x2 2x 007 v1.2.3 2024-01-01T00:00:00Z",
    "漢字 かな 한국어 العربية हिन्दी \U0001f600\U0001f468\u200d\U0001f469 e\u0301 \u00a0nbsp \u2028 line",
    "supercalifragilisticexpialidocious internationalisation antidisestablishmentarianism",
    "def f(x): return x**2  # code\n\tif a!=b: c+=1;",
    "<|endoftext|> <s> </s> [CLS] [SEP] <unk> <pad>",
    "what?! 50%%% yes*** a$$$ so... é;;: b)) c-- d__ e~~ f\"\" g>> h== i]] j}} k@@ l## m&& n++ o// p`` q^^ r\\\\ s,*** t:-)",
    "https://example.org/a?b=c&d=e user@example.org @name #tag $5 €7 ...",
    "",
]


class _Words(dict):
    """Encoded words: a word that is not there is encoded on the way.

    Of ``_KEPT_WORDS`` a new start is made, with the last words beside it; long words are kept for one call alone.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before, self.long = encode, {}, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > _KEPT_BYTES:
            if word not in self.long:
                self.long[word] = self.encode(word)
            return self.long[word]
        if (ids := self.before.get(word)) is None:
            ids = self.encode(word)
        if len(self) >= _KEPT_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes whole texts word by word with memory of the words seen.

    A tokenizer that drops white space and never joins across it gives a text's ids as its words' ids in turn. Words of
    letters then go straight to its merges, other words through the whole tokenizer. Whether a tokenizer is of this
    kind is tried on texts of many kinds when it is loaded; any other encodes whole texts by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Words(self.word)
        self.pieces: dict[str, bytes] = {}
        self.by_words = False
        self.by_words = all(self._by_words([t])[0] == self.whole(t) for t in _PROBES)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else "".join([_LETTER[b] for b in text.encode()])
        return struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := self.model.tokenize(letters)) else b""

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "surrogatepass")
        if simple := _SIMPLE.fullmatch(text):
            head, tail = simple.groups()
            out = self.piece(head.lower())
            if tail:
                if tail not in self.pieces:
                    self.pieces[tail] = self.piece(tail) if len(tail) < 9 else b""
                out += self.pieces[tail] or self.piece(tail)
            return out
        return self.whole(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self._by_words(texts) if self.by_words else [self.whole(t) for t in texts]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        out, ids = [], self.known.__getitem__
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            # lower case is what the tokenizer makes of A-Z anyway; its special tokens are told by their case
            out.append(b"".join(map(ids, (raw if b"<|" in raw else raw.lower()).split())))
        self.known.long.clear()
        return out


def _encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, order: list[Column] | None = None, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 32 << 20) -> None:
    """Encode whole texts and write them to ``path`` in ascending ``order`` (doc_id by default, nulls first).

    Each text's ids are followed by ``end_id``; a null or empty text is that id alone. Rows of equal order are put
    in the order of their text's hash, so repeated rows stay neighbours and a hot id is cut between files. An empty
    table gives an empty folder of files. Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    keys = order or [F.col(doc_id)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    names = [f"k{i}" for i in range(len(keys))]
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(max(1, -(-size // part_bytes)), *names, "tie").sortWithinPartitions(*names, "tie", "text")
    schema = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"

    def run(batches):
        encoder, start = _encoder(tokenizer), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                ids = [x + end for x in encoder.ids(piece.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), pa.array(start + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])

    dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``, the number of ids before the document: doc_id, part, start, n_tokens, ids."""
    rows = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a written table's size is known before the join is planned: while it is small, the ids stay where they are
    parts = written(parts, "token-parts")
    return rows.join(parts, F.col("part") == F.col("p")).select("doc_id", "part", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_slice(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """The ids of documents first_id..last_id, from their pages alone."""
    return spark.read.parquet(path).where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as read back."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)) * 4
            starts = np.concatenate(([0], ends[:-1]))
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
