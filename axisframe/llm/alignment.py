"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

A text's tokens end at byte offsets. ``token_runs`` gives those ends as events of side 0 or 1, packed as runs (the
offset where a run starts and its ids; an id's bytes are known, so each of its ends is). ``sweep`` deals the runs of
both sides by document, sorts them by offset, and streams them through a machine that holds one open group: where
both sides end at one offset, a group closes. Groups are written in packs of many documents, from which ``links``,
``groups``, ``pair_counts`` and ``scores`` read. No token is a row of its own before an id pair is counted.

A document is a row. Null and empty texts, and texts whose joined tokens are not the text on both sides, have no
tokens. Rows that repeat in id and text come back as often as they came; null and repeated ids are rows like any
other (rows are told apart by id, a 64-bit hash of the text, and the input partition). An empty table gives no rows.
Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import fresh_path, written

#: Ids of a run, and of a side of a pack of documents.
RUN_IDS = 1 << 16
PACK_IDS = 1 << 19
#: Words whose ids a worker remembers; beyond it, a new memory starts and the last is kept beside it.
_KEPT_WORDS = 250_000
_KEPT_CHARACTERS = 48
#: The fixed pattern of byte-level pieces.
_BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, marks and signs whose classes no edition of Unicode has changed for long: engines agree on them.
_SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u203a\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]*")
#: A blank behind white space: no word ends there for certain.
_BLANKS = re.compile(r"[\s\u180e\u200b] ")
#: Texts that tell tokenizers that can be taken word by word from others.
_PROBES = [
    "plain words, with stops. And (more) of them!",
    "Ünïcode naïve straße ñ 漢字 かな \U0001f600 é x y   z",
    "it's we'll 'quoted' don't 'S 12.5% 1,000 2x x2 a_b a-b",
    "line one\nline two\n\nline\tthree",
    "<|endoftext|> <s> </s> <unk> <0x41> [CLS]",
    "trailing",
    "supercalifragilistic internationalisation 0123456789012345678901234567890",
]


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Coder:
    """What the coders share: whole texts, taken word by word with memory of the words seen.

    ``encode`` gives texts' ids, ``bytes`` each id's bytes. ``by_words``: a text's ids are its words' ids in turn, where
    a word starts at each blank that stands behind no white space. It is tried on the probes.
    """

    def __init__(self, by_words: bool):
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.by_words = by_words and all(self._by_words([t], "I")[0] == self.whole(t, "I") is not None for t in _PROBES)
        self.known, self.before = {}, {}

    def packed(self, ids: list[int], raw: bytes, code: str) -> bytes | None:
        """The ids, if their bytes make up ``raw``."""
        spelt = self.bytes
        return array(code, ids).tobytes() if b"".join([spelt[i] for i in ids]) == raw else None

    def whole(self, text: str, code: str) -> bytes | None:
        return self.packed(self.encode([text])[0], b" " + text.encode(), code)

    def ids(self, texts: list[str], code: str) -> list[bytes | None]:
        """Each text's ids, as integers of the type ``code``; None where their bytes are not the blank and the text."""
        if not self.by_words:
            return [self.whole(t, code) for t in texts]
        plain = [t for t in texts if not _BLANKS.search(" " + t)]
        found = dict(zip(plain, self._by_words(plain, code), strict=True))
        return [x if (x := found.get(t)) is not None else self.whole(t, code) for t in texts]

    def _by_words(self, texts: list[str], code: str) -> list[bytes | None]:
        split, odd = [t.split(" ") for t in texts], set()
        new = list(set().union(*split).difference(self.known))
        known, before = self.known, self.before
        fresh = [w for w in new if w not in before]
        known.update((w, before[w]) for w in new if w in before)
        for w, ids in zip(fresh, self.encode(fresh), strict=True):
            if (packed := self.packed(ids, b" " + w.encode(), code)) is None:
                odd.add(w)
            known[w] = packed or b""
        out = [None if odd and not odd.isdisjoint(words) else b"".join(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > _KEPT_CHARACTERS or w in odd:
                del known[w]
        if len(known) > _KEPT_WORDS:
            self.before, self.known = known, {}
        return out


class ByteLevel(_Coder):
    """A byte-level tokenizer file; a blank is put before the text.

    Texts of long-settled letters go through a faster engine that is given the file's own vocabulary, if its merges
    are its ids in turn and the two agree on the probes; all others go through the file's library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, names = _byte_of_letter(), self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, at in names.items():
            self.bytes[at] = name.encode() if name in special else bytes([letters[c] for c in name])
        kinds = json.loads(self.tokenizer.to_str())
        merges = [m if isinstance(m, str) else " ".join(m) for m in kinds["model"]["merges"]]
        plain = kinds["normalizer"] is None and (kinds["pre_tokenizer"] or {}) | {"trim_offsets": 0} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": 0}
        self.fast = None
        if plain and [names[m.replace(" ", "")] for m in merges] == list(range(256, 256 + len(merges))):
            ranks = {self.bytes[at]: at for name, at in names.items() if name not in special}
            self.fast = Encoding("file", pat_str=_BYTE_LEVEL_PIECES, mergeable_ranks=ranks, special_tokens={})
            if self.encode(_PROBES) != [self.slow(t) for t in _PROBES]:
                self.fast = None
        super().__init__(plain)

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [self.slow(t) for t in texts]
        fast, settled = self.fast.encode_ordinary, _SETTLED.fullmatch
        return [fast(" " + t) if t.isascii() or settled(t) else self.slow(t) for t in texts]


class Pieces(_Coder):
    """A sentence-piece model, which puts a blank before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        # no piece reaches over a blank, so none joins two words
        super().__init__(not any("\u2581" in n.lstrip("\u2581") for n in names))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def load(path: str) -> ByteLevel | Pieces:
    """The coder of a tokenizer file: ``.json`` is byte-level, ``.model`` is sentence pieces."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Side:
    """One tokenizer with its ids' lengths and their decimal text."""

    def __init__(self, path: str):
        self.coder = load(path)
        count = len(self.coder.bytes)
        self.code = "H" if count <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.lengths = np.array([len(b) for b in self.coder.bytes], dtype=np.int64)
        if count > 10**7:
            raise ValueError("ids of more than seven digits")
        self.digits = np.array([len(str(i)) for i in range(count)])
        #: an id and a comma in eight bytes
        self.decimal = np.array([f"{i},".encode() for i in range(count)], dtype="S8").view("<u8")

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """Each text's ids; None where their bytes are not the blank and the text."""
        return self.coder.ids(texts, self.code)


_SIDES: dict[str, Side] = {}


def _side(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


_KEY = ("doc_id", "mark", "part")
_RUN_SCHEMA = "doc_id long, mark long, part int, start long, side int, ids binary"


def token_runs(docs: DataFrame, tokenizers: tuple[str, str], *, doc_id: str = "doc_id", text: str = "text", run_ids: int = RUN_IDS) -> DataFrame:
    """The end events of both sides as runs: doc_id, mark, part, start, side, ids (compressed).

    A row without tokens has one run of side -1. A text is encoded whole, its runs hold ``run_ids`` ids at most.
    """

    def run(batches):
        sides, pack = [_side(p) for p in tokenizers], zstandard.ZstdCompressor(level=3)

        def rows(batch):
            for doc, mark, part, *both in zip(*batch, strict=True):
                if not all(both):
                    yield doc, mark, part, -1, -1, b""
                    continue
                for at, (side, raw) in enumerate(zip(sides, both, strict=True)):
                    wide, start = run_ids * side.dtype.itemsize, 0
                    for low in range(0, len(raw), wide):
                        piece = raw[low : low + wide]
                        yield doc, mark, part, start, at, pack.compress(piece)
                        if low + wide < len(raw):
                            start += int(side.lengths[np.frombuffer(piece, side.dtype)].sum())

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                texts = piece.column("text").to_pylist()
                encoded = []
                for side in sides:
                    got = iter(side.ids([t for t in texts if t]))
                    encoded.append([next(got) if t else None for t in texts])
                columns = list(zip(*rows([piece.column(c).to_pylist() for c in _KEY] + encoded), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_KEY, "start", "side", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.spark_partition_id().alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _RUN_SCHEMA)


def _ends(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


class _Ends:
    """The ends of both sides of whole groups, byte by byte: ends are marks, and links the stretches between marks."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sides: list[Side]):
        self.a, self.b = a, b
        a_ends, b_ends = (_ends(x, s.lengths) for x, s in zip((a, b), sides, strict=True))
        self.a_ends = a_ends
        mark = np.zeros(int(a_ends[-1]) if len(a) else 0, dtype=np.uint8)
        mark[a_ends - 1] = 1
        mark[b_ends - 1] += 2
        at = np.flatnonzero(mark)
        marks = mark[at]
        self.ends, ends_a, ends_b = at + 1, (marks & 1).astype(bool), marks >= 2
        self.a_last, self.b_last = ends_b[ends_a], ends_a[ends_b]
        # the tokens of either side over each stretch
        self.a_at, self.b_at = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b

    @property
    def pairs(self) -> np.ndarray:
        return (self.a[self.a_at].astype(np.int64) << 32) | self.b[self.b_at]


def _opened(batch: pa.RecordBatch, row: int, sides: list[Side]) -> _Ends:
    """A pack's ids; a link is a stretch between neighbouring ends: one pair of tokens that overlap."""
    unpack = zstandard.ZstdDecompressor()
    return _Ends(*(np.frombuffer(unpack.decompress(batch.column(c)[row].as_py()), s.dtype) for c, s in zip("ab", sides, strict=True)), sides)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each of the ascending offsets ``a`` is also one of ``b``."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    at = np.searchsorted(b, a)
    return b[np.minimum(at, len(b) - 1)] == a


def group_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, sides: list[Side]) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of whole groups, each closed by a semicolon, and where each group's text ends.

    ``a_last`` and ``b_last`` mark the last token of each group on its side.
    """
    out, sizes = np.zeros(len(a) + len(b), dtype="<u8"), np.zeros(len(a) + len(b), dtype=np.int64)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_ends, b_ends = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_at = np.arange(len(a)) + np.concatenate(([0], b_ends))[a_group]
    b_at = np.arange(len(b)) + a_ends[b_group]
    letters = out.view(np.uint8).reshape(-1, 8)
    for ids, at, last, mark, side in ((a, a_at, a_last, ord("|"), sides[0]), (b, b_at, b_last, ord(";"), sides[1])):
        out[at], sizes[at] = side.decimal[ids], side.digits[ids] + 1
        letters[at[last], side.digits[ids[last]]] = mark
    flat = letters.reshape(-1)
    return flat[flat != 0].tobytes(), np.cumsum(sizes)[b_at[b_last]]


class _Packs:
    """Closed groups of documents in turn, given out in packs."""

    def __init__(self, sides: list[Side]):
        self.sides = sides
        self.pack = zstandard.ZstdCompressor(level=6)
        self.clear()
        self.hash = None

    def clear(self) -> None:
        self.rows, self.a, self.b, self.size = [], [], [], 0

    def add(self, key: tuple, copies: int, block: int, last: bool, at: tuple, a: np.ndarray, b: np.ndarray) -> None:
        """Whole groups of one document; ``at``: offset and tokens of either side before them."""
        self.rows.append((*key, copies, block, last, *at, len(a), len(b)))
        self.a.append(a)
        self.b.append(b)
        self.size += max(len(a), len(b))

    def give(self) -> pa.RecordBatch | None:
        """One row that holds all that was added: arrays by block, and the ids of either side."""
        if not self.rows:
            return None
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint16) for x in (self.a, self.b))
        ends = _Ends(a, b, self.sides)
        text, group_ends = group_text(a, b, ends.a_last, ends.b_last, self.sides)
        columns = list(zip(*self.rows, strict=True))
        n_a, n_b = (np.array(c, dtype=np.int64) for c in columns[-2:])
        groups = np.concatenate(([0], np.cumsum(ends.a_last)))[np.concatenate(([0], np.cumsum(n_a)))]
        cuts, shas, low = np.concatenate(([0], group_ends))[groups], [], 0
        for i, row in enumerate(self.rows):
            block, last, high = row[4], row[5], int(cuts[i + 1])
            if not block:
                self.hash = hashlib.sha256()
            elif high > low:
                self.hash.update(b";")
            self.hash.update(text[low : high - 1] if high > low else b"")
            shas.append(self.hash.hexdigest() if last and (n_a[i] or block) else "")
            low = high
        names = [*_KEY, "copies", "block", "last", "byte_start", "a_start", "b_start", "n_a", "n_b", "n_groups", "groups_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
        columns += [np.diff(groups), shas]
        arrays = [pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]
        ids = [pa.array([self.pack.compress(x.tobytes())], pa.binary()) for x in (a, b)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays + ids, names=[*names, "a", "b"])


_PACK_SCHEMA = ", ".join(
    [f"{c} array<{k}>" for c, k in (("doc_id", "long"), ("mark", "long"), ("part", "int"), ("copies", "long"), ("block", "int"), ("last", "boolean"))]
    + [f"{c} array<long>" for c in ("byte_start", "a_start", "b_start", "n_a", "n_b", "n_groups")]
    + ["groups_sha256 array<string>", "a binary", "b binary"]
)


class _Document:
    """The open document of the sweep: what of either side no group holds yet."""

    def __init__(self, key: tuple):
        self.key, self.copies, self.block = key, 0, 0
        self.parts: tuple[list, list] = ([], [])
        self.seen, self.at = None, (0, 0, 0)

    def take(self, start: int, side: int, ids: np.ndarray | None) -> None:
        if (start, side) == self.seen:  # a row that repeats
            self.copies += start == -1 or (start == 0 and side == 0)
            return
        self.seen = (start, side)
        if start == -1 or (start == 0 and side == 0):
            self.copies = 1
        if ids is not None:
            self.parts[side].append(ids)

    def closed(self, sides: list[Side], last: bool):
        """The groups that both sides have passed; the rest stays."""
        a, b = (np.concatenate(p) if p else np.zeros(0, s.dtype) for p, s in zip(self.parts, sides, strict=True))
        if not last:
            a_ends, b_ends = _ends(a, sides[0].lengths), _ends(b, sides[1].lengths)
            a_last = np.flatnonzero(_shared(a_ends, b_ends))
            if not len(a_last):
                return None
            n = int(a_last[-1]) + 1
            m = int(np.searchsorted(b_ends, a_ends[n - 1])) + 1
            self.parts = ([a[n:]], [b[m:]])
            a, b, width = a[:n], b[:m], int(a_ends[n - 1])
        else:
            self.parts, width = ([], []), 0
        at, self.at = self.at, (self.at[0] + width, self.at[1] + len(a), self.at[2] + len(b))
        self.block += 1
        return self.key, self.copies, self.block - 1, last, at, a, b


def sweep(runs: DataFrame, tokenizers: tuple[str, str], *, pack_ids: int = PACK_IDS) -> DataFrame:
    """The groups of all documents as packs, written to the shared folder.

    A pack's arrays have an entry for each block of whole groups (a document's blocks follow one another), and ``a``
    and ``b`` are the blocks' ids in turn, compressed. The machine's state is the open group, a run of either side at
    most beyond it, and the hash of the document's group text.
    """

    def run(batches):
        sides = [_side(p) for p in tokenizers]
        unpack, packs, open_doc = zstandard.ZstdDecompressor(), _Packs(sides), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KEY, "start", "side", "ids")]
            for *key, start, side, raw in zip(*columns, strict=True):
                key = tuple(key)
                if open_doc is None or open_doc.key != key:
                    if open_doc is not None:
                        packs.add(*open_doc.closed(sides, True))
                    open_doc = _Document(key)
                ids = None if side < 0 else np.frombuffer(unpack.decompress(raw), sides[side].dtype)
                if start > 0 and (start, side) != open_doc.seen and (done := open_doc.closed(sides, False)):
                    packs.add(*done)
                open_doc.take(start, side, ids)
                if packs.size >= pack_ids:
                    yield packs.give()
        if open_doc is not None:
            packs.add(*open_doc.closed(sides, True))
        if (rest := packs.give()) is not None:
            yield rest

    spark = runs.sparkSession
    dealt = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "start", "side")
    path = fresh_path(spark, "alignment")
    dealt.mapInArrow(run, _PACK_SCHEMA).write.option("compression", "none").parquet(path)
    return spark.read.schema(_PACK_SCHEMA).parquet(path)


def _array(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(packs: DataFrame, tokenizers: tuple[str, str], *, held: int = 1 << 20) -> DataFrame:
    """How many links hold each id pair: a, b, n. Tasks count first and pass on at most ``held`` pairs at once."""

    def run(batches):
        sides = [_side(p) for p in tokenizers]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def given():
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                opened, copies = _opened(batch, row, sides), _array(batch, "copies", row)
                pairs = opened.pairs
                more = [np.unique(pairs, return_counts=True)]
                if (copies > 1).any():  # rows that repeat count as often
                    links = _array(batch, "n_a", row) + _array(batch, "n_b", row) - _array(batch, "n_groups", row)
                    stops = np.cumsum(links)
                    more += [(pairs[stops[i] - links[i] : stops[i]], np.full(links[i], copies[i] - 1)) for i in np.flatnonzero(copies > 1)]
                keys, counts = _tally(np.concatenate([keys, *[k for k, _ in more]]), np.concatenate([counts, *[n for _, n in more]]))
                if len(keys) > held:
                    yield given()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield given()

    return packs.select("copies", "n_a", "n_b", "n_groups", "a", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


_SCORED = "doc_id long, mark long, part int, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<a:int,b:int,links:long>>"


def _arrow_scored(kinds: list, rare_kind: pa.DataType) -> pa.Schema:
    names = ["doc_id", "mark", "part", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.schema([*zip(names, kinds, strict=True), ("rare", rare_kind)])


class _Table:
    """Numbers by pair: one slot a hash, commonest pairs first, and a search for pairs whose slot another has."""

    _BITS, _FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.keys, self.numbers = keys, numbers
        self.slots = np.full(1 << self._BITS, -1, np.int64)
        rising = np.argsort(numbers, kind="stable")
        self.slots[self._slot(keys[rising])] = rising

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._FACTOR) >> np.uint64(64 - self._BITS)).view(np.int64)

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's number (1 where it has none), and whether it has one."""
        if not len(self.keys):
            return np.ones(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = self.slots[self._slot(pairs)]
        known = (self.keys[at] == pairs) & (at >= 0)
        if len(late := np.flatnonzero(~known)):
            at[late] = np.minimum(np.searchsorted(self.keys, pairs[late]), len(self.keys) - 1)
            known[late] = self.keys[at[late]] == pairs[late]
        return np.where(known, self.numbers[at], 1), known


def scores(packs: DataFrame, counts: DataFrame, tokenizers: tuple[str, str], *, table_pairs: int = 4_000_000) -> DataFrame:
    """Each document's groups and links, scored by how many links of the corpus hold the same id pair.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its b id), count_sum (of links)
    and groups_sha256. Tasks get the commonest pairs as a table of at most ``table_pairs``; a pair that is in no table
    has one link, or joins its count by a shuffle where pairs of more than one link don't all fit.
    """
    spark = packs.sparkSession
    counts = written(counts, "pair-counts")
    sizes = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("size")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("size")).collect()
    least, held = (1 << 20) + 1, 0
    for size in sizes:  # the commonest pairs, down to a count that still fits
        if size["size"] < 2 or held + size["pairs"] > table_pairs:
            break
        least, held = size["size"], held + size["pairs"]
    rare_left = any(2 <= s["size"] < least for s in sizes)
    rows = counts.where(F.col("n") >= least).toArrow() if held else None
    table = np.zeros((0, 2), np.int64)
    if rows is not None:
        table = np.stack([(rows.column("a").to_numpy().astype(np.int64) << 32) | rows.column("b").to_numpy(), rows.column("n").to_numpy()], axis=1)
        table = table[np.argsort(table[:, 0])]
    highest = counts.groupBy("b").agg(F.max("n").alias("n")).toArrow()  # one row an id of the vocabulary
    best_of = dict(zip(highest.column("b").to_pylist(), highest.column("n").to_pylist(), strict=True))
    shipped = spark.sparkContext.broadcast((np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]), best_of))

    def run(batches):
        sides = [_side(p) for p in tokenizers]
        keys, numbers, best_of = shipped.value
        table = _Table(keys, numbers)
        best = np.zeros(len(sides[1].lengths), np.int64)
        best[list(best_of)] = list(best_of.values())
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string()]
        rare_kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64())]))
        for batch in batches:
            for row in range(batch.num_rows):
                opened = _opened(batch, row, sides)
                pairs, b_ids = opened.pairs, opened.b[opened.b_at]
                n_a, n_b, n_groups = (_array(batch, c, row) for c in ("n_a", "n_b", "n_groups"))
                links = n_a + n_b - n_groups
                count, known = table.find(pairs)
                if rare_left:
                    count[~known] = 0
                starts = np.concatenate(([0], np.cumsum(links)))
                total, good = (np.concatenate(([0], np.cumsum(x)))[starts] for x in (count, (count == best[b_ids]) & (count > 0)))
                rare: list = [None] * len(links)
                if rare_left:
                    for i in range(len(links)):
                        own = pairs[starts[i] : starts[i + 1]][~known[starts[i] : starts[i + 1]]]
                        rare[i] = [{"a": int(k >> 32), "b": int(k & 0xFFFFFFFF), "links": int(c)} for k, c in zip(*np.unique(own, return_counts=True), strict=True)]
                columns = [_array(batch, c, row) for c in ("doc_id", "mark", "part", "copies")]
                columns[0] = batch.column("doc_id")[row].values
                columns += [n_a, n_b, n_groups, links, np.diff(good), np.diff(total), batch.column("groups_sha256")[row].values]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(rare, rare_kind)], schema=_arrow_scored(kinds, rare_kind))

    scored = packs.mapInArrow(run, _SCORED)
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    # a document's blocks meet; of their hashes only the last is not empty
    whole = lambda frame: frame.groupBy(*_KEY, "copies").agg(*[F.sum(c).alias(c) for c in measures], F.max("groups_sha256").alias("groups_sha256"))
    if rare_left:
        scored = written(scored, "alignment-scores")
        top = spark.createDataFrame(list(best_of.items()), "top_b int, top long")
        tail = scored.select(*_KEY, "copies", F.explode("rare").alias("r")).select(*_KEY, "copies", "r.*").join(counts, ["a", "b"]).join(top, F.col("b") == F.col("top_b"))
        late = tail.select(*_KEY, "copies", *[F.lit(0).cast("long").alias(c) for c in measures[:4]], F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"), F.lit("").alias("groups_sha256"))
        scored = scored.drop("rare").unionByName(late)
    docs = whole(scored)
    return docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *measures, "groups_sha256")


def links(packs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """Every link: doc_id, copies, a_at, b_at (places of the tokens), a, b (ids), from and upto (bytes of the overlap)."""

    def run(batches):
        sides = [_side(p) for p in tokenizers]
        for batch in batches:
            for row in range(batch.num_rows):
                o = _opened(batch, row, sides)
                n_a, n_b, n_groups, byte, a0, b0, copies = (_array(batch, c, row) for c in ("n_a", "n_b", "n_groups", "byte_start", "a_start", "b_start", "copies"))
                per = n_a + n_b - n_groups
                block = np.repeat(np.arange(len(per)), per)
                a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
                base = np.concatenate(([0], o.a_ends))[a_first]
                upto = o.ends - base[block] + byte[block]
                low = np.concatenate(([0], o.ends[:-1]))[: len(o.ends)] - base[block] + byte[block]
                docs = batch.column("doc_id")[row].values.take(pa.array(block))
                rest = [copies[block], o.a_at - a_first[block] + a0[block], o.b_at - b_first[block] + b0[block], o.a[o.a_at].astype(np.int32), o.b[o.b_at].astype(np.int32), low, upto]
                yield pa.RecordBatch.from_arrays([docs, *[pa.array(x) for x in rest]], names=["doc_id", "copies", "a_at", "b_at", "a", "b", "from", "upto"])

    return packs.mapInArrow(run, "doc_id long, copies long, a_at long, b_at long, a int, b int, `from` long, upto long")


def groups(packs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """Every group: doc_id, copies, a_at, b_at (its first tokens), a and b (its ids)."""

    def run(batches):
        sides = [_side(p) for p in tokenizers]
        for batch in batches:
            for row in range(batch.num_rows):
                o = _opened(batch, row, sides)
                n_a, n_b, n_groups, a0, b0, copies = (_array(batch, c, row) for c in ("n_a", "n_b", "n_groups", "a_start", "b_start", "copies"))
                block = np.repeat(np.arange(len(n_groups)), n_groups)
                cuts = [np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (o.a_last, o.b_last)]
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(ids.astype(np.int32))) for c, ids in zip(cuts, (o.a, o.b), strict=True)]
                at = [c[:-1] - (np.cumsum(n) - n)[block] + z[block] for c, n, z in zip(cuts, (n_a, n_b), (a0, b0), strict=True)]
                docs = batch.column("doc_id")[row].values.take(pa.array(block))
                yield pa.RecordBatch.from_arrays([docs, pa.array(copies[block]), *[pa.array(x) for x in at], *lists], names=["doc_id", "copies", "a_at", "b_at", "a", "b"])

    return packs.mapInArrow(run, "doc_id long, copies long, a_at long, b_at long, a array<int>, b array<int>")


def align(docs: DataFrame, tokenizers: tuple[str, str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packs of all documents' groups: see ``sweep``."""
    return sweep(token_runs(docs, tokenizers, doc_id=doc_id, text=text), tokenizers)


def digest(packs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """Each document's row of ``scores``, by the counts of all packs."""
    return scores(packs, pair_counts(packs, tokenizers), tokenizers)

