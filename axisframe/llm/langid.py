"""Language identification by cross-parsing: the language whose text parses a document into fewest phrases.

Each language has a suffix automaton of a sample of its labelled text. A document is cut, from left to right, into
the longest phrases that occur in that sample; phrases times log2 of the sample's length, per character, estimate
the cross entropy, and the least wins.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import free_name, uniform

UNDETERMINED = "und"
#: Codes: 0 a letter of no sample (no phrase goes past it), 1 anything but letters, then letters, the commonest first.
#: Transitions by codes under _ALPHABET are looked up in a full table, those by rarer letters in a sorted list.
_OUTSIDE, _GAP, _ALPHABET = 0, 1, 96
_SEGMENT = 1024
_CHUNK = 8 << 20


def suffix_automaton(codes: list[int]) -> np.ndarray:
    """Transitions (states x alphabet, -1 for none; state 0 is the start) of the automaton of all substrings."""
    next_, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        current = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = current
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(next_)
                next_.append(dict(next_[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    edges = np.array([(s, c, t) for s, out in enumerate(next_) for c, t in out.items()], dtype=np.int32).reshape(-1, 3)
    return np.concatenate((np.array([[len(next_), 0, 0]], dtype=np.int32), edges))


def dense(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges as a flat table of states x common codes, and sorted (state, code) keys and targets of rarer letters.

    Nothing leads past a letter of no sample.
    """
    size, edges = int(edges[0, 0]), edges[1:]
    common = edges[:, 1] < _ALPHABET
    table = np.full((size, _ALPHABET), -1, dtype=np.int32)
    table[edges[common, 0], edges[common, 1]] = edges[common, 2]
    table[:, _OUTSIDE] = -1
    keys = _key(edges[~common, 0], edges[~common, 1])
    order = np.argsort(keys)
    return table.ravel(), keys[order], edges[~common, 2][order]


def _key(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    return state.astype(np.int64) << 21 | code.astype(np.int64)


def _followed(table: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The states that the codes lead to, -1 for none."""
    flat, keys, targets = table
    rare = np.flatnonzero(code >= _ALPHABET)
    if not len(rare):
        return flat[state * _ALPHABET + code]
    after = flat[state * _ALPHABET + np.minimum(code, _ALPHABET - 1)]
    after[rare] = -1
    if len(keys):
        wanted = _key(state[rare], code[rare])
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        after[rare] = np.where(keys[at] == wanted, targets[at], -1)
    return after


class Model:
    """Languages, their automata and the alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        letters: dict[str, int] = defaultdict(int)
        for held in texts.values():
            for t in held:
                for ch in t.lower():
                    letters[ch] += ch.isalpha()
        kept = sorted((ch for ch, n in letters.items() if n), key=lambda ch: (-letters[ch], ch))
        self.codes = np.array([_OUTSIDE if chr(i).isalpha() else _GAP for i in range(0x110000)], dtype=np.min_scalar_type(len(kept) + 1))
        for i, ch in enumerate(kept):
            self.codes[ord(ch)] = i + 2
        self.languages, self.edges, self.bits = [], [], []
        for language in sorted(texts):
            joined: list[int] = []
            for t in texts[language]:
                joined += [*self.encoded(t).tolist(), _OUTSIDE]
            self.languages.append(language)
            self.edges.append(suffix_automaton(joined))
            self.bits.append(math.log2(max(2, len(joined))))

    def encoded(self, text: str) -> np.ndarray:
        """One code a character, runs of other than letters as one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[points]
        gap = codes == _GAP
        return codes[~(gap & np.concatenate(([True], gap[:-1])))] if len(codes) else codes


def _step(table: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a character each, and the phrases that ended at it."""
    after, ended = _followed(table, state, code), np.zeros(len(state), np.int64)
    failed = np.flatnonzero(after < 0)
    if len(failed):
        # the phrase ends before this character, unless none had begun; a character of no phrase is one itself
        again = _followed(table, np.zeros(len(failed), dtype=np.int64), code[failed])
        ended[failed] = (state[failed] > 0).astype(np.int64) + (again < 0)
        after[failed] = np.maximum(again, 0)
    return after, ended


def phrases(table: tuple[np.ndarray, np.ndarray, np.ndarray], columns: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Phrases of each segment; ``columns[t]`` has the t-th codes of the segments, longest segments first.

    ``before`` names the segment that comes before each in its text, -1 for a text's first. All are parsed side by
    side as if each began a phrase; a segment whose text comes into it amid a phrase is then parsed again from there,
    until both parses stand in one state, after which they agree. So the counts of a text's segments add up to the
    phrases of the whole text, wherever it was cut.
    """
    before = np.full(len(lengths), -1) if before is None else before
    state, count = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    active = np.searchsorted(-lengths, -np.arange(columns.shape[0]), side="left")
    for t in range(columns.shape[0]):
        n = active[t]
        if not n:
            break
        state[:n], ended = _step(table, state[:n], columns[t, :n])
        count[:n] += ended
    entry = np.zeros(len(lengths), dtype=np.int64)
    while True:
        comes = np.where(before >= 0, state[before], 0)
        lanes = np.flatnonzero(comes != entry)
        if not len(lanes):
            break
        new, old = comes[lanes], entry[lanes]
        n_new, n_old = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        entry[lanes] = new
        live, t = np.arange(len(lanes)), 0
        while len(live):
            over = lengths[lanes[live]] <= t
            if over.any():  # to its end in another state: the text leaves the segment by the new parse
                done = live[over]
                count[lanes[done]], state[lanes[done]] = n_new[done], new[done]
                live = live[~over]
                if not len(live):
                    break
            c = columns[t, lanes[live]]
            (new[live], ended), (old[live], was) = _step(table, new[live], c), _step(table, old[live], c)
            n_new[live] += ended
            n_old[live] += was
            met = new[live] == old[live]
            done = live[met]
            count[lanes[done]] += n_new[done] - n_old[done]
            live, t = live[~met], t + 1
    last = np.ones(len(lengths), bool)
    last[before[before >= 0]] = False
    return count + (last & (state > 0))


def classify(model: Model, tables: list[tuple], texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of whole texts."""
    out: list[tuple[str, float]] = []
    low = 0
    while low < len(texts):
        codes, size = [], 0
        while low + len(codes) < len(texts) and (not codes or size < _CHUNK):
            t = texts[low + len(codes)]
            codes.append(model.encoded(t) if t else np.zeros(0, model.codes.dtype))
            size += len(codes[-1])
        out += _classify(model, tables, codes, [bool(t) and any(map(str.isalpha, t)) for t in texts[low : low + len(codes)]])
        low += len(codes)
    return out


def _classify(model, tables, codes, lettered):
    owner, parts, follows = [], [], []
    for i, c in enumerate(codes):
        for at in range(0, len(c), _SEGMENT):
            follows.append(len(parts) - 1 if at else -1)
            owner.append(i)
            parts.append(c[at : at + _SEGMENT])
    cost = np.zeros((len(model.languages), len(codes)))
    if parts and tables:
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        columns = np.zeros((int(lengths.max()), len(parts)), dtype=model.codes.dtype)
        for j, i in enumerate(order):
            columns[: lengths[i], j] = parts[i]
        who = np.array(owner)[order]
        place = np.empty(len(parts), dtype=np.int64)
        place[order] = np.arange(len(parts))
        before = np.array(follows)[order]
        before = np.where(before >= 0, place[before], -1)
        for k, table in enumerate(tables):
            cost[k] = np.bincount(who, phrases(table, columns, lengths[order], before), minlength=len(codes)) * model.bits[k]
    result = []
    for i, has in enumerate(lettered):
        if not has or not tables:
            result.append((UNDETERMINED, 0.0))
            continue
        c = cost[:, i]
        best = int(np.argmin(c))
        rest = np.delete(c, best)
        result.append((model.languages[best], float(1 - c[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0))
    return result


def held_out(doc_id: Column) -> Column:
    """True for the documents that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, *, sample_chars: int = 1 << 16, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``sample_chars`` characters of each language, or on all that it has, drawn by a hash of doc_id and text.

    Whole documents of at most a quarter of that come first, in order of the hash; where a language has too few of
    them, longer ones follow, with their first ``sample_chars`` characters. Each language with a text is learned. Rows
    that repeat in id, text and language count once, and null or repeated ids are told apart by their texts, so what
    comes to the driver is little more than ``sample_chars`` a language whatever the table holds.
    """
    usable = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t <> '' and l is not null")
    usable = usable.withColumns({"u": uniform(F.lit(5), F.col("d"), F.col("l"), F.col("t")), "long": F.length("t") > sample_chars // 4})
    # small hashes in narrow ranges, whose characters tell how far the draw must go
    usable = usable.withColumn("range", F.floor(-8 * F.log2("u")).cast("int"))
    once = usable.groupBy("l", "long", "range", "u").agg(F.max(F.least(F.length("t"), F.lit(sample_chars))).alias("chars"))
    sizes = once.groupBy("l", "long", "range").agg(F.sum("chars").alias("chars"))
    ends: dict[str, tuple] = {}
    held: dict[str, int] = defaultdict(int)
    for row in sorted(sizes.collect(), key=lambda r: (r.l, r.long, -r.range)):
        if held[row.l] < sample_chars:
            ends[row.l] = (row.l, row.long, row.range)
            held[row.l] += row.chars
    last = docs.sparkSession.createDataFrame(list(ends.values()), "last string, last_long boolean, last_range int")
    fair = usable.join(F.broadcast(last), F.col("l") == F.col("last")).where("long < last_long or (long = last_long and range >= last_range)")
    drawn = fair.select("l", "long", "u", F.substring("t", 1, sample_chars).alias("t"))
    texts: dict[str, list[str]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for row in sorted(drawn.distinct().collect()):  # little more than sample_chars a language
        if size[row.l] < sample_chars:
            texts[row.l].append(row.t)
            size[row.l] += len(row.t)
    return Model(texts)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (0 to 1: how much fewer phrases than in the next best language).

    Null, empty and letterless texts are ``und`` with score 0, as are all texts if nothing was learned. Equal costs
    go to the first language by name. Columns of these names are replaced; repeated rows are each answered.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(classify(held.value, _tables(held), batches.tolist()), columns=["lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    name = free_name(docs, stem="identified")
    return docs.withColumn(name, run(F.col(text))).select(*docs.columns, f"{name}.lang_pred", f"{name}.score")


_TABLES: dict = {}


def _tables(held) -> list[tuple]:
    model = held.value
    if _TABLES.get("model") is not model:  # held by the model itself: another may come to lie at its address
        _TABLES.update(model=model, tables=[dense(e) for e in model.edges])
    return _TABLES["tables"]
