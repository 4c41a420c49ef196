"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of documents. Its words are symbols: a word that no benchmark item holds is a separator, since no phrase can
cross it, and runs between separators that are shorter than the shortest phrase hold no occurrence; the rest is the shard's text.
Its Burrows-Wheeler transform is kept in a wavelet matrix. All phrases are searched backwards at once, two ranks a step; the
rows found are located by stepping back to sampled suffix positions; spans of one document are merged.

The benchmark is read in blocks of at most ``block_bytes`` of text, so what a task holds is bounded. Usually there is one block; with
more, the documents pass through one block after the other and carry the spans found so far.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import keep, packed, schema_with, unpacked

END, GAP, FIRST = 0, 1, 2  # symbols before the vocabulary
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(column) -> T.Words:
    data, offsets = T.utf8(column)
    return T.Words(T.LOWER[data], offsets, T.ALNUM)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; the last symbol is unique and smallest."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class Wavelet:
    """Ranks over a sequence of symbols below ``sigma``, one bit vector a level."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((s >> shift) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, bit, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        low = np.zeros_like(i)
        for shift, _, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for shift, bit, ones, zeros in self.levels:
            one = bit[i]
            out |= one.astype(i.dtype) << shift
            i = np.where(one, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(s)
        self.n = len(s)
        self.wavelet = Wavelet(s[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.sampled = order % sample == 0
        self.at = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases, given right-aligned in a matrix, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            on = np.flatnonzero((step < lengths) & (low < high))
            c = phrases[on, phrases.shape[1] - 1 - step]
            low[on], high[on] = (self.before[c] + self.wavelet.rank(c, x[on]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.at[self.nth[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.wavelet.access(rows)
            rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of some benchmark items as symbol sequences."""

    def __init__(self, items: pa.Table, width: int):
        words = words_of(items["text"])
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + FIRST
        seen: dict[bytes, int] = {}
        rows, self.items = [], []
        for item, a, b in zip(items["item_id"].to_pylist(), words.first[:-1], words.first[1:]):
            for i in range(a, b - min(width, b - a) + 1) if b > a else ():
                phrase = symbols[i:min(i + width, b)]
                at = seen.setdefault(phrase.tobytes(), len(rows))
                if at == len(rows):
                    rows.append(phrase)
                    self.items.append(set())
                if item is not None:
                    self.items[at].add(str(item))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.matrix = np.full((len(rows), int(self.lengths.max(initial=0))), GAP, np.int64)
        for i, r in enumerate(rows):
            self.matrix[i, self.matrix.shape[1] - len(r):] = r

    @property
    def sigma(self) -> int:
        return len(self.vocabulary) + FIRST


def shard_text(words: T.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of the word at each symbol) of the runs that can hold a phrase."""
    hashes = words.hashes()
    at = np.searchsorted(phrases.vocabulary, hashes)
    at[at == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[at] == hashes
    edge = np.zeros(len(words) + 1, bool)
    edge[words.first] = True
    padded = np.concatenate([[False], known, [False]])
    start = np.flatnonzero(padded[1:] & (~padded[:-1] | edge))
    end = np.flatnonzero(padded[:-1] & (~padded[1:] | edge))
    long = end - start >= phrases.lengths.min()
    start, end = start[long], end[long]
    size = end - start + 1  # with the gap behind
    where = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    gap = np.cumsum(size) - 1
    symbols = at[np.minimum(where, len(at) - 1)] + FIRST if len(where) else np.empty(0, np.int64)
    symbols[gap] = GAP
    return np.append(symbols, END).astype(np.int64), where


def occurrences(words: T.Words, phrases: Phrases, most: int = 1 << 21):
    """Yield (phrase numbers, first words) of all occurrences in the shard, some at a time."""
    if not len(words) or not len(phrases.lengths):
        return
    symbols, where = shard_text(words, phrases)
    if len(symbols) == 1:
        return
    index = FMIndex(symbols, phrases.sigma)
    low, high = index.search(phrases.matrix, phrases.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    a = 0
    while a < len(found):
        b = max(a + 1, int(np.searchsorted(np.cumsum(count[a:]), most, side="right")) + a)
        n = count[a:b]
        rows = np.arange(n.sum()) + np.repeat(low[found[a:b]] - (np.cumsum(n) - n), n)
        yield np.repeat(found[a:b], n), where[index.locate(rows)]
        a = b


def _marker(phrases: Phrases, source: str):
    """Adds the spans and items of one block to what the columns _spans and _items hold."""
    def rows(stream):
        for batch in T.batches(stream, 4 << 20, source):
            words = words_of(batch[source])
            step = np.zeros(len(words) + 1, np.int64)
            items: list[set] = [set(x or ()) for x in batch["_items"].to_pylist()]
            owner = np.repeat(np.arange(len(items)), words.counts())
            for which, at in occurrences(words, phrases):
                np.add.at(step, at, 1)
                np.add.at(step, at + phrases.lengths[which], -1)
                pairs = np.unique(owner[at] * len(phrases.lengths) + which)
                for doc, phrase in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist()):
                    items[doc] |= phrases.items[phrase]
            for i, spans in enumerate(batch["_spans"].to_pylist()):
                for s in spans or ():
                    step[words.first[i] + s["start"]] += 1
                    step[words.first[i] + s["end"]] -= 1
            hit = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
            edge = np.zeros(len(words) + 1, bool)
            edge[words.first] = True
            start = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
            end = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
            first = np.searchsorted(start, words.first)
            base = words.first[owner[start]] if len(start) else start
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]))
            n_hit = np.concatenate([[0], np.cumsum(hit[1:-1])])[words.first]
            out = batch.drop_columns([c for c in ("_spans", "_items") if c in batch.column_names])
            for name, values in (("_words", pa.array(words.counts(), pa.int64())), ("_hit", pa.array(np.diff(n_hit), pa.int64())), ("_spans", spans.cast(SPAN)),
                                 ("_items", pa.array([sorted(x) for x in items], pa.list_(pa.string())))):
                if name in out.column_names:
                    out = out.drop_columns([name])
                out = out.append_column(name, values)
            yield from out.to_batches()
    return rows


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = 4 << 20, source: str = "text") -> DataFrame:
    """``docs`` with _words, _hit, _spans (merged, in words) and _items (ids as strings, sorted).

    A window is ``width`` consecutive words of an item; an item of fewer words is one window, an item without words none. A null text
    has no words. Items without an id mark words but are not listed. Rows that share an item_id are one item.
    """
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    items = benchmark.select("item_id", F.col("text").cast("string"))
    names = [c for c in docs.columns if c not in ("_words", "_hit", "_spans", "_items")]
    added = "_words BIGINT, _hit BIGINT, _spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, _items ARRAY<STRING>"
    out = docs.select(names).withColumns({"_spans": F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), "_items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = Phrases(part.toArrow(), width)  # bounded by block_bytes
        out = (keep(out, "decontam-block") if k else out).mapInArrow(_marker(phrases, source), schema_with(docs.select(names), added))
    return out


def contaminated(words="_words", hit="_hit", share: int = 20):
    """The rule: any hit word, and at least one word in ``share``."""
    return (F.col(hit) > 0) & (share * F.col(hit) >= F.col(words))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document."""
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    return unpacked(mark(packed(docs, "text"), benchmark).where(~contaminated()), docs.columns)


def _cut(stream):
    for batch in T.batches(stream):
        words = words_of(batch["text"])
        raw, offsets = T.utf8(batch["text"])
        out = []
        for i, spans in enumerate(batch["_spans"].to_pylist()):
            at, pieces = offsets[i], []
            for s in spans or ():
                pieces.append(raw[at:words.start[words.first[i] + s["start"]]].tobytes())
                at = words.end[words.first[i] + s["end"] - 1]
            out.append(b"".join([*pieces, raw[at:offsets[i + 1]].tobytes()]).decode())
        yield from batch.set_column(batch.column_names.index("text"), "text", pa.array(out, pa.string())).to_batches()


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every merged span cut out of its text; a null text becomes empty."""
    marked = mark(packed(docs, "text"), benchmark)
    return unpacked(marked.mapInArrow(_cut, marked.schema), docs.columns, text=F.col("text"))
