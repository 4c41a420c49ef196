"""Runs: maximal periodic stretches of the words of a text, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(LEAST, POWER * q), which no neighbouring word extends.

The automaton of the words read so far has its suffix links in a link-cut forest whose preferred paths are coloured with the end of the
last occurrence of their substrings. Appending word i accesses the state of the whole prefix: every path segment met on the way to the
root holds the suffixes of the prefix that last ended at one earlier position j, up to the length L of its deepest state, and takes
the colour i. With d = i - j <= L the last L + d words have period d and hold a square; where the next word does not go on, they are
a run. L is the longest common suffix of both prefixes, so the left end is exact; a smaller period would have coloured the segment later
than j, so d is the smallest. A text of n words costs O(n log n) segments.

Before that, each task marks with NumPy the *islands* in which runs can lie at all: past the first q words of a run every word, and every
word run of ``GRAM`` words for q >= GRAM, occurred at most q words earlier. A run lies within one island whole, so the automaton reads islands only; in them
it compares words themselves, not fingerprints.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import packed, schema_with, unpacked

LEAST, POWER, GRAM = 6, 4, 8
RUNS = "runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>"
MARKED = f"{RUNS}, n_words BIGINT, collapsed STRING"


class Automaton:
    """Suffix automaton under appending; state 1 is the empty string, 0 stands for none.

    ``left``, ``right`` and ``up`` are splay trees over the preferred paths, ordered by length; ``up`` of a tree's root is the state above
    the path. ``last`` is valid at the root of a splay tree and holds for the whole path.
    """

    def __init__(self):
        self.next: list[dict] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.up, self.last = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.whole, self.n = 1, 0

    def _state(self, after: dict, length: int) -> int:
        self.next.append(after)
        self.length.append(length)
        for table in (self.link, self.left, self.right, self.up):
            table.append(0)
        self.last.append(-1)
        return len(self.next) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:  # p was the root of its path
            self.last[x] = self.last[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def append(self, word) -> list[tuple[int, int]]:
        """Segments (previous end, longest suffix that ended there) of the path that ``word`` recolours, longest first."""
        after, link, length, up = self.next, self.link, self.length, self.up
        i, self.n = self.n, self.n + 1
        now = self._state({}, length[self.whole] + 1)
        p, self.whole = self.whole, now
        while p and word not in after[p]:
            after[p][word] = now
            p = link[p]
        if not p:
            above = 1
        else:
            q = after[p][word]
            if length[q] == length[p] + 1:
                above = q
            else:
                above = self._state(dict(after[q]), length[p] + 1)
                while p and after[p].get(word) == q:
                    after[p][word] = above
                    p = link[p]
                self._insert(above, q)
        link[now] = up[now] = above
        return self._access(now, i)

    def _insert(self, clone: int, q: int) -> None:
        """Put ``clone`` between ``q`` and the state above it, on the path of ``q``."""
        self.link[clone], self.link[q] = self.link[q], clone
        self._splay(q)
        before = self.left[clone] = self.left[q]
        if before:
            self.up[before] = clone
        self.left[q] = clone
        self.up[clone] = q

    def _access(self, state: int, i: int) -> list[tuple[int, int]]:
        right, last, met = self.right, self.last, []
        x, below = state, 0
        while x:
            self._splay(x)
            if last[x] >= 0:
                met.append((last[x], self.length[x]))
            deeper = right[x]
            if deeper:  # keeps its colour, as a path of its own
                last[deeper] = last[x]
            right[x] = below
            below, x = x, self.up[x]
        self._splay(state)
        last[state] = i
        return met


def runs_in(words, end: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in words[:end], by start; ``words`` may go on after it."""
    automaton, found = Automaton(), set()
    for i in range(end):
        for j, longest in automaton.append(words[i]):
            d = i - j
            if longest + d >= max(LEAST, POWER * d) and (i + 1 == len(words) or words[i + 1] != words[i + 1 - d]):
                found.add((i - longest - d + 1, longest + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


FAR = np.int64(1) << 60


def distances(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far back each code last occurred in its document; FAR where it did not."""
    out = np.full(len(codes), FAR)
    mixed = T.mix(codes + T.mix(doc.astype(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    same = (mixed[order[1:]] == mixed[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    out[order[1:][same]] = order[1:][same] - order[:-1][same]
    return out


def stretches(ok: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of the stretches of ``least`` and more that hold."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]])))
    a, b = edge[::2], edge[1::2] - 1
    long = b - a + 1 >= least
    return a[long], b[long]


def islands(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) words of disjoint stretches, each within one document, such that every run lies within one of them.

    ``first`` has the number of words before each document. For periods from lo to hi = 2 lo - 1 the words of a run after its first q (and
    GRAM - 1 more where word runs of GRAM are compared) have distances of hi at most, and there are a least number of them.
    """
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return []
    one = distances(hashes, doc)
    grams, gram_first = T.shingles(hashes, first, GRAM)
    eight = np.full(len(hashes), FAR)
    inside = np.diff(gram_first)
    ends = np.arange(len(grams)) + np.repeat(first[:-1] - gram_first[:-1], inside) + GRAM - 1
    eight[ends] = distances(grams, np.repeat(np.arange(len(counts)), inside))
    found_a, found_b = [], []
    lo = 1
    while POWER * lo <= counts.max():
        hi = 2 * lo - 1
        if lo < GRAM:
            least = min(max(LEAST, POWER * q) - q for q in range(lo, hi + 1))
            a, b = stretches(one <= hi, least)
            back = hi
        else:
            a, b = stretches(eight <= hi, (POWER - 1) * lo - GRAM + 1)
            back = hi + GRAM - 1
        if len(a):
            found_a.append(np.maximum(a - back, first[doc[a]]))
            found_b.append(b)
        lo *= 2
    if not found_a:
        return []
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a, kind="stable")
    out: list[tuple[int, int]] = []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if out and x <= out[-1][1] and doc[x] == doc[out[-1][1]]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def runs_of(words: T.Words) -> list[list[tuple[int, int, int]]]:
    """Runs of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    data = words.data
    for a, b in islands(words.hashes(), words.first):
        doc = int(np.searchsorted(words.first, a, side="right")) - 1
        base, limit = int(words.first[doc]), int(words.first[doc + 1])
        stop = min(b + 2, limit)  # one word more shows whether the last run goes on
        own = [data[s:e].tobytes() for s, e in zip(words.start[a:stop].tolist(), words.end[a:stop].tolist())]
        out[doc] += [(s + a - base, n, q) for s, n, q in runs_in(own, b - a + 1)]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _mark(stream):
    for batch in T.batches(stream):
        words = T.Words(*T.utf8(batch["text"]), T.BLANK)
        raw, offsets = words.data.tobytes(), words.offsets.tolist()
        found = runs_of(words)
        collapsed = []
        for k, runs in enumerate(found):
            own = raw[offsets[k]:offsets[k + 1]].split()
            if runs:
                own = [own[x] for x in np.flatnonzero(kept_words(len(own), runs)).tolist()]
            collapsed.append(b" ".join(own).decode())
        flat = [r for runs in found for r in runs]
        fields = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        listed = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        row = batch["row"].combine_chunks()
        yield pa.RecordBatch.from_arrays([row.chunk(0) if isinstance(row, pa.ChunkedArray) else row, listed, pa.array(words.counts(), pa.int64()), pa.array(collapsed, pa.string())],
                                         ["row", "runs", "n_words", "collapsed"])


def mark(docs: DataFrame) -> DataFrame:
    """``docs`` with runs (by start, then period), n_words, and collapsed, the words outside the repeats of all runs joined by one space.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so repeated rows get equal
    results; a missing doc_id changes nothing. One text is read by one task. An empty table gives an empty result. Columns of
    ``docs`` with these names are replaced.
    """
    rows = packed(docs, F.col("text").cast("string").alias("text"))
    return unpacked(rows.mapInArrow(_mark, schema_with(rows.select("row"), MARKED)), docs.columns, **{c: F.col(c) for c in ("runs", "n_words", "collapsed")})


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of every text that has a run; other texts stay as they are. The columns are those of ``docs``."""
    marked = mark(packed(docs, "text"))
    return unpacked(marked, docs.columns, text=F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row.text")))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document whose CRC-32 of doc_id is a multiple of ten repeats a stretch of its words from some word on to its end."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", h.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.pmod("h", F.lit(10)) == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("words"), source(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Runs of ``documents`` with planted repeats: n_runs, the longest run, and digests of all runs and of the collapsed text."""
    marked = mark(looped(docs))
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
                                     .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                                     .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    chosen = marked.withColumn("best", F.when(F.size("runs") > 0, best))
    return chosen.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                         F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
