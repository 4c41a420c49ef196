"""Substring dedup by grouping window fingerprints, in place of prefix-partitioned suffix trees.

A suffix starts at every word that has ``width - 1`` words after it. It is written as a path code of 64 bits, one field per depth:
8 bits of its first word, 8 bits of its first three words, 48 bits of its first ``width`` words. Codes that agree in leading
fields would lie in the same subtree, but only the full depth is looked at: equal codes are taken for equal windows. Windows that
share their first three words differ in the last 48 bits only. Codes are compared together with the group they fall in.

1. Count suffixes per prefix cell (65,536 counters, whatever the input) and cut the code line into groups of about
   ``group_rows`` suffixes: rare first words share a group, frequent ones are split by their three-word prefix, and a prefix that is
   still too frequent by all its words. Prefix length thus varies with frequency.
2. Every task sorts the suffixes of a batch. For a node that several documents of the batch reach, only the smallest doc_id
   travels; the others are known repeats. A passage held by a third of all documents reaches its group once per batch.
3. Each group is one subtree: its nodes at depth ``width`` with leaves in several documents give the repeats. Repeats of
   consecutive suffixes overlap, and their union in a document is the maximal repeat that is removed.
4. Codes of repeats return to their documents packed by document shard, so that rows do not follow documents times groups.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import blobs, breaks, packed_slices, schema_with, spread, unpacked_slice

CELL_BITS = 16
SHARD_BYTES = 8 << 20
NAMES = ["grp", "codes", "refs", "docs"]
SHUFFLED = "grp INT, codes BINARY, refs BINARY, docs BINARY"
FOUND = "_shard INT, docs BINARY, counts BINARY, codes BINARY"


def path_codes(words: T.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all suffixes with ``width`` words, number of suffixes before each text)."""
    hashes = words.hashes()
    tail, first = T.shingles(hashes, words.first, width)
    k = np.diff(first)
    at = np.arange(len(tail)) + np.repeat(words.first[:-1] - first[:-1], k)
    lead = T.ranges(hashes, at, at + min(3, width), T.WORD_BASE)
    high = np.uint64(0xFF << 56)
    return (hashes[at] & high) | ((lead & high) >> np.uint64(8)) | (tail >> np.uint64(CELL_BITS)), first


def _cells(width):
    def count(stream):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in T.batches(stream):
            codes, _ = path_codes(T.Words(*T.utf8(batch["text"]), T.BLANK), width)
            total += np.bincount((codes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["cell", "n"])
    return count


class Groups:
    """Variable-length prefixes: consecutive cells share a group up to ``rows`` suffixes, larger cells are cut by their tails."""

    def __init__(self, counts: np.ndarray, rows: int):
        parts = np.maximum(1, -(-counts // rows))
        base, used, group = np.zeros(len(counts), np.int64), 0, 0
        for cell, (n, p) in enumerate(zip(counts.tolist(), parts.tolist())):
            if used and (p > 1 or used + n > rows):
                group, used = group + 1, 0
            base[cell] = group
            if p > 1:
                group += p
            else:
                used += n
        self.base, self.parts, self.n = base, parts.astype(np.uint64), group + 1

    def of(self, codes: np.ndarray) -> np.ndarray:
        cell = (codes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        tail = (codes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
        return self.base[cell] + ((tail * self.parts[cell]) >> np.uint64(32)).astype(np.int64)


def groups_of(docs: DataFrame, width: int, group_rows: int) -> Groups:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    rows = (docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_cells(width), "cell BIGINT, n BIGINT")
            .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Groups(counts, int(max(1000, min(group_rows, counts.sum() // (4 * tasks)))))


def row_prints(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One fingerprint, of all its path codes, for every text that has a suffix."""
    starts = first[:-1][np.diff(first) > 0]
    return np.add.reduceat(T.mix(codes), starts) if len(starts) else np.zeros(0, np.uint64)


def packed(docs: np.ndarray, codes: np.ndarray, whole: dict | None = None, rows: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, counts, codes), ordered by document.

    ``whole`` has the suffixes of each document, ``rows`` (documents, prints) of its texts: a document all of whose suffixes repeat has
    minus the number of its texts as count, and their prints for codes. They name these texts only: the document may have others
    in other batches.
    """
    order = np.argsort(docs, kind="stable")
    docs, codes = docs[order], codes[order]
    at = breaks(docs)
    names, counts = docs[at[:-1]], np.diff(at)
    if whole:
        every = np.array([n == whole[d] for d, n in zip(names.tolist(), counts.tolist())], bool)
        named = np.isin(rows[0], names[every])
        rest = ~np.repeat(every, counts)
        owner, codes = np.concatenate([docs[rest], rows[0][named]]), np.concatenate([codes[rest], rows[1][named]])
        codes = codes[np.argsort(owner, kind="stable")]
        counts[every] = -np.unique(rows[0][named], return_counts=True)[1]
    return names, counts.astype(np.int32), codes


def _row(grp, codes, refs, docs):
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), *(pa.array([x], pa.binary()) for x in (codes, refs, docs))], NAMES)


def _suffixes(width, groups):
    def rows(stream):
        for batch in T.batches(stream, 8 << 20):
            codes, first = path_codes(T.Words(*T.utf8(batch["text"]), T.BLANK), width)
            ids, rank = np.unique(batch["doc_id"].to_numpy(), return_inverse=True)
            owner = np.repeat(rank, np.diff(first)).astype(np.uint32)
            texts = ids[rank[np.diff(first) > 0]], row_prints(codes, first)
            order = np.argsort(codes)
            codes, owner = codes[order], owner[order]
            cut = breaks(codes)
            if len(cut) == 1:
                continue
            low = np.minimum.reduceat(owner, cut[:-1])
            again = owner > np.repeat(low, np.diff(cut))
            # repeats inside the batch go straight to their documents
            if again.any():
                docs, counts, local = packed(ids[owner[again]], codes[again], dict(zip(ids.tolist(), np.bincount(owner, minlength=len(ids)).tolist())), texts)
                yield _row([-1 - int(len(local) % 1024)], local.tobytes(), counts.tobytes(), docs.tobytes())
            codes, owner = codes[cut[:-1]], low
            for columns in packed_slices(groups.of(codes), codes, owner, ids):
                yield pa.RecordBatch.from_arrays(columns, NAMES)
    return rows


def subtree(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, code) of every leaf below a full-depth node that a smaller doc_id reaches too."""
    order = np.argsort(codes)
    codes, docs = codes[order], docs[order]
    cut = breaks(codes)
    low = np.minimum.reduceat(docs, cut[:-1])
    again = docs > np.repeat(low, np.diff(cut))
    return docs[again], codes[again]


def shard_of(docs: np.ndarray, shards: int) -> np.ndarray:
    return (docs ^ (docs >> 15)) % shards


def shard_column(shards: int):
    """The same in Spark; a row without doc_id goes by its text."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 15)), F.lit(shards)).cast("int")


class _Outbox:
    """Repeats of a task, sent to document shards when enough are held."""

    def __init__(self, shards: int, most: int = 1 << 21):
        self.shards, self.most, self.held, self.parts = shards, most, 0, []

    def add(self, docs, counts, codes):
        self.parts.append((docs, counts, codes))
        self.held += len(codes) + len(docs)
        if self.held > self.most:
            yield from self.flush()

    def flush(self):
        if not self.parts:
            return
        docs, counts, codes = (np.concatenate(x) for x in zip(*self.parts))
        self.held, self.parts = 0, []
        shard = shard_of(docs, self.shards)
        order = np.argsort(shard, kind="stable")
        size = np.abs(counts)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        ends = np.concatenate([[0], np.cumsum(size[order])])
        at = np.arange(ends[-1]) + np.repeat(first[order] - ends[:-1], size[order])
        docs, counts, codes, shard = docs[order], counts[order], codes[at], shard[order]
        cut = breaks(shard)
        for k in range(0, len(cut) - 1, 64):  # few rows a batch: each may be large
            c = cut[k:k + 65]
            yield pa.RecordBatch.from_arrays([pa.array(shard[c[:-1]], pa.int32()), blobs(docs[c[0]:c[-1]], c - c[0]), blobs(counts[c[0]:c[-1]], c - c[0]),
                                              blobs(codes[ends[c[0]]:ends[c[-1]]], ends[c] - ends[c[0]])], ["_shard", "docs", "counts", "codes"])


def _subtrees(shards):
    """Rows arrive ordered by group; one group is held at a time."""
    def rows(stream):
        held, codes, docs, out = None, [], [], _Outbox(shards)

        def close():
            found, at = subtree(np.concatenate(codes), np.concatenate(docs))
            if len(found):
                yield from out.add(*packed(found, at))

        for batch in stream:
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                c, r, d = (batch.column(x)[i].as_py() for x in ("codes", "refs", "docs"))
                if grp < 0:
                    yield from out.add(np.frombuffer(d, np.int64), np.frombuffer(r, np.int32), np.frombuffer(c, np.uint64))
                    continue
                if grp != held:
                    if codes:
                        yield from close()
                    held, codes, docs = grp, [], []
                c, d = unpacked_slice(c, r, d)
                codes.append(c)
                docs.append(d)
        if codes:
            yield from close()
        yield from out.flush()
    return rows


def repeats(docs: DataFrame, shards: int, width: int = 13, group_rows: int = 2_000_000) -> DataFrame:
    """Packed path codes of the suffixes of each document that repeat one of a smaller doc_id, by document shard."""
    groups = groups_of(docs, width, group_rows)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_suffixes(width, groups), SHUFFLED)
    dealt = rows.repartition(spread(docs.sparkSession, groups.n, 4), "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(_subtrees(shards), FOUND)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def _cleaner(width, emit):
    """For each row of a shard, its words and the mask of removed ones (or None) go to ``emit``, which gives the added columns."""
    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        marked: dict[int, tuple[list, list]] = {}
        for d, n, c in zip(right["docs"].to_pylist(), right["counts"].to_pylist(), right["codes"].to_pylist()):
            d, n, c = np.frombuffer(d, np.int64), np.frombuffer(n, np.int32), np.frombuffer(c, np.uint64)
            ends = np.cumsum(np.abs(n))
            for doc, count, end in zip(d.tolist(), n.tolist(), ends.tolist()):
                marked.setdefault(doc, ([], []))[count < 0].append(c[end - abs(count):end])
        out = []
        for batch in T.batches(left.to_batches()):
            words = T.Words(*T.utf8(batch["text"]), T.BLANK)
            found = [marked.get(doc) for doc in batch["doc_id"].to_pylist()]
            codes = first = None
            if any(found):
                codes, first = path_codes(words, width)
            for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:])):
                pieces = words.data[a:b].tobytes().split()
                hit = None
                if found[i] and first[i + 1] > first[i]:
                    own, (parts, texts) = codes[first[i]:first[i + 1]], found[i]
                    if texts and np.isin(row_prints(own, np.array([0, len(own)])), np.concatenate(texts)).any():
                        hit = np.ones(len(pieces), bool)
                    elif parts:
                        starts = np.flatnonzero(np.isin(own, np.concatenate(parts)))
                        hit = covered(len(pieces), starts, width)
                out.append(emit(pieces, hit))
        kept = left.drop_columns(["_shard"])
        for k, (name, kind) in enumerate(zip(*emit.columns)):
            kept = kept.append_column(name, pa.array([row[k] for row in out], kind))
        return kept
    return shard


class Digest:
    """Word counts and the digest of the kept words."""

    columns = (["n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.string()])
    schema = "n_words BIGINT, n_removed BIGINT, kept_sha256 STRING"

    def __call__(self, pieces, hit):
        removed = 0 if hit is None else int(hit.sum())
        left = pieces if not removed else compress(pieces, ~hit)
        return len(pieces), removed, hashlib.sha256(b" ".join(left)).hexdigest()


class Kept(Digest):
    """The text that is left, its words joined by one space; a text that loses nothing stays as it is up to white space."""

    columns = (["n_words", "n_removed", "kept_text"], [pa.int64(), pa.int64(), pa.string()])
    schema = "n_words BIGINT, n_removed BIGINT, kept_text STRING"

    def __call__(self, pieces, hit):
        left = pieces if hit is None else list(compress(pieces, ~hit))
        return len(pieces), len(pieces) - len(left), b" ".join(left).decode()


def dedup(docs: DataFrame, width: int = 13, group_rows: int = 2_000_000, emit=None, columns=None) -> DataFrame:
    """``columns`` of ``docs`` (all by default, text last) with n_words, n_removed and kept_text, or what ``emit`` gives instead.

    Removes each word covered by a window of ``width`` words whose sequence also starts in a document with a smaller doc_id. Windows
    are judged on the input. A null text has no words. A row without doc_id has no place in the order: it is returned whole and
    removes nothing. Rows that share a doc_id are one document: none of them is a repeat of the other. Columns of ``docs`` named
    like an added one are replaced.
    """
    emit = emit or Kept()
    added = emit.columns[0]
    base = docs.select(*columns) if columns else docs.drop("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in base.columns if c not in added]).alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = spread(docs.sparkSession, volume, SHARD_BYTES) | 1
    dealt = rows.withColumn("_shard", shard_column(shards)).repartition(shards, "_shard")
    found = repeats(rows, shards, width, group_rows)
    cleaned = dealt.groupBy("_shard").cogroup(found.groupBy("_shard")).applyInArrow(_cleaner(width, emit), schema_with(rows, emit.schema))
    return cleaned.select("row.*", *([] if columns else ["text"]), *added)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs, emit=Digest(), columns=["doc_id"])
