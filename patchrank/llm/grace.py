"""Exact dedup of whole texts by Grace hash partitioning.

Two texts are equal when they are identical after every run of blanks (space, tab to carriage return) is replaced by one space. A null
text is an empty one.

1. *Combine.* A task puts each batch of rows into an open-addressing table that compares complete contents, so a batch sends every
   text once, however many of its rows hold it. Rows are written with the number of their entry, entries with their content.
2. *Merge tree.* A text with more than ``fan`` entries is dealt over salts of ``fan`` entries each, merged in tables, and again until
   it has few entries. Copies that fill a third of all rows thus never meet in one task.
3. *Partition.* Entries are dealt into buckets by a digit of their hash. Buckets above ``bucket_bytes`` are written again under the
   next digit, recursively, until each fits the memory of a table; only a bucket with one hash cannot be split, and it has ``fan``
   entries at most.
4. *Tables.* Each bucket goes through an open-addressing table of its own, which knows all entries of its texts; its answers are
   joined back to the rows by the number of the entry. No entry has more rows than a batch, so no key of that join is hot.

Spill files are tables in the shared checkpoint folder: a lost executor loses none.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from patchrank.llm import text as T
from patchrank.llm.common import keep, packed, spread, unpacked

ENTRY = "entry BIGINT, sha BINARY, content BINARY, size BIGINT, low BIGINT, holder BIGINT, n BIGINT"
ANSWER = "entry BIGINT, sha BINARY, low BIGINT, holder BIGINT, n BIGINT"
BATCH, BUCKET, DIGITS = 16 << 20, 64 << 20, 16


def normalised(data: bytes) -> bytes:
    """Runs of blanks replaced by one space; UTF-8 in and out."""
    inner = b" ".join(data.split())
    if not inner:
        return b" " if data else b""
    return b" " * data[:1].isspace() + inner + b" " * data[-1:].isspace()


class Table:
    """Open addressing with linear probing. Slots hold indexes of ``contents``; a probe compares complete contents."""

    def __init__(self):
        self.slots, self.mask = [-1] * 64, 63
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def put(self, hash64: int, content: bytes) -> int:
        """Index of ``content``, which is added if it is new."""
        at = hash64 & self.mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == hash64 and self.contents[found] == content:
                return found
            at = (at + 1) & self.mask
        found = self.slots[at] = len(self.contents)
        self.hashes.append(hash64)
        self.contents.append(content)
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return found

    def _grow(self):
        self.slots, self.mask = [-1] * (4 * len(self.slots)), 4 * len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


def lower(a: tuple, b: tuple) -> bool:
    """Does (doc_id, entry) ``a`` come before ``b``? A null doc_id comes last, ties go to the smaller entry."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _combine(batch_bytes: int, schema: pa.Schema):
    def rows(stream):
        serial = TaskContext.get().partitionId() << 32
        for batch in T.batches(stream, batch_bytes):
            data, offsets = T.utf8(batch["text"])
            ids = batch["key"].to_pylist()
            table, shas, low, first, counts = Table(), [], [], [], []
            entry = np.empty(len(ids), np.int64)
            raw = data.tobytes()
            for i, doc in enumerate(ids):
                content = normalised(raw[offsets[i]:offsets[i + 1]])
                sha = hashlib.sha256(content).digest()
                k = entry[i] = table.put(int.from_bytes(sha[:8], "little"), content)
                if k == len(shas):
                    shas.append(sha)
                    low.append(doc)
                    first.append(i)
                    counts.append(1)
                else:
                    counts[k] += 1
                    if lower((doc, 0), (low[k], 0)):
                        low[k], first[k] = doc, i
            m = len(shas)
            leads = np.zeros(len(ids), bool)
            leads[first] = True
            numbers = pa.array(serial + np.arange(m), pa.int64())
            yield _columns(schema, len(ids), row=batch["row"], entry=pa.array(serial + entry), leads=pa.array(leads))
            yield _columns(schema, m, entry=numbers, sha=pa.array(shas, pa.binary()), content=pa.array(table.contents, pa.binary()),
                           size=pa.array([len(c) for c in table.contents], pa.int64()), low=pa.array(low, pa.int64()), holder=numbers, n=pa.array(counts, pa.int64()))
            serial += m
    return rows


def _columns(schema: pa.Schema, rows: int, **columns):
    arrays = [columns.get(f.name, None) for f in schema]
    arrays = [pa.nulls(rows, f.type) if a is None else a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.names)


class Merged:
    """A table of entries: for every content the lowest doc_id, the entry that holds it, the count, and the entries met."""

    def __init__(self):
        self.table, self.shas, self.low, self.count, self.members = Table(), [], [], [], []

    def add(self, entry, sha, content, low, holder, n):
        k = self.table.put(int.from_bytes(sha[:8], "little"), content)
        if k == len(self.shas):
            self.shas.append(sha)
            self.low.append((low, holder))
            self.count.append(n)
            self.members.append([entry])
        else:
            self.count[k] += n
            self.members[k].append(entry)
            if lower((low, holder), self.low[k]):
                self.low[k] = (low, holder)


def _by_bucket(stream, columns):
    """(bucket, Merged) of a stream that is sorted by bucket."""
    held, merged = None, None
    for batch in stream:
        buckets = batch.column("bucket").to_pylist()
        for bucket, *values in zip(buckets, *(batch.column(c).to_pylist() for c in columns)):
            if bucket != held:
                if merged is not None:
                    yield merged
                held, merged = bucket, Merged()
            merged.add(*values)
    if merged is not None:
        yield merged
    T.release()


FIELDS = ["entry", "sha", "content", "low", "holder", "n"]


def _parents(stream):
    """An entry for every content of a bucket, numbered as the smallest of its members, and the links to it."""
    for m in _by_bucket(stream, FIELDS):
        numbers = [min(x) for x in m.members]
        child = [x for found in m.members for x in found]
        parent = [p for p, found in zip(numbers, m.members) for _ in found]
        none = pa.nulls(len(numbers), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, pa.array(numbers, pa.int64()), pa.array(m.shas, pa.binary()), pa.array(m.table.contents, pa.binary()), pa.array([len(c) for c in m.table.contents], pa.int64()),
             *(pa.array([x[k] for x in m.low], pa.int64()) for k in (0, 1)), pa.array(m.count, pa.int64())], ["child", "entry", "sha", "content", "size", "low", "holder", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(child, pa.int64()), pa.array(parent, pa.int64()), *(pa.nulls(len(child), t) for t in (pa.binary(), pa.binary(), *[pa.int64()] * 4))],
            ["child", "entry", "sha", "content", "size", "low", "holder", "n"])


def _answers(stream):
    for m in _by_bucket(stream, FIELDS):
        at = [k for k, found in enumerate(m.members) for _ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for found in m.members for x in found], pa.int64()), pa.array([m.shas[k] for k in at], pa.binary()),
             *(pa.array([m.low[k][j] for k in at], pa.int64()) for j in (0, 1)), pa.array([m.count[k] for k in at], pa.int64())], ["entry", "sha", "low", "holder", "n"])


def digit(level: int, many: int) -> Column:
    """The digit of an entry's hash at a level of the partitioning."""
    return F.pmod(F.xxhash64("sha", F.lit(level)), F.lit(many)).cast("string")


def merge_tree(entries: DataFrame, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """(entries, links): entries of which no text has more than ``fan``, and for each round its (child, parent) entries.

    A round reads the merged entries of the one before, never those of texts that are already few.
    """
    now, few, links = entries, [], []
    n = spread(entries.sparkSession, 0, 1)
    while True:
        counts = now.groupBy("sha").agg(F.count(F.lit(1)).alias("_many"))
        crowded = keep(counts.where(F.col("_many") > fan), "grace-crowded")
        if crowded.isEmpty():
            break
        few.append(now.join(crowded, "sha", "left_anti").select(*entries.columns))
        salt = F.pmod(F.xxhash64("entry"), F.ceil(F.col("_many") / F.lit(fan)))
        dealt = now.join(crowded, "sha").withColumn("bucket", F.concat_ws(".", F.hex("sha"), salt)).drop("_many")
        merged = keep(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_parents, "child BIGINT, " + ENTRY), "grace-merged")
        links.append(merged.where("child IS NOT NULL").select("child", F.col("entry").alias("parent")))
        now = merged.where("child IS NULL").drop("child")
    for part in few:
        now = now.select(*entries.columns).union(part)
    return now, links


def partition(entries: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(entries with their ``bucket``, bytes in all): buckets above the bound are written again under the next digit until they fit."""
    total = entries.agg(F.sum("size")).first()[0] or 0
    many = 1 + 16 * total // bucket_bytes
    now, level, fits = entries.withColumn("bucket", digit(0, many)), 0, []
    while True:
        sizes = now.groupBy("bucket").agg(F.sum("size").alias("_bytes"), F.min("sha").alias("_a"), F.max("sha").alias("_b"))
        large = keep(sizes.where((F.col("_bytes") > bucket_bytes) & (F.col("_a") != F.col("_b"))).select("bucket"), "grace-large")
        if large.isEmpty():
            fits.append(now)
            break
        fits.append(now.join(large, "bucket", "left_anti"))
        level += 1
        now = keep(now.join(large, "bucket", "left_semi").withColumn("bucket", F.concat_ws(".", "bucket", digit(level, DIGITS))), f"grace-spill-{level}")
    out = fits[0]
    for more in fits[1:]:
        out = out.unionByName(more)
    return out, total


def groups(docs: DataFrame, carry: list[str] | None = None, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET, fan: int = 64) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with keep_id, group_size, kept and text_sha256 of every row.

    keep_id is the smallest doc_id of the group; rows without a doc_id are never it unless all lack one, and it is null then. Exactly one
    row of a group is kept: of repeated rows with the smallest doc_id, one of them. Null and empty texts are one group, a text of blanks
    alone another. An empty table gives an empty result. Columns of ``docs`` with these four names are replaced.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    rows = packed(docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, "doc_id", "text"])]), F.col("doc_id").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    slim = rows.withColumn("row", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in carry]))
    schema = StructType([StructField("row", slim.schema["row"].dataType), *StructType.fromDDL("leads BOOLEAN, " + ENTRY)])
    written = keep(slim.mapInArrow(_combine(batch_bytes, to_arrow_schema(schema)), schema), "grace-entries")
    entries, links = merge_tree(written.where("row IS NULL").drop("row", "leads"), fan)
    dealt, total = partition(entries, bucket_bytes)
    n = spread(spark, total, 32 << 20)
    answers = dealt.select("bucket", *FIELDS).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers, ANSWER)
    for link in reversed(links):
        down = answers.join(link, F.col("entry") == F.col("parent"), "left")
        answers = down.select(F.coalesce("child", "entry").alias("entry"), "sha", "low", "holder", "n")
    own = written.where("row IS NOT NULL").select("row", F.col("entry").alias("_entry"), "leads")
    joined = own.join(answers, F.col("_entry") == F.col("entry"))
    return unpacked(joined, carry, keep_id=F.col("low"), group_size=F.col("n"), kept=F.col("leads") & (F.col("_entry") == F.col("holder")),
                    text_sha256=F.lower(F.hex("sha")))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of every group of equal texts, with the columns of ``docs``: the one with the smallest doc_id."""
    rows = packed(docs, "doc_id", "text")
    return unpacked(groups(rows, ["row"], **options).where("kept"), docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return groups(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"])
