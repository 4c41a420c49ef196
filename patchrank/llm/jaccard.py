"""Jaccard join of whole documents by a blocked sparse product.

A document's set holds its distinct shingles (fingerprints of 64 bits). Two sets of sizes a and b link when their overlap o
satisfies 100 o >= t (a + b - o), so they differ in at most H(a + b) shingles.

1. *Census.* A set that links shares at least t in 100 of its shingles with another one. Of a fixed share of all shingles, chosen by
   their fingerprints, those that occur in a single set are counted; a set with more of them than it may have outside a partner links with
   nothing. Of equal sets the smallest doc_id goes on. Documents that only have a passage in common go here, before any signature is made.
2. *Families.* Shingles are dealt by hash into H + 1 + spare parts, for H of the size class. Linked sets agree in one part that is not
   empty, or both have more than ``spare`` empty parts; each set therefore sends one signature per part, and all empty ones only in
   that case. ``spare`` is five deviations above the empty parts that the smallest set of the class is expected to have. Sets that share a signature are joined by star edges, and their components are the candidate families. A set's
   classes are its own and the larger ones with which it can link. Before that and after it the census is taken again of all shingles of the
   remaining sets, the second time within families, until a pass removes less than a tenth.
3. *Product.* A family's incidence rows meet in blocks of bounded size; a larger family is cut into chunks and every pair of
   chunks is a block. A block keeps the columns that two of its rows or more share, accumulates over them the overlap counts of one row with
   all rows not yet reached whose sizes can link, and keeps those that meet the bound. It returns a spanning forest, never pairs.
4. Components of these forests over all blocks are the result.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import blobs, breaks, components, forest, keep, keep_bucketed_sum, merged, packed_slices, planes, spread, unpacked_slice

RATIO = 1.4
PACKED = "grp INT, sigs BINARY, refs BINARY, docs BINARY, sizes BINARY"
SETS = "doc_id BIGINT, family BIGINT, members BINARY"
TOLD = "doc_id BIGINT, n BIGINT, same BINARY, texts BIGINT, able BOOLEAN"
CODES = 1 << 26  # of a group; two shingles taken for one only keep a document


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with which sets of ``total`` shingles together link."""
    return -(-percent * total // (100 + percent))


def sampled(percent: int) -> float:
    """Share of all shingles that is counted: a set that can link has at most 100 - percent in a hundred that no other set holds."""
    return min(1.0, 2.5 * (100 - percent) / 100)


class Classes:
    """Size classes and the number of parts of each."""

    def __init__(self, percent: int, largest: int):
        low, self.parts, self.spare = [1], [], []
        while percent * low[-1] <= 100 * largest:
            high = max(low[-1] + 1, int(low[-1] * RATIO))
            total = np.arange(2, 2 * high - 1)
            differ = int(np.max(total - 2 * needed(total, percent)))
            spare = 0
            for _ in range(3 if differ else 0):
                empty = (differ + 1 + spare) * math.exp(-low[-1] / (differ + 1 + spare))
                spare = math.ceil(empty + 5 * math.sqrt(empty) + 1)
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)
            low.append(high)
        self.low, self.percent = np.array(low), percent

    def of(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        return [c for c in range(own, len(self.parts)) if c == own or 100 * n >= self.percent * self.low[c]]


def lowered(column) -> T.Words:
    data, offsets = T.utf8(column)
    return T.Words(T.LOWER[data], offsets, T.BLANK)


def sets_of(words: T.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, bounds). A text of fewer words has one shingle, its whole sequence."""
    hashes = words.hashes()
    found, first = T.shingles(hashes, words.first, width)
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < width))
    if len(short):
        whole = T.ranges(hashes, words.first[short], words.first[short + 1], T.WORD_BASE)
        found = np.insert(found, first[short], whole)
        first = first + np.searchsorted(short, np.arange(len(first)), side="left")
    found = np.array(found)
    for a, b in zip(first[:-1], first[1:]):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    return found[new], np.concatenate([[0], np.cumsum(new)])[first]


def signatures(members: np.ndarray, classes: Classes) -> np.ndarray:
    """Signatures of one set."""
    mixed = T.mix(members)
    out = []
    for c in classes.of(len(members)):
        m = classes.parts[c]
        part = ((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        at = breaks(part[order])
        total = np.add.reduceat(mixed[order], at[:-1])
        named = part[order][at[:-1]]
        if m - len(named) > classes.spare[c]:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), named)
            named, total = np.concatenate([named, empty]), np.concatenate([total, np.zeros(len(empty), np.uint64)])
        out.append(T.mix(total + T.mix(named + np.uint64(c << 32))))
    return np.concatenate(out)


def _dealt(sigs, owner, groups):
    """Packed rows of the signatures of the documents ``owner``, by group."""
    sigs, owner = np.concatenate(sigs), np.concatenate(owner)
    order = np.argsort(sigs)
    sigs, owner = sigs[order], owner[order]
    table, owner = np.unique(owner, return_inverse=True)
    for columns in packed_slices(_group(sigs, groups), sigs, owner, table):
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], ["grp", "sigs", "refs", "docs", "sizes"])


def _group(codes, groups):
    return (((codes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _spoken(width, percent, groups):
    """Of every text its size and the digest of its set, and codes of a fixed share of its shingles; equal sets of a batch send codes once.

    Sizes go to the group -1 - g, for g of the doc_id's hash.
    """
    share = sampled(percent)

    def rows(stream):
        for batch in T.batches(stream):
            ids = batch["doc_id"]
            known = ids.is_valid().to_numpy()
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            members, bounds = sets_of(lowered(batch["text"]), width)
            sizes = np.diff(bounds).astype(np.int64)
            same = np.zeros((len(ids), 16), np.uint8)
            met: set[bytes] = set()
            sent = np.zeros(len(ids), bool)
            for i in np.flatnonzero(known & (sizes > 0))[np.argsort(ids[known & (sizes > 0)], kind="stable")]:
                digest = hashlib.blake2b(members[bounds[i]:bounds[i + 1]].tobytes(), digest_size=16).digest()
                same[i] = np.frombuffer(digest, np.uint8)
                sent[i] = digest not in met
                met.add(digest)
            home = _group(T.mix(np.where(known, ids, np.arange(len(ids))).view(np.uint64)), groups)
            order = np.argsort(home, kind="stable")
            at = breaks(home[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(-1 - home[order][at[:-1]], pa.int32()), blobs(same[order].view("V16").ravel(), at), blobs(known[order], at), blobs(ids[order], at), blobs(sizes[order], at)],
                ["grp", "sigs", "refs", "docs", "sizes"])
            owner = np.repeat(np.arange(len(ids)), sizes)
            told = sent[owner] & (members <= np.uint64(int(share * (2 ** 64 - 1))) if share < 1 else True)
            codes, owner = T.mix(members[told]), owner[told]
            yield from _coded((_group(codes, groups).astype(np.uint64) << np.uint64(32)) | (codes & np.uint64(CODES - 1)), owner, ids)
    return rows


def _coded(codes, owner, ids):
    """Packed rows of codes (group, then 32 bits); of one that a batch holds often, two entries prove that it is shared."""
    order = np.argsort(codes)
    codes, owner = codes[order], owner[order]
    few = np.ones(len(codes), bool)
    few[2:] = codes[2:] != codes[:-2]
    codes, owner = codes[few], owner[few]
    if len(codes):
        for columns in packed_slices((codes >> np.uint64(32)).astype(np.int64), codes, owner, ids):
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], ["grp", "sigs", "refs", "docs", "sizes"])


def _alone(codes, docs):
    """(doc_ids, number of their codes that occur once)"""
    c, d = np.concatenate(codes), np.concatenate(docs)
    order = np.argsort(c)
    cut = breaks(c[order])
    return np.unique(d[order[cut[:-1][np.diff(cut) == 1]]], return_counts=True)


def _census(groups):
    """Sizes as they came; of every group of codes, the doc_ids and numbers of those that one text alone holds, by the doc_id's group."""
    def rows(stream):
        held, codes, docs = None, [], []

        def close():
            d, n = _alone(codes, docs)
            home = _group(T.mix(d.view(np.uint64)), groups)
            order = np.argsort(home, kind="stable")  # doc_ids ascend in each
            d, n, home = d[order], n[order], home[order]
            for a, b in zip((at := breaks(home))[:-1], at[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - home[a]], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                     *(pa.array([planes(x)], pa.binary()) for x in (np.diff(d[a:b], prepend=0), n[a:b].astype(np.int64)))], ["grp", "sigs", "refs", "docs", "sizes"])

        for batch in stream:
            grps = batch.column("grp").to_pylist()
            if grps and grps[0] < 0:
                yield batch.slice(0, sum(g < 0 for g in grps))
            for i, grp in enumerate(grps):
                if grp < 0:
                    continue
                if grp != held and codes:
                    yield from close()
                    codes, docs = [], []
                held = grp
                c, d = unpacked_slice(*(batch.column(x)[i].as_py() for x in ("sigs", "refs", "docs")))
                codes.append(c.astype(np.uint32))
                docs.append(d)
        if codes:
            yield from close()
        T.release()
    return rows


def _judged(percent):
    """A row for every text: doc_id, size, digest of its set, texts of its doc_id, and whether its set can link with another one."""
    def rows(stream):
        held, sized, single = None, [], []

        def close():
            same, known, ids, n = (np.concatenate(x) for x in zip(*sized))
            alone = np.zeros(len(ids), np.int64)
            nodes, at, texts = np.unique(ids[known], return_inverse=True, return_counts=True)
            total = np.zeros(len(nodes), np.int64)
            for d, k in single:
                total[np.searchsorted(nodes, d)] += k  # a doc_id once in each
            alone[known] = total[at]
            several = np.zeros(len(ids), np.int64)
            several[known] = texts[at]
            able = known & (n > 0) & ((several > 1) | (100 * alone <= (100 - percent) * n))
            full = known & (n > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=~known), pa.array(n, pa.int64()), pa.array([x.tobytes() if f else None for x, f in zip(same, full)], pa.binary()),
                 pa.array(several, pa.int64()), pa.array(able)], ["doc_id", "n", "same", "texts", "able"])

        for batch in stream:
            for i, grp in enumerate(batch.column("grp").to_pylist()):
                if grp != held and sized:
                    yield close()
                    sized, single = [], []
                held = grp
                s, r, d, n = (batch.column(c)[i].as_py() for c in ("sigs", "refs", "docs", "sizes"))
                if s is None:
                    single.append((np.cumsum(_unplaned(d)), _unplaned(n)))
                else:
                    sized.append((np.frombuffer(s, "V16"), np.frombuffer(r, bool), np.frombuffer(d, np.int64), np.frombuffer(n, np.int64)))
        if sized:
            yield close()
        T.release()
    return rows


def _summed(stream):
    """(doc_id, number of its codes that it holds alone)"""
    held, docs, counts = None, [], []

    def close():
        d, at = np.unique(np.concatenate(docs), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "alone"])

    for batch in stream:
        for i, grp in enumerate(batch.column("grp").to_pylist()):
            if grp != held and docs:
                yield close()
                docs, counts = [], []
            held = grp
            docs.append(np.cumsum(_unplaned(batch.column("docs")[i].as_py())))
            counts.append(_unplaned(batch.column("sizes")[i].as_py()))
    if docs:
        yield close()
    T.release()


def _unplaned(data):
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _families(stream):
    """Star edges between the sets that share a signature, as one spanning forest per group of signatures, a packed row each."""
    held, sigs, docs = None, [], []

    def close():
        s, d = np.concatenate(sigs), np.concatenate(docs)
        order = np.argsort(s)
        s, d = s[order], d[order]
        cut = breaks(s)
        low = np.repeat(np.minimum.reduceat(d, cut[:-1]), np.diff(cut))
        far = d != low
        if far.any():
            a, b = forest(d[far], low[far])
            yield pa.RecordBatch.from_arrays([pa.array([planes(x.astype(np.int64))], pa.binary()) for x in (a, b)], ["a", "b"])

    for batch in stream:
        for i, grp in enumerate(batch.column("grp").to_pylist()):
            if grp != held:
                if sigs:
                    yield from close()
                held, sigs, docs = grp, [], []
            s, d = unpacked_slice(*(batch.column(c)[i].as_py() for c in ("sigs", "refs", "docs")))
            sigs.append(s)
            docs.append(d)
    if sigs:
        yield from close()
    T.release()


def _forests(stream):
    """The edges of a task's packed rows as one spanning forest: groups that find the same sets linked do not add to it."""
    a, b = [], []
    for batch in stream:
        for held, name in ((a, "a"), (b, "b")):
            held.extend(_unplaned(x) for x in batch.column(name).to_pylist())
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _members(width):
    """The sets of the candidates (doc_id, family, text)."""
    def rows(stream):
        for batch in T.batches(stream):
            members, bounds = sets_of(lowered(batch["text"]), width)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].combine_chunks(), batch["family"].combine_chunks(), blobs(members, bounds)], ["doc_id", "family", "members"])
    return rows


def _loaded(batch):
    """(doc_ids, shingles of all sets, bounds) of a batch of candidates."""
    data, offsets = T.utf8(batch["members"])
    return batch["doc_id"].to_numpy(), np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def _resigner(percent, groups):
    def rows(stream):
        for batch in T.batches(stream, column="members"):
            ids, members, bounds = _loaded(batch)
            classes = Classes(percent, int(np.diff(bounds).max(initial=1)))
            full = np.flatnonzero(np.diff(bounds))
            sigs = [signatures(members[bounds[i]:bounds[i + 1]], classes) for i in full]
            if sigs:
                yield from _dealt(sigs, [np.full(len(x), ids[i]) for x, i in zip(sigs, full)], groups)
    return rows


def _asked(groups):
    """The shingles of all candidates, told apart by family."""
    def rows(stream):
        for batch in T.batches(stream, column="members"):
            ids, members, bounds = _loaded(batch)
            if not len(members):
                continue
            owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
            codes = T.mix(members + T.mix(batch["family"].to_numpy().astype(np.uint64))[owner])
            codes = (_group(codes, groups).astype(np.uint64) << np.uint64(32)) | (codes & np.uint64(0xFFFFFFFF))
            yield from _coded(codes, owner, ids)
    return rows


def _incidence(stream):
    for batch in T.batches(stream, column="members"):
        ids, members, bounds = _loaded(batch)
        for i, blocks in enumerate(batch["blocks"].to_pylist()):
            own = members[bounds[i]:bounds[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["family"] for x in blocks], pa.int64()), pa.array([x["i"] for x in blocks], pa.int32()), pa.array([x["j"] for x in blocks], pa.int32()),
                 pa.array([ids[i]] * len(blocks), pa.int64()), pa.array([own] * len(blocks), pa.binary())],
                ["family", "i", "j", "doc_id", "members"])


def product(docs: np.ndarray, rows: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) over the linked rows of one block.

    Rows are kept by size. From a reached row, overlaps with all unreached rows of a size that can link are accumulated over
    its columns at once; a row enters only if its count meets the bound of the two sizes.
    """
    sizes = np.array([len(r) for r in rows])
    order = np.argsort(sizes, kind="stable")
    sizes, docs = sizes[order], docs[order]
    columns, at, held = np.unique(np.concatenate([rows[i] for i in order]), return_inverse=True, return_counts=True)
    shared = np.concatenate([[0], np.cumsum(held[at] > 1)])
    bounds = shared[np.concatenate([[0], np.cumsum(sizes)])]  # of the shared columns of each row
    at = at[held[at] > 1]
    mark = np.zeros(len(columns), np.int32)
    left = np.flatnonzero(100 * np.diff(bounds) >= percent * sizes)  # unreached rows that can link, by size
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        root = docs[queue[0]]
        while queue and len(left):
            x = queue.pop()
            n = sizes[x]
            near = left[np.searchsorted(sizes[left], -(-percent * n // 100)):np.searchsorted(sizes[left], 100 * n // percent, side="right")]
            if not len(near):
                continue
            mark[at[bounds[x]:bounds[x + 1]]] = 1
            lens = bounds[near + 1] - bounds[near]
            ends = np.cumsum(lens)
            cells = np.arange(ends[-1]) + np.repeat(bounds[near] - (ends - lens), lens)
            sums = np.concatenate([[0], np.cumsum(mark[at[cells]])])
            overlap = sums[ends] - sums[ends - lens]
            mark[at[bounds[x]:bounds[x + 1]]] = 0
            linked = near[100 * overlap >= percent * (n + sizes[near] - overlap)]
            if len(linked):
                queue.extend(linked.tolist())
                a.append(docs[linked])
                b.append(np.full(len(linked), root))
                left = left[~np.isin(left, linked)]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _products(percent):
    def rows(stream):
        key, docs, sets = None, [], []

        def close():
            if len(docs) > 1:
                a, b = product(np.array(docs, np.int64), sets, percent)
                far = a != b
                if far.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[far], pa.int64()), pa.array(b[far], pa.int64())], ["a", "b"])

        for batch in stream:
            found = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "doc_id", "members")))
            for family, i, j, doc, members in found:
                if (family, i, j) != key:
                    yield from close()
                    key, docs, sets = (family, i, j), [], []
                docs.append(doc)
                sets.append(np.frombuffer(members, np.uint64))
        yield from close()
        T.release()
    return rows


def _thinned(sets: DataFrame, percent: int, group_rows: int, before: int | None = None) -> DataFrame:
    """``sets`` (doc_id, family, members; ``before`` bytes of members, summed here if not given) without those that cannot link, their families formed anew.

    A doc_id with several texts always stays. Every pass sends each candidate's shingles once, as 32 bits beside their group: two that
    are taken for one only keep a candidate. Sets themselves stay in their buckets.
    """
    spark = sets.sparkSession
    buckets = spread(spark, 0, 1)
    signed = None
    if before is None:
        before = sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    while True:
        groups = spread(spark, before // 8, group_rows)
        alone = (sets.mapInArrow(_asked(groups), PACKED).repartition(groups, "grp").sortWithinPartitions("grp")
                 .mapInArrow(_census(groups), PACKED).repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_summed, "doc_id BIGINT, alone BIGINT"))
        sized = sets.groupBy("doc_id").agg((F.sum(F.octet_length("members")) / 8).alias("n"), F.count(F.lit(1)).alias("texts"))
        able = F.expr(f"texts > 1 OR 100 * (n - coalesce(alone, 0)) >= {percent} * n")
        able = merged(sized, alone, "doc_id", "left").where(able).select("doc_id")
        left, after = keep_bucketed_sum(merged(sets, able, "doc_id", "left_semi").select(sets.columns), "jaccard-left", buckets, "doc_id", F.octet_length("members"))
        if not after or signed is not None and 10 * after > 9 * before:
            return left
        signed = left.mapInArrow(_resigner(percent, groups), PACKED)
        edges = keep(signed.repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_families, "a BINARY, b BINARY"), "jaccard-edges")
        families = components(edges.mapInArrow(_forests, "a BIGINT, b BIGINT"), "jaccard-families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        sets, before = keep_bucketed_sum(merged(left.drop("family"), families, "doc_id").select(sets.columns), "jaccard-sets", buckets, "doc_id", F.octet_length("members"))


def links(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 1_000_000, group_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(sizes, components): rows (doc_id, n_shingles) for every row of ``docs``, and (node, component) for every doc_id linked with a smaller one.

    A doc_id that the second table lacks is the smallest of its component.

    Any bound gives the exact links. ``block`` bounds the shingles of one chunk of a family. A text without words has an empty set and no links. Rows without a doc_id
    have a size and no links. Rows that share a doc_id are one node, linked by any of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = spread(spark, int(volume * sampled(percent)) // 7, 4 * group_rows)  # about one shingle for 7 bytes of prose
    said = rows.mapInArrow(_spoken(width, percent, groups), PACKED).repartition(groups, "grp").sortWithinPartitions("grp")
    told = keep(said.mapInArrow(_census(groups), PACKED).repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_judged(percent), TOLD), "jaccard-told")
    first = told.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = keep(merged(told, first, "same").where("doc_id <> rep").select("doc_id", "rep", "texts"), "jaccard-copies")
    once = copies.where("texts = 1").select("doc_id", "rep")  # these leave all further work to the smallest doc_id of equal sets
    able = keep(merged(told.where("able").select("doc_id").distinct(), once, "doc_id", "left_anti"), "jaccard-able")
    buckets = spread(spark, 0, 1)
    sets = merged(rows, able, "doc_id").select("doc_id", F.lit(0).cast("bigint").alias("family"), "text").mapInArrow(_members(width), SETS)
    sets, held = keep_bucketed_sum(sets.repartition(buckets, "doc_id"), "jaccard-sets", buckets, "doc_id", F.octet_length("members"))
    sets = _thinned(sets, percent, group_rows, held)

    sized = keep(sets.groupBy("doc_id", "family").agg((F.sum(F.octet_length("members")) / 8).alias("n")), "jaccard-sized")
    totals = sized.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(
        F.col("family"), F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    where = merged(sized, totals, "family").withColumn("chunk", chunk).select("doc_id", blocks.alias("blocks"))
    incidence = (merged(sets.select("doc_id", "members"), where, "doc_id").select("doc_id", "members", "blocks")
                 .mapInArrow(_incidence, "family BIGINT, i INT, j INT, doc_id BIGINT, members BINARY"))
    keys = ["family", "i", "j"]
    found = (incidence.repartition(spread(spark, 0, 1), *keys).sortWithinPartitions(*keys).mapInArrow(_products(percent), "a BIGINT, b BIGINT"))
    equal = copies.where("texts > 1").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(found.union(equal), "jaccard-links")
    follow = merged(once, linked, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "rep").alias("component"))
    return told.select("doc_id", F.col("n").alias("n_shingles")), linked.union(follow)


def classes_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row of ``docs``."""
    sizes, found = links(docs, **options)
    joined = merged(sizes, found, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; of repeated rows with one doc_id all stay."""
    _, found = links(docs, **options)
    gone = found.where("node <> component").select(F.col("node").alias("_node"))
    return merged(docs, gone, docs["doc_id"] == gone["_node"], "left_anti")
