"""Merkle manifest of a data set, with proofs made by an octopus multiproof.

H is the lowercase hex SHA-256 of its inputs, one after the other. A leaf is H of a row's columns, each ``-`` if null, else its UTF-8
byte count, a colon and the value. Leaves of a source ascend by doc_id; runs of ``ARITY`` consecutive nodes become their H until one is
left, the source's subroot. Subroots in the order of their sources give the root in the same way.

1. Leaves are hashed where they are read; only digests are sorted. Positions come from one range partitioning and the row counts of its
   partitions, so a source of any size is numbered by many tasks.
2. *Tree.* Blocks of ``ARITY ** STEP`` leaves fold into one node each, blocks of those nodes again, until every source has its subroot.
3. *Octopus.* A shard is a run of blocks of one source. From its position alone follows the minimal union of coordinates that its leaves
   need and cannot derive: at each level the other members of the runs that its own nodes reach, up to the root. They are fetched once per
   shard by a join, the shard derives the interior nodes its leaves share, and expands every leaf's proof from them locally.

Upper nodes are wanted by many shards; they are replicated under a salt, so no node is a hot key.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from patchrank.llm.common import keep, spread, unpacked

ARITY, STEP, WIDTH = 3, 7, 2  # children of a node, levels of a block, blocks of a shard
SALT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "root"  # the tree over subroots; trees of sources are named "n" (null) or "s" and the source, which sort in their order
NODE = "tree STRING, level INT, ix BIGINT, digest STRING, total BIGINT, top BOOLEAN"
PROOF = "leaf STRING, subroot STRING, root STRING, proof ARRAY<STRING>, folded_root STRING"


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row of ``documents``; ``changed`` columns replace those of the row."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def height(total: int) -> int:
    """Levels above ``total`` leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // ARITY), n + 1
    return n


def width_at(total: int, level: int) -> int:
    for _ in range(level):
        total = -(-total // ARITY)
    return total


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the position in ``group`` by ``order``, and ``total``, the group's rows. Equal rows get any order.

    The only window runs over the row counts of (group, partition), as many as there are partitions and groups.
    """
    n = spread(rows.sparkSession, 0, 1)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    stored = keep(tied.repartitionByRange(n, group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
                  .withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    runs = stored.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_g", "_p", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("_g")).alias("total"))
    joined = stored.join(runs, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("pos", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_g", "_p", "_from", "_before")


def folded(digests: list[str]) -> list[str]:
    """The level above ``digests``."""
    return [digest(*digests[k:k + ARITY]) for k in range(0, len(digests), ARITY)]


def _fold(level: int, whole: bool, step: int):
    """Nodes above each block of a stream sorted by (tree, pos): all levels if ``whole``, with the block's own, else the topmost."""
    size = ARITY ** step

    def close(tree, block, total, now):
        out = []
        up = height(total) if total <= size else step
        for k in range(up + 1):
            if whole or k == up:
                out += [(tree, level + k, block * size // ARITY ** k + i, d, total, total <= size and k == up) for i, d in enumerate(now)]
            now = folded(now) if k < up else now
        return _table(out, ["tree", "level", "ix", "digest", "total", "top"], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_()])

    def rows(stream):
        held, now = None, []
        for batch in stream:
            for tree, pos, total, d in zip(*(batch.column(c).to_pylist() for c in ("tree", "pos", "total", "digest"))):
                if (tree, pos // size) != (held and held[:2]):
                    if held:
                        yield close(*held, now)
                    held, now = (tree, pos // size, total), []
                now.append(d)
        if held:
            yield close(*held, now)
    return rows


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def nodes_above(items: DataFrame, whole: bool, step: int = STEP) -> DataFrame:
    """Nodes (NODE) over ``items`` (tree, pos, total, digest): with ``whole`` all of them and the items, else those at the tops of blocks and above."""
    found, level = None, 0
    while True:
        n = spread(items.sparkSession, 0, 1)
        block = F.floor(F.col("pos") / ARITY ** step)
        made = items.select("tree", "pos", "total", "digest", block.alias("_block")).repartition(n, "tree", "_block").sortWithinPartitions("tree", "_block", "pos")
        made = keep(made.mapInArrow(_fold(level, whole or level > 0, step), NODE), "merkle-nodes")
        if level and found is not None:  # the items of this pass are in the table already
            made = made.where(f"level > {level} OR top")
        found = made if found is None else found.union(made)
        level += step
        items = made.where(f"level = {level} AND NOT top").select("tree", F.col("ix").alias("pos"), F.ceil(F.col("total") / ARITY ** step).cast("bigint").alias("total"), "digest")
        if items.isEmpty():
            return found


def wanted(known: list[int], total: int, level: int) -> Iterator[tuple[int, int]]:
    """(level, ix) of the nodes that the leaves below the nodes ``known`` of ``level`` need and cannot derive, up to the tree's root."""
    known = set(known)
    count = width_at(total, level)
    while count > 1:
        runs = {k // ARITY for k in known}
        for r in sorted(runs):
            for k in range(r * ARITY, min(r * ARITY + ARITY, count)):
                if k not in known:
                    yield level, k
        known, level, count = runs, level + 1, -(-count // ARITY)


def _wanted(sources: int, step: int, width: int):
    def rows(stream):
        for batch in stream:
            out = []
            for tree, total, rank, shard in zip(*(batch.column(c).to_pylist() for c in ("tree", "total", "rank", "shard"))):
                if total > ARITY ** step:
                    blocks = range(shard * width, min(shard * width + width, width_at(total, step)))
                    out += [(tree, shard, tree, *c) for c in wanted(blocks, total, step)]
                out += [(tree, shard, TOP, *c) for c in wanted([rank], sources, 0)]
            yield _table(out, ["tree", "shard", "of", "level", "ix"], [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()])
    return rows


class Paths:
    """Derived nodes of one shard and, for each, its siblings on the way to the root."""

    def __init__(self, first: int, digests: list[str], total: int, rank: int, sources: int, fetched: dict):
        self.siblings: list[dict] = []  # for each level: ix -> (what stands left, what stands right)
        now = self._climb({first + k: d for k, d in enumerate(digests)}, total, None, fetched)
        self.subroot = now[0]
        self.below = len(self.siblings)
        self.root = self._climb({rank: self.subroot}, sources, TOP, fetched)[0]
        self.rank = rank

    def _climb(self, now, total, tree, fetched):
        level = 0
        while total > 1:
            around, above = {}, {}
            for r in sorted({k // ARITY for k in now}):
                run = [now[k] if k in now else fetched[(tree, level, k)] for k in range(r * ARITY, min(r * ARITY + ARITY, total))]
                above[r] = digest(*run)
                for k in range(len(run)):
                    if r * ARITY + k in now:
                        around[r * ARITY + k] = (run[:k], run[k + 1:])
            self.siblings.append(around)
            now, level, total = above, level + 1, -(-total // ARITY)
        return now

    def of(self, ix: int) -> Iterator[tuple[list[str], list[str]]]:
        for level, around in enumerate(self.siblings):
            if level == self.below:
                ix = self.rank
            yield around[ix]
            ix //= ARITY


def _prove(sources: int, row_type: pa.DataType):
    """(row, PROOF) of every leaf of a stream sorted by (tree, shard, pos); fetched nodes come before the leaves."""

    def close(rows, leaves, others, first, total, rank, fetched):
        paths = Paths(first, leaves, total, rank, sources, fetched)
        proofs, folds = [], []
        for k, other in enumerate(others):
            at, proof = other or leaves[k], []
            for left, right in paths.of(first + k):
                at = digest(*left, at, *right)
                proof += left
                proof += right
            proofs.append(proof)
            folds.append(at)
        n = len(leaves)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, row_type), pa.array(leaves, pa.string()), pa.array([paths.subroot] * n, pa.string()), pa.array([paths.root] * n, pa.string()),
             pa.array(proofs, pa.list_(pa.string())), pa.array(folds, pa.string())], ["row", "leaf", "subroot", "root", "proof", "folded_root"])

    def rows(stream):
        held, state = None, None
        for batch in stream:
            columns = (batch.column(c).to_pylist() for c in ("tree", "shard", "pos", "total", "rank", "row", "leaf", "other", "of", "level", "ix", "digest"))
            for tree, shard, pos, total, rank, row, own, other, of, level, ix, d in zip(*columns):
                if (tree, shard) != held:
                    if held and state[1]:
                        yield close(*state)
                    held, state = (tree, shard), [[], [], [], None, None, None, {}]
                if of is not None:
                    state[6][(TOP if of == TOP else None, level, ix)] = d
                    continue
                if not state[1]:
                    state[3:6] = pos, total, rank
                state[0].append(row)
                state[1].append(own)
                state[2].append(other)
        if held and state[1]:
            yield close(*state)
    return rows


def proofs(docs: DataFrame, carry: list[str] | None = None, tampered: Column | None = None, step: int = STEP, width: int = WIDTH) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with leaf, subroot, root, proof (siblings from leaf to root, left to right) and folded_root.

    ``tampered`` is another leaf of a row, from which folded_root is recomputed; where it is null, the row's own is. A row is intact where
    folded_root equals root. A null doc_id comes before all others, rows with one doc_id are ordered by their leaves, and repeated rows are leaves of their
    own with equal digests. Null sources make one source, before the others; an empty source is another. An empty table gives an empty
    result. Columns of ``docs`` with these names are replaced.
    """
    carry = docs.columns if carry is None else carry
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    hashed = docs.select(row.alias("row"), tree.alias("tree"), F.col("doc_id").cast("bigint").alias("key"), leaf().alias("leaf"),
                         (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    leaves = keep(placed(keep(hashed, "merkle-leaves"), "tree", ["key", "leaf"], "merkle-order"), "merkle-placed")
    low = nodes_above(leaves.select("tree", "pos", "total", F.col("leaf").alias("digest")), False, step)
    sizes = leaves.where("pos = 0").select("tree", F.col("total").alias("size"))
    tops = low.where("top").select("tree", "digest").join(sizes, "tree").withColumn("_one", F.lit(TOP))
    ranks = keep(placed(tops, "_one", ["tree"], "merkle-sources").select("tree", "digest", F.col("size").alias("total"), F.col("pos").alias("rank"), F.col("total").alias("sources")), "merkle-subroots")
    sources = (ranks.limit(1).select("sources").first() or [0])[0]
    high = nodes_above(ranks.select(F.lit(TOP).alias("tree"), F.col("rank").alias("pos"), F.lit(sources).cast("bigint").alias("total"), "digest"), True, step) if sources else low.limit(0)
    nodes = low.where("NOT top").select("tree", "level", "ix", "digest", (F.col("level") >= step + 4).alias("upper")).union(
        high.select("tree", "level", "ix", "digest", F.lit(True).alias("upper")))
    salts = F.when(F.col("upper"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    nodes = nodes.select(F.col("tree").alias("_of"), F.col("level").alias("_level"), F.col("ix").alias("_ix"), "digest", F.explode(salts).alias("_salt"))
    span = ARITY ** step * width
    shards = ranks.select("tree", "total", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / span))).alias("shard"))
    asked = shards.mapInArrow(_wanted(sources, step, width), "tree STRING, shard BIGINT, of STRING, level INT, ix BIGINT")
    salt = F.when((F.col("of") == TOP) | (F.col("level") >= step + 4), F.pmod(F.col("shard"), F.lit(SALT))).otherwise(0)
    fetched = asked.withColumn("_own", salt).join(nodes, (F.col("of") == F.col("_of")) & (F.col("level") == F.col("_level")) & (F.col("ix") == F.col("_ix")) & (F.col("_own") == F.col("_salt")))
    own = leaves.join(ranks.select(F.col("tree").alias("_t"), "rank"), F.col("tree") == F.col("_t")).select(
        "tree", F.floor(F.col("pos") / span).alias("shard"), "pos", "total", "rank", "row", "leaf", "other",
        *[F.lit(None).cast(t).alias(c) for c, t in (("of", "string"), ("level", "int"), ("ix", "bigint"), ("digest", "string"))])
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema}
    guests = fetched.select("tree", "shard", F.lit(-1).cast("bigint").alias("pos"), *[empty[c] for c in ("total", "rank", "row", "leaf", "other")], "of", "level", "ix", "digest")
    n = spread(docs.sparkSession, 0, 1)
    dealt = own.union(guests).repartition(n, "tree", "shard").sortWithinPartitions("tree", "shard", "pos")
    schema = StructType([own.schema["row"], *StructType.fromDDL(PROOF)])
    out = dealt.mapInArrow(_prove(sources, to_arrow_schema(schema).field("row").type), schema)
    return unpacked(out, carry, **{f.name: F.col(f.name) for f in schema if f.name != "row"})


def manifest(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their proofs, to be stored beside the data set."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *FIELDS)
    out = proofs(rows, ["row"], **options)
    return unpacked(out, docs.columns, **{c: F.col(c) for c in ("leaf", "subroot", "root", "proof")})


def digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, with half of the rows tampered with: where 2 divides the CRC-32 of doc_id, text loses its line feeds."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")), F.lit(2)) == 0
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("n_chars").cast("bigint").alias("n_chars"), "text")
    cut = F.when(even & F.col("text").contains("\n"), leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    out = proofs(rows, ["doc_id"], cut)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
