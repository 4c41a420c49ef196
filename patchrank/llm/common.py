"""Tables, shared storage and connected components for the operators of this package."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patchrank.session import checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame, *columns) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``columns``: no name of the caller's can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, names, **changed) -> DataFrame:
    """The columns ``names`` of ``row``, with those in ``changed`` replaced or added."""
    rest = [F.col(f"row.`{c}`").alias(c) if c not in changed else changed[c].alias(c) for c in names]
    return df.select(*rest, *[v.alias(k) for k, v in changed.items() if k not in names])


def schema_with(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` followed by the fields of ``ddl``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends here and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like ``keep``, as a table in ``buckets`` buckets of ``key``: joins and groups on the key with as many partitions move the other side only.

    The table is external, its files lie in shared storage; the session's catalog holds its name.
    """
    path = shared_path(df.sparkSession, name)
    title = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(title)
    return df.sparkSession.table(title)


def keep_bucketed_sum(df: DataFrame, name: str, buckets: int, key: str, value: Column) -> tuple[DataFrame, int]:
    """``keep_bucketed``, and the sum of ``value`` over its rows, observed while they are written: no query of its own reads them again for it."""
    seen = Observation()
    kept = keep_bucketed(df.observe(seen, F.sum(value).alias("total")), name, buckets, key)
    return kept, seen.get["total"] or 0


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input. Tasks deal and sort both: none is gathered and broadcast by the driver, however small its files are."""
    return left.join(right.hint("merge"), on, how)


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` rows, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose rows are the slices of ``values`` between consecutive ``bounds``."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize)
    if offsets[-1] < 2 ** 31:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def breaks(sorted_values: np.ndarray) -> np.ndarray:
    """Positions where a sorted array starts a new value, and its length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def planes(codes: np.ndarray) -> bytes:
    """Bytes of equal weight together: the leading ones of sorted codes hardly vary and compress well."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8).T).tobytes()


def packed_slices(grp: np.ndarray, codes: np.ndarray, owner: np.ndarray, ids: np.ndarray, small: int = 256):
    """Yield Arrow columns (grp, codes, refs, docs), a row for each run of equal ``grp``.

    ``codes`` (64 bits, ascending with ``grp``) belong to the documents ``ids[owner]``. Long runs name their documents once and refer to
    them; with many groups runs are short, and all rows are then made at once with a doc_id beside every code.
    """
    edges = breaks(grp)
    if len(codes) < small * (len(edges) - 1):
        for k in range(0, len(edges) - 1, 4096):
            e = edges[k:k + 4097]
            a, b = e[0], e[-1]
            yield [pa.array(grp[e[:-1]], pa.int32()), blobs(codes[a:b], e - a), pa.nulls(len(e) - 1, pa.binary()), blobs(ids[owner[a:b]].astype(np.int64), e - a)]
        return
    for a, b in zip(edges[:-1], edges[1:]):
        used, refs = np.unique(owner[a:b], return_inverse=True)
        refs = refs.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        docs = np.diff(ids[used], prepend=0).astype(np.int64)
        yield [pa.array([int(grp[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in (planes(codes[a:b]), refs.tobytes(), docs.tobytes()))]


def unpacked_slice(codes: bytes, refs: bytes | None, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, doc_ids) of a row of ``packed_slices``."""
    if refs is None:
        return np.frombuffer(codes, np.uint64), np.frombuffer(docs, np.int64)
    codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return codes, np.cumsum(np.frombuffer(docs, np.int64))[np.frombuffer(refs, np.uint16 if len(refs) == 2 * len(codes) else np.uint32)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) with the connectivity of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _forest_stream(text: bool):
    def rows(stream):
        a, b = [], []
        for batch in stream:
            for held, name in ((a, "a"), (b, "b")):
                column = batch.column(name)
                held.append(np.array(column.to_pylist(), "S") if text else column.to_numpy())
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            kind = pa.string() if text else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(str) if text else v, kind) for v in (x, y)], ["a", "b"])
    return rows


def settled(edges: DataFrame) -> bool:
    """Whether the distinct ``edges`` (a, b smaller than a) are stars: no node has two edges down, or one down and one up."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return not nodes.agg(F.bool_or((F.col("down") > 1) | (F.col("down") == 1) & (F.col("least") == 0))).first()[0]


def components(edges: DataFrame, name: str = "components", rounds: int = 60, kind: str = "BIGINT") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b of ``kind``, BIGINT or ASCII STRING); component is the smallest node reachable.

    Alternating large and small stars. First each task replaces its own edges by a spanning forest of them, which shrinks
    dense groups without gathering any; then every round is two aggregations and two joins over the remaining edges, written
    to shared storage, until all edges form stars. Minima combine on the map side; in the two joins the edges of a star's centre share a key, which only Spark's skew join splits. Nulls
    and loops are left out; an empty table gives an empty result.
    """
    local = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast(kind), F.col("b").cast(kind))
             .mapInArrow(_forest_stream(kind == "STRING"), f"a {kind}, b {kind}"))
    now = keep(local.distinct(), name)
    for _ in range(rounds):
        if settled(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (merged(both, low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = merged(large, small, "a")
        pulled = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(pulled.union(small.select("a", F.col("m").alias("b"))).distinct(), name)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
