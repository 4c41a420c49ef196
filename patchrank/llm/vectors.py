"""Embedding near-dedup as an exact metric range join.

The angle between vectors is a metric. Within a label, pivots partition the vectors: a vector is owned by the cell of its nearest
pivot. Two vectors within angle r can be in different cells i and j only if d(x, p_j) <= d(x, p_i) + 2 r, so a vector also visits
every cell that meets this bound; nothing else needs to. The pivots of a label reach a task once for a few thousand of its vectors. Cells then join independently: visitors and owners against owners, so
each vector meets each possible partner once. A cell over ``chunk`` rows is cut into owner chunks and query chunks whose pairs
are blocks; blocks return counts and a spanning forest, never pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm.common import components, forest, keep, spread

PIVOTS = 64
SLACK = 1e-6  # radians, far above rounding


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, label, embedding) that can link: label known, every component finite, norm not zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(fine & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("bigint"), "label", F.col("embedding").cast(kept_type(vectors))).dropDuplicates()


def kept_type(vectors: DataFrame) -> str:
    """Embeddings travel as they are if they are FLOAT; they are doubles once a task reads them."""
    return "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def with_pivots(points: DataFrame, cell_rows: int) -> DataFrame:
    """(label, _dim, vec_id, embedding, _pivots), dealt in groups of about ``cell_rows`` vectors of a label, each behind one row that holds the label's pivots alone.

    Pivots are vectors drawn by hash: about one for ``cell_rows`` rows of the label, 1 to 2 * PIVOTS.
    """
    draw = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40))
    share = F.least(F.lit(PIVOTS), F.floor(F.col("_n") / cell_rows)) / F.col("_n")
    points = points.withColumn("_dim", F.size("embedding"))
    sizes = points.groupBy("label", "_dim").agg(F.count(F.lit(1)).alias("_n"), F.min_by("embedding", draw).alias("_first"))
    parts = F.ceil(F.col("_n") / cell_rows).cast("int")
    drawn = (points.join(sizes.drop("_first"), ["label", "_dim"])
             .where(draw < share * F.lit(float(1 << 40))).select("label", "_dim", F.struct(draw.alias("d"), "embedding").alias("p"))
             .groupBy("label", "_dim").agg(F.slice(F.sort_array(F.collect_list("p")), 1, 2 * PIVOTS).alias("_p")))
    pivots = sizes.join(drawn, ["label", "_dim"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    pivots = pivots.select("label", "_dim", "_part", F.concat(F.array("_first"), F.coalesce(F.col("_p.embedding"), F.array())).alias("_pivots"))
    part = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), parts).cast("int")
    rows = points.join(sizes.drop("_first"), ["label", "_dim"]).select("label", "_dim", part.alias("_part"), "vec_id", "embedding")
    dealt = rows.unionByName(pivots, allowMissingColumns=True).repartition("label", "_dim", "_part")
    return dealt.sortWithinPartitions("label", "_dim", "_part", F.col("_pivots").isNull()).select("label", "_dim", "vec_id", "embedding", "_pivots")


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.max(np.abs(rows), axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _assign(radius: float, most: int = 1 << 15):
    """One row per cell that a vector owns or visits, in batches of about ``most`` rows or fewer."""
    def rows(stream):
        p = None  # of the group read now
        for batch in stream:
            heads = np.flatnonzero(batch.column("_pivots").is_valid().to_numpy(zero_copy_only=False))
            edges = [0, *heads.tolist(), batch.num_rows]
            plain = batch.drop_columns(["_pivots"])
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if i:  # a row of pivots, then vectors
                    p = unit(np.array(batch.column("_pivots")[a].as_py(), np.float64))
                    a += 1
                while a < b:
                    part = plain.slice(a, min(b - a, max(1, most // len(p))))
                    a += part.num_rows
                    x = unit(_matrix(part.column("embedding"), p.shape[1]))
                    angle = np.arccos(np.clip(x @ p.T, -1, 1))
                    own = angle.argmin(axis=1)
                    near = angle <= angle[np.arange(len(x)), own][:, None] + 2 * radius + SLACK
                    row, cell = np.nonzero(near)
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("label"), out.column("_dim"), pa.array(cell, pa.int32()), pa.array(own[row] == cell), out.column("vec_id"), out.column("embedding")],
                        ["label", "_dim", "cell", "owner", "vec_id", "embedding"])
    return rows


def block_links(ids, x, owner, query, least: float, tile: int = 1 << 21):
    """(query numbers, link counts, star edges) of one block: its queries against its owners."""
    o, q = np.flatnonzero(owner), np.flatnonzero(query)
    counts, a, b = np.zeros(len(q), np.int64), [], []
    step = max(1, tile // max(1, len(o)))
    for s in range(0, len(q), step):
        linked = (x[q[s:s + step]] @ x[o].T >= least) & (ids[q[s:s + step]][:, None] != ids[o][None, :])
        counts[s:s + step] = linked.sum(axis=1)
        i, j = np.nonzero(linked)
        if len(i):
            e = forest(ids[q[s + i]], ids[o[j]])
            a.append(e[0])
            b.append(e[1])
    return q, counts, (forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64)))


def _blocks(least: float):
    def rows(stream):
        key, held = None, []

        def close():
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["vec_id"].to_numpy()
            x = unit(_matrix(table["embedding"].combine_chunks(), key[1]))
            q, n, (a, b) = block_links(ids, x, table["is_owner"].to_numpy(), table["is_query"].to_numpy(), least)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[some]], pa.int64()), pa.array(n[some], pa.int64()), pa.nulls(int(some.sum()), pa.int64())], ["a", "n", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], ["a", "n", "b"])

        for batch in stream:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("label", "_dim", "cell", "o", "q"))))
            start = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[start]:
                    if names[start] != key:
                        yield from close()
                        key, held = names[start], []
                    held.append(batch.slice(start, i - start))
                    start = i
        yield from close()
    return rows


def links(vectors: DataFrame, least: float = 0.93, cell_rows: int = 4096, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((vec_id, n_links) of vectors with links, (node, component)) for pairs of equal label with cosine >= ``least``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors without a label or a
    vec_id. Repeated rows are one vector; other rows that share a vec_id are one node. Only vectors of one length are compared.
    """
    spark = vectors.sparkSession
    points = with_pivots(usable(vectors), cell_rows)
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"label {kind}, _dim INT, cell INT, owner BOOLEAN, vec_id BIGINT, embedding {kept_type(vectors)}"
    cells = keep(points.mapInArrow(_assign(float(np.arccos(least))), schema), "vector-cells")
    keys = ["label", "_dim", "cell"]
    sizes = cells.groupBy(keys).agg(F.ceil(F.count_if("owner") / chunk).cast("int").alias("_o"), F.ceil(F.count(F.lit(1)) / (4 * chunk)).cast("int").alias("_q"))
    mine = F.pmod(F.xxhash64("vec_id"), F.greatest("_o", F.lit(1))).cast("int")
    asked = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("_q")).cast("int")
    as_owner = F.when(F.col("owner"), F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda q: F.struct(mine.alias("o"), q.alias("q"))))
    as_query = F.when(F.col("_o") > 0, F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda o: F.struct(o.alias("o"), asked.alias("q"))))
    none = F.array().cast("array<struct<o:int,q:int>>")
    placed = (cells.join(sizes, keys).withColumn("_at", F.explode(F.array_union(F.coalesce(as_owner, none), F.coalesce(as_query, none))))
              .select(*keys, "vec_id", "embedding", F.col("_at.o").alias("o"), F.col("_at.q").alias("q"),
                      (F.col("owner") & (F.col("_at.o") == mine)).alias("is_owner"), (F.col("_at.q") == asked).alias("is_query")))
    by = [*keys, "o", "q"]
    found = keep(placed.repartition(spread(spark, 0, 1), *by).sortWithinPartitions(*by).mapInArrow(_blocks(least), "a BIGINT, n BIGINT, b BIGINT"), "vector-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    return counts, components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")


def classes_of(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    counts, found = links(vectors, **options)
    info = counts.join(found, counts["vec_id"] == found["node"]).select("node", "n_links", "component")
    rows = vectors.select(F.col("vec_id").cast("bigint"))
    joined = rows.join(info, rows["vec_id"] == info["node"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         (F.col("vec_id") == component).alias("kept"))


def dedup(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``vectors`` that are not linked, however far, to a smaller vec_id."""
    _, found = links(vectors, **options)
    gone = found.where("node <> component").select(F.col("node").alias("_node"))
    return vectors.join(gone, vectors["vec_id"] == gone["_node"], "left_anti")
