"""Several scores of a bag, ranked by the task that holds the bag.

The instances of a bag are shuffled once, whatever the number of scores: scores are expressions that are evaluated behind the
exchange. Bags of more than ``hot_rows`` instances, and those of unknown size, are ranked in buckets by ``ranking`` instead.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import block_draws, draws
from . import ranking as rk
from .scale import HOT_ROWS


def dense_ranks(score: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of every score among the distinct ones, from 0, and how many there are; NaN is one value, the largest."""
    order = np.argsort(score)
    s = score[order]
    rank = np.zeros(len(s), np.int64)
    rank[order[1:]] = np.cumsum((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])))
    return rank, int(rank.max(initial=-1)) + 1


def concordant(bag: np.ndarray, bags: int, stratum: np.ndarray, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, twice the concordant ones with ties once) of every bag, counted inside its strata; a stratum belongs to one bag."""
    if not len(score):
        return np.zeros(bags, np.int64), np.zeros(bags, np.int64)
    rank, ranks = dense_ranks(score)
    code = stratum * ranks + rank
    order = np.argsort(code)
    code, y = code[order], y[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    pos = np.add.reduceat(y, at)
    neg = np.diff(np.append(at, len(code))) - pos
    of = code[at] // ranks
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    before = np.cumsum(neg) - neg
    before -= np.repeat(before[first], np.diff(np.append(first, len(at))))
    twice = np.add.reduceat(pos * (2 * before + neg), first)
    pairs = np.add.reduceat(pos, first) * np.add.reduceat(neg, first)
    owner = bag[order[at[first]]]
    return tuple(_by_bag(owner, bags, x) for x in (pairs, twice))


def _by_bag(bag: np.ndarray, bags: int, x: np.ndarray) -> np.ndarray:
    out = np.zeros(bags, np.int64)
    np.add.at(out, bag, x)  # whole numbers: exact beyond 2**53
    return out


def _ratio(pairs: np.ndarray, twice: np.ndarray) -> pa.Array:
    return pa.array(twice / 2 / np.maximum(pairs, 1), mask=pairs == 0)


def _axes_of_score(n_patch: int) -> Callable:
    def axes(bag, bags, score, y, of_slice, has, _):
        n, p = np.bincount(bag, minlength=bags), _by_bag(bag, bags, y)
        own, at = np.unique(bag * (of_slice.max(initial=0) + 1) + of_slice, return_inverse=True)
        slice_bag = np.zeros(len(own), np.int64)
        slice_bag[at] = bag
        slices = np.bincount(slice_bag, minlength=bags)
        kept = (n == slices * n_patch) & (p > 0) & (p < n)  # neither ragged nor of one class
        row, held = kept[bag], np.zeros(len(own), np.int64)
        held[at[has > 0]] = 1
        bag, score, y, at, has = (x[row] for x in (bag, score, y, at, has))
        grid = score[np.lexsort((score, at))].reshape(-1, n_patch)
        means = (np.cumsum(grid, axis=1)[:, -1:] / n_patch).astype(np.float32).astype(np.float64)[:, 0]  # added in sorted order, as elsewhere
        slice_bag, held = slice_bag[kept[slice_bag]], held[kept[slice_bag]]
        inside = has > 0
        flat, by_slice = concordant(bag, bags, bag, score, y), concordant(slice_bag, bags, slice_bag, means, held)
        within = concordant(bag[inside], bags, bag[inside], score[inside], y[inside])
        lesions = _by_bag(slice_bag, bags, held)
        at = np.flatnonzero(kept)
        return [(at, [*(_ratio(a[at], b[at]) for a, b in (flat, by_slice, within)), pa.array(slices[at]), pa.array(lesions[at])])]
    return axes


def _modes_of_score(bag, bags, score, y, of_slice, has, rbin):
    bins, slices = rbin.max(initial=0) + 1, of_slice.max(initial=0) + 1
    every, out = np.ones(len(bag), bool), []
    for mode, stratum, rows in (("raw", bag, every), ("radial", bag * bins + rbin, every), ("joint", (bag * slices + of_slice) * bins + rbin, every), ("slice", bag, has > 0)):
        pairs, twice = concordant(bag[rows], bags, stratum[rows], score[rows], y[rows])
        at = np.unique(bag[rows])
        out.append((at, [pa.array([mode] * len(at), pa.string()), _ratio(pairs[at], twice[at]), pa.array(pairs[at])]))
    return out


def _whole_bags(stream, keys: list[str]):
    """Tables of whole bags with the number of every row's bag; the rows of a bag are neighbours in the stream."""
    held = []
    for batch in stream:
        held.append(batch)
        table = pa.Table.from_batches(held)
        edges = _edges(table, keys)
        if len(edges) > 1:  # the last bag may go on
            yield table.slice(0, edges[-1]), edges[:-1]
            held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a bag begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _bags(keys: list[str], labels: list[str], schema: pa.Schema, measure: Callable):
    def rows(stream):
        for table, edges in _whole_bags(stream, keys):
            bag = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, table.num_rows)))
            columns = [table[c].to_numpy() for c in ("_y", "_slice", "_has", "_rbin")]
            heads = table.select(keys).take(pa.array(edges))
            for i, label in enumerate(labels):
                score = table[f"_s{i}"].to_numpy()  # NULL is NaN
                known = ~np.isnan(score)
                for at, found in measure(bag[known], len(edges), score[known], *(c[known] for c in columns)):
                    named = [c.combine_chunks() for c in heads.take(pa.array(at)).columns]
                    yield pa.RecordBatch.from_arrays([*named, pa.array([label] * len(at), pa.string()), *found], schema=schema)
    return rows


def _in_place(rows: DataFrame, keys: Sequence[str], scores: Mapping[str, Column], target: str, rbin: Column, columns: str, measure: Callable) -> DataFrame:
    placed = rows.where(F.col(target).isNotNull()).repartition(*keys)
    wide = placed.select(*keys, (F.col(target) > 0).cast("bigint").alias("_y"), F.col("slice").cast("bigint").alias("_slice"), F.col("slice_pos").cast("bigint").alias("_has"),
                         rbin.cast("bigint").alias("_rbin"), *[s.cast("double").alias(f"_s{i}") for i, s in enumerate(scores.values())])
    schema = StructType([*(wide.schema[k] for k in keys), *StructType.fromDDL(f"scorer STRING, {columns}")])
    return wide.sortWithinPartitions(*keys).mapInArrow(_bags(list(keys), list(scores), to_arrow_schema(schema), measure), schema)


def _long(rows: DataFrame, kept: Sequence[str], scores: Mapping[str, Column]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), s.cast("double").alias("score")) for n, s in scores.items()])
    return rows.withColumn("_e", F.explode(each)).select(*kept, "_e.*")


def axes(df: DataFrame, n_patch: int, scores: Mapping[str, Column], keys: Sequence[str] = ("bag_id",), target: str = "target",
         hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ranking.axes`` of every bag under every named score: (keys, scorer, flat, slice, within_slice, n_slices, n_lesion_slices).

    Needs slice, slice_pos and n_slices, a bound of a bag's slices. Rows without a score or a target are left out, per score.
    """
    keys = list(keys)
    small, large = rk.by_size(df, "n_slices", max(hot_rows // n_patch, 0))
    out = _in_place(small, keys, scores, target, F.lit(0), "flat DOUBLE, slice DOUBLE, within_slice DOUBLE, n_slices BIGINT, n_lesion_slices BIGINT", _axes_of_score(n_patch))
    rest = _long(large, [*keys, "slice", "n_slices", "slice_pos", target], scores)
    return out.unionByName(rk.axes(rest, n_patch, ["scorer", *keys], "score", target, hot_rows))


def stratified_axes(df: DataFrame, n_patch: int, scores: Mapping[str, Column], keys: Sequence[str] = ("bag_id",), target: str = "target",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ranking.stratified_axes`` of every bag under every named score: (keys, scorer, mode, auc, n_pairs). Needs rbin as well."""
    keys = list(keys)
    small, large = rk.by_size(df, "n_slices", max(hot_rows // n_patch, 0))
    out = _in_place(small, keys, scores, target, F.col("rbin"), "mode STRING, auc DOUBLE, n_pairs BIGINT", _modes_of_score)
    rest = _long(large, [*keys, "slice", "rbin", "slice_pos", target], scores)
    return out.unionByName(rk.stratified_axes(rest, ["scorer", *keys], "score", target).select(*out.columns))


def _held(rows: DataFrame, keys: list[str], slots: Sequence[str] = ()) -> DataFrame:
    """Instances behind one exchange by bag, with the text that keys their draws; a NULL target is NaN.

    Their work is far larger than their bytes, so the partitions are not merged by size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).select(
        *keys, draws.text_key(*[F.col(k) for k in keys], F.col("pos")).alias("_text"), F.col("target").cast("double").alias("_t"),
        *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(slots)]).sortWithinPartitions(*keys)


def _aucs(edges: np.ndarray, score: np.ndarray, target: np.ndarray) -> pa.Array:
    """AUC of every bag; NULL where a class is missing. Rows without a score or a target are left out."""
    bag = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(target))))
    known = ~np.isnan(target) & ~np.isnan(score)
    return _ratio(*concordant(bag[known], len(edges), bag[known], score[known], (target[known] > 0).astype(np.int64)))


def _shares(edges: np.ndarray, score: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Share of a score's mass inside the lesion, per bag."""
    mass, inside = (np.add.reduceat(np.where(np.isnan(x), 0.0, x), edges) for x in (score, score * target))
    return inside / np.maximum(mass, 1e-8)


def _random_rows(keys: list[str], schema: pa.Schema, seed: str, inits: int, k: int, frozen: Mapping[int, int] | None):
    def rows(stream):
        for table, edges in _whole_bags(stream, keys):
            texts, target = block_draws.Keys(table["_text"].combine_chunks()), table["_t"].to_numpy()
            heads = [c.combine_chunks() for c in table.select(keys).take(pa.array(edges)).columns]
            for model in range(inits):
                if frozen is not None and model not in frozen:
                    continue
                scores = block_draws.random_slots(texts.normals(f"{seed}m{model}", k), 1.0, [0.0] * k)
                for slot in range(k) if frozen is None else [frozen[model]]:
                    found = pa.array(_shares(edges, scores[slot], target)) if frozen is None else _aucs(edges, scores[slot], target)
                    names = [pa.array(np.full(len(edges), x, np.int32)) for x in (model, slot)]
                    yield pa.RecordBatch.from_arrays([*heads, *names, found], schema=schema)
    return rows


def untrained(rows: DataFrame, k: int, inits: int, seed: int = 0, frozen: Mapping[int, int] | None = None, keys: Sequence[str] = ("bag_id",)) -> DataFrame:
    """Random attention over ``k`` slots of every untrained init, drawn, normalised and measured by the task that holds the bag.

    Without ``frozen`` (keys, model, slot, value): the share of each slot's mass inside the lesion. With it, the one slot of every model,
    (keys, model, slot, auc). Scores never leave the task: an instance is shuffled once, whatever the number of inits. For bags of a bounded size.
    """
    keys = list(keys)
    wide = _held(rows, keys)
    schema = StructType([*(wide.schema[x] for x in keys), *StructType.fromDDL(f"model INT, slot INT, {'value' if frozen is None else 'auc'} DOUBLE")])
    return wide.mapInArrow(_random_rows(keys, to_arrow_schema(schema), str(seed), inits, k, frozen), schema)


MEASURES = "`null` STRING, rep INT, slot INT, value DOUBLE, auc DOUBLE"


def _battery_rows(keys: list[str], schema: pa.Schema, seed: str, reps: int, k: int, kinds: Sequence[tuple[str, float, float]], bias: Sequence[float]):
    def rows(stream):
        for table, edges in _whole_bags(stream, keys):
            texts, target = block_draws.Keys(table["_text"].combine_chunks()), table["_t"].to_numpy()
            heads = [c.combine_chunks() for c in table.select(keys).take(pa.array(edges)).columns]

            def measured(null, rep, scores):
                for slot, score in enumerate(scores):
                    names = [pa.array([null] * len(edges), pa.string()), *(pa.array(np.full(len(edges), x, np.int32)) for x in (rep, slot))]
                    yield pa.RecordBatch.from_arrays([*heads, *names, pa.array(_shares(edges, score, target)), _aucs(edges, score, target)], schema=schema)
            yield from measured("reference", 0, [table[f"_s{i}"].to_numpy() for i in range(k)])
            for rep in range(reps):
                normals = texts.normals(f"{seed}r{rep}", k)
                for null, scale, biased in kinds:
                    yield from measured(null, rep, block_draws.random_slots(normals, scale, [biased * b for b in bias]))
    return rows


def battery(rows: DataFrame, slots: Sequence[str], kinds: Sequence[tuple[str, float, float]], reps: int, seed: int, bias: Sequence[float],
            keys: Sequence[str] = ("bag_id",)) -> DataFrame:
    """(keys, null, rep, slot, value, auc) of every bag under its own slots and under random ones: lesion share and AUC.

    ``kinds`` are (null, scale, weight of the bias). The normals of a replicate serve all kinds, and no score leaves its task. For bags of a bounded size.
    """
    keys = list(keys)
    wide = _held(rows, keys, slots)
    schema = StructType([*(wide.schema[x] for x in keys), *StructType.fromDDL(MEASURES)])
    return wide.mapInArrow(_battery_rows(keys, to_arrow_schema(schema), str(seed), reps, len(slots), list(kinds), list(bias)), schema)


def _measures_of_lists(k: int, schema: pa.Schema):
    def bag(key, rows: pa.Table, moved: pa.Table) -> pa.Table:
        if not rows.num_rows or not moved.num_rows:
            return schema.empty_table()
        order = np.argsort(rows["pos"].to_numpy())
        positions = rows["pos"].to_numpy()[order]
        values, edges = rk.list_rows(moved["positives"])
        x = np.minimum(np.searchsorted(positions, values), len(positions) - 1)
        hit, out = positions[x] == values, []
        for slot in range(k):
            score = rows[f"_s{slot}"].to_numpy()[order]
            known = ~np.isnan(score)
            _, at, count = np.unique(score[known], return_inverse=True, return_counts=True)
            twice = np.zeros(len(score), np.int64)
            twice[known] = (2 * np.cumsum(count) - count + 1)[at]
            found = hit & known[x]
            p, total, inside = (np.concatenate([[0], np.cumsum(np.where(found, c, 0))]) for c in (1, twice[x], score[x]))
            p, total, inside = (c[edges[1:]] - c[edges[:-1]] for c in (p, total, inside))
            pairs = 2.0 * p * (known.sum() - p)
            n = len(p)
            out.append(pa.Table.from_arrays([
                pa.array([key[0].as_py()] * n, schema.field(0).type), moved["null"].combine_chunks(), moved["rep"].combine_chunks().cast(pa.int32()), pa.array(np.full(n, slot, np.int32)),
                pa.array(inside / max(score[known].sum(), 1e-8)), pa.array((total - p * (p + 1)) / np.where(pairs > 0, pairs, 1), mask=pairs == 0)], schema=schema))
        return pa.concat_tables(out)
    return bag


def measures_of_lists(rows: DataFrame, slots: Sequence[str], lists: DataFrame) -> DataFrame:
    """(bag_id, null, rep, slot, value, auc): lesion share and AUC of every slot under the positives of ``lists`` (bag_id, null, rep, positives).

    A list without a positive has a share of 0. For bags of a bounded size and targets of 0 or 1.
    """
    wide = rows.select(F.col("bag_id").alias("_bag"), F.col("pos").cast("bigint").alias("pos"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(slots)])
    schema = StructType([rows.schema["bag_id"], *StructType.fromDDL(MEASURES)])
    grouped = wide.groupBy("_bag").cogroup(lists.select("bag_id", "null", "rep", "positives").groupBy("bag_id"))
    return grouped.applyInArrow(_measures_of_lists(len(slots), to_arrow_schema(schema)), schema)
