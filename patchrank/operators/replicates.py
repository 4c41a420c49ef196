"""Bootstrap replicates as arrays: one row for a batch of replicates, never one for each of its draws.

A group of C units has C draws with replacement in every replicate. Groups of up to ``DIRECT`` units take the draws of ``functions.draws``
(the leading 32 bits of an MD5 over seed, replicate and turn, modulo C), so another engine reproduces them; they are made once for all
groups of a batch. Larger groups are cut into blocks of ``BLOCK`` units. How many draws of a replicate fall into a block follows from binomial
splits along the binary tree over the blocks, drawn from generators that are seeded by the tree's nodes: every block finds its own
numbers without seeing another, and together they are an exact multinomial. Only arrays over the replicates of a batch are shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scale import positions, running

DIRECT = 16384  # units whose draws are taken one by one
BLOCK = 4096    # units of a block of a larger group
BATCH = 250    # replicates of a row


def draw_matrix(seed: int, reps: np.ndarray, turns: range) -> np.ndarray:
    """Draws (32 bits) of ``turns`` in ``reps``, one row per replicate."""
    names = [str(t).encode() for t in turns]
    out = np.empty((len(reps), len(names)), np.int64)
    for k, rep in enumerate(reps.tolist()):
        lead = hashlib.md5(f"{seed}|{rep}|".encode())
        found = []
        for name in names:
            h = lead.copy()
            h.update(name)
            found.append(h.digest()[:4])
        out[k] = np.frombuffer(b"".join(found), ">u4")
    return out


class Draws:
    """The draws of one batch, grown to the widest group met."""

    def __init__(self, seed: int, reps: int):
        self.seed, self.reps, self.batch, self.sizes = seed, reps, None, {}

    def picks(self, batch: int, size: int) -> np.ndarray:
        """Numbers of the units drawn: replicates by turns."""
        if batch != self.batch:
            self.batch, self.sizes = batch, {}
            self.matrix = np.empty((len(replicates_of(batch, self.reps)), 0), np.int64)
        have = self.matrix.shape[1]
        if have < size:
            more = draw_matrix(self.seed, replicates_of(batch, self.reps), range(have, size))
            self.matrix = np.concatenate([self.matrix, more], axis=1)
        if size not in self.sizes:
            if len(self.sizes) >= 8 or sum(x.size for x in self.sizes.values()) > DIRECT * BATCH:
                self.sizes = {}
            self.sizes[size] = self.matrix[:, :size] % size
        return self.sizes[size]


def replicates_of(batch: int, reps: int) -> np.ndarray:
    return np.arange(batch * BATCH, min(reps, (batch + 1) * BATCH))


def generator(*key) -> np.random.Generator:
    """A generator that depends on its key alone, so a repeated task draws the same."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest(), "little")))


def block_draws(seed: int, batch: int, reps: int, block: int, starts: Callable[[int], int], blocks: int) -> np.ndarray:
    """Draws that fall into ``block`` in each replicate of a batch; ``starts`` gives the units before a block, and all units for ``blocks``."""
    low, high = 0, blocks
    n = np.full(reps, starts(blocks), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        whole = starts(high) - starts(low)
        left = generator(seed, batch, "split", low, high).binomial(n, (starts(middle) - starts(low)) / whole)
        if block < middle:
            n, high = left, middle
        else:
            n, low = n - left, middle
    return n


def _kept(batch: pa.RecordBatch, names: Sequence[str], **added) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added.values()], [*names, *added])


def _doubles(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64()))


def _batches(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // BATCH))))


def _cluster_sums(names: Sequence[str], seed: int, reps: int, width: int):
    def rows(stream):
        draws = Draws(seed, reps)
        for batch in stream:
            totals, counts = [], []
            for b, size, block, total, count in zip(*(batch.column(c).to_pylist() for c in ("_batch", "_size", "_block", "_totals", "_counts"))):
                total, count = np.array(total, np.float64), np.array(count, np.float64)
                if size <= DIRECT:
                    ix = draws.picks(b, size)
                    totals.append(total[ix].sum(axis=1))
                    counts.append(count[ix].sum(axis=1))
                    continue
                n = block_draws(seed, b, len(replicates_of(b, reps)), block, lambda k, size=size: min(k * width, size), -(-size // width))
                rng = generator(seed, b, "picks", block)
                ix = [rng.integers(0, len(total), k) for k in n.tolist()]
                totals.append(np.array([total[x].sum() for x in ix]))
                counts.append(np.array([count[x].sum() for x in ix]))
            yield _kept(batch, names, _t=_doubles(totals), _n=_doubles(counts))
    return rows


def cluster_means(numbered: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(keys, means ARRAY<DOUBLE>) of the replicates; ``numbered`` has ix, size, total and rows of every cluster of a key."""
    keys, width = list(keys), min(BLOCK, DIRECT)
    block = F.when(F.col("size") <= DIRECT, F.lit(0)).otherwise(F.floor(F.col("ix") / width)).cast("bigint")
    units = F.array_sort(F.collect_list(F.struct("ix", "total", "rows")))
    blocks = numbered.groupBy(*keys, F.col("size").alias("_size"), block.alias("_block")).agg(units.alias("_u")).select(
        *keys, "_size", "_block", F.col("_u.total").cast("array<double>").alias("_totals"), F.col("_u.rows").cast("array<double>").alias("_counts"))
    names = [*keys, "_size", "_batch"]
    dealt = _batches(blocks, reps).repartition("_block", "_batch").sortWithinPartitions("_batch", "_size")  # groups of a batch share its draws
    schema = StructType([*dealt.select(*names).schema, *StructType.fromDDL("_t ARRAY<DOUBLE>, _n ARRAY<DOUBLE>")])
    sums = dealt.mapInArrow(_cluster_sums(names, seed, reps, width), schema)
    if numbered.where(F.col("size") > DIRECT).isEmpty():
        per = sums.select(*keys, F.zip_with("_t", "_n", lambda t, n: t / n).alias("_m"))
    else:  # the blocks of a key add up by replicate
        each = sums.select(*keys, "_batch", F.posexplode(F.arrays_zip("_t", "_n")).alias("_rep", "_s"))
        added = each.groupBy(*keys, "_batch", "_rep").agg((F.sum("_s._t") / F.sum("_s._n")).alias("_x"))
        per = added.groupBy(*keys, "_batch").agg(F.collect_list("_x").alias("_m"))
    return per.groupBy(*keys).agg(F.flatten(F.collect_list("_m")).alias("means"))


def percentile_of(values: Column, p: float) -> Column:
    """Linearly interpolated percentile of a sorted array, NULL if it is empty."""
    at = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def edges(means: DataFrame, keys: Sequence[str], alpha: float, name: str = "means") -> DataFrame:
    """(keys, lo, hi) of an array of replicates; NULL replicates are left out."""
    ordered = means.select(*keys, F.array_sort(F.array_compact(name)).alias("_v"))
    return ordered.select(*keys, percentile_of(F.col("_v"), alpha / 2).alias("lo"), percentile_of(F.col("_v"), 1 - alpha / 2).alias("hi"))


CELLS = ("tp", "fp", "fn", "tn")
RANKED = "_pos ARRAY<DOUBLE>, _neg ARRAY<DOUBLE>, _inner ARRAY<DOUBLE>, " + ", ".join(f"{c} ARRAY<DOUBLE>" for c in CELLS)


def _rank_sums(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray, cut: float) -> list[np.ndarray]:
    """By replicate: weights of both classes, concordant pairs within, and the four cells at the cut. ``pos``, ``neg``: replicates by distinct scores, ascending."""
    before = np.cumsum(neg, axis=1) - neg
    hit = scores > cut
    return [pos.sum(axis=1), neg.sum(axis=1), (pos * (before + neg / 2)).sum(axis=1),
            pos[:, hit].sum(axis=1), neg[:, hit].sum(axis=1), pos[:, ~hit].sum(axis=1), neg[:, ~hit].sum(axis=1)]


def _ranked(seed: int, reps: int, cut: float):
    def rows(stream):
        draws = Draws(seed, reps)
        for batch in stream:
            found = [[] for _ in range(7)]
            for b, block, order, score, p, q, starts in zip(*(batch.column(c).to_pylist() for c in ("_batch", "_block", "_order", "_score", "_p", "_q", "_starts"))):
                score, p, q = np.array(score, np.float64), np.array(p, np.int64), np.array(q, np.int64)
                n = len(replicates_of(b, reps))
                if order is not None:  # unit -> score and class, drawn one by one
                    ix = np.array(order, np.int64)[draws.picks(b, len(order))]
                    w = np.stack([np.bincount(x, minlength=2 * len(score)) for x in ix]).reshape(n, len(score), 2).astype(np.float64)
                    pos, neg = w[:, :, 1], w[:, :, 0]
                else:
                    k = block_draws(seed, b, n, block, starts.__getitem__, len(starts) - 1)
                    share = np.concatenate([p, q]) / (p.sum() + q.sum())
                    w = generator(seed, b, "weights", block).multinomial(k, share).astype(np.float64)
                    pos, neg = w[:, :len(p)], w[:, len(p):]
                for held, x in zip(found, _rank_sums(score, pos, neg, cut)):
                    held.append(x)
            yield _kept(batch, ["_batch", "_block"], **dict(zip(["_pos", "_neg", "_inner", *CELLS], map(_doubles, found))))
    return rows


def rank_replicates(df: DataFrame, key: str, y: str, score: str, reps: int, seed: int, cut: float = 0.5, direct: int = BLOCK) -> DataFrame:
    """A row per replicate of resampled rows: n_pos, n_neg, concordant (pairs in order, ties half), and the cells tp, fp, fn, tn at the cut.

    A replicate is a set of weights over the histogram of scores. Tables above ``direct`` rows are cut into blocks of neighbouring scores;
    a block sends its sums, and a window over the blocks of a replicate adds the pairs between them.
    """
    rows = df.select(F.md5(F.col(key).cast("string")).alias("_h"), F.col(key).alias("_k"), (F.col(y) == 1).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    rows = rows.where("y IS NOT NULL AND s IS NOT NULL")
    hist = rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).withColumn("m", F.col("p") + F.col("q"))
    cum = running(hist.withColumn("_all", F.lit(0)), ["_all"], "s", ["m"])
    placed = cum.withColumn("_block", F.when(F.col("all_m") <= direct, 0).otherwise(F.floor(F.col("before_m") / direct)).cast("bigint"))
    cells = F.array_sort(F.collect_list(F.struct("s", "p", "q")))
    blocks = placed.groupBy("_block").agg(cells.alias("_c"), F.min("before_m").alias("_from"), F.max("all_m").alias("_all"))
    if rows.count() <= direct:
        numbered = positions(rows.withColumn("_lead", F.substring("_h", 1, 3)), [], ["_lead"], ["_h", "_k"], "ix")
        units = numbered.agg(F.array_sort(F.collect_list(F.struct("ix", "s", "y"))).alias("_u"))
        place = F.transform("_u", lambda u: 2 * (F.array_position(F.col("_c.s"), u["s"]) - 1) + u["y"])
        full = blocks.withColumn("_u", units.scalar()).select("_block", place.alias("_order"), F.col("_c.s").alias("_score"), F.col("_c.p").alias("_p"), F.col("_c.q").alias("_q"),
                                                      F.lit(None).cast("array<bigint>").alias("_starts"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("_block", "_from")))  # a number for every block of ``direct`` rows
        starts = blocks.agg(F.struct(ordered["_block"].alias("named"), F.concat(ordered["_from"], F.array(F.max("_all"))).alias("starts"))).scalar()
        full = blocks.withColumn("_b", starts).select((F.array_position("_b.named", F.col("_block")) - 1).alias("_block"), F.lit(None).cast("array<bigint>").alias("_order"),
                                                      F.col("_c.s").alias("_score"), F.col("_c.p").alias("_p"), F.col("_c.q").alias("_q"), F.col("_b.starts").alias("_starts"))
    dealt = _batches(full, reps).repartition("_block", "_batch")
    sums = dealt.mapInArrow(_ranked(seed, reps, cut), "_batch INT, _block BIGINT, " + RANKED)
    names = ["_pos", "_neg", "_inner", *CELLS]
    each = sums.select("_batch", "_block", F.posexplode(F.arrays_zip(*names)).alias("_rep", "_s")).select("_batch", "_block", "_rep", "_s.*")
    before = F.expr("coalesce(sum(_neg) OVER (PARTITION BY _batch, _rep ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    pairs = each.withColumn("_pairs", F.col("_inner") + F.col("_pos") * before)
    return pairs.groupBy((F.col("_batch") * BATCH + F.col("_rep")).alias("rep")).agg(
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum("_pairs").alias("concordant"), *[F.sum(c).alias(c) for c in CELLS])
