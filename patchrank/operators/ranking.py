"""Tie-exact ranking metrics per group, from score histograms."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .scale import HOT_ROWS, clean, exact_mean, running, score_bucket


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def concordance(hist: DataFrame, keys: Sequence[str],
                pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Twice the number of concordant pairs per group, ties counted once.

    ``hist`` has one row per (keys, ``_b``, ``score``). Each entry of ``pairs`` names a column of
    positives, one of negatives and a prefix for the results ``<p>_pos, <p>_neg, <p>_conc2``.
    Inside one bucket a window runs over distinct scores; across buckets it runs over bucket
    totals only. Products are doubles: exact up to 2**53 and free of overflow beyond.
    """
    keys = list(keys)
    inside = (W.partitionBy(*keys, "_b").orderBy("score").rowsBetween(W.unboundedPreceding, -1))
    local = hist
    for pos, neg, name in pairs:
        ahead = F.coalesce(F.sum(neg).over(inside), F.lit(0))
        local = local.withColumn(f"_c_{name}", F.col(pos).cast("double")
                                 * (2 * ahead + F.col(neg)).cast("double"))
    parts = local.groupBy(*keys, "_b").agg(
        *[F.sum(pos).alias(f"{name}_pos") for pos, _, name in pairs],
        *[F.sum(neg).alias(f"{name}_neg") for _, neg, name in pairs],
        *[F.sum(f"_c_{name}").alias(f"{name}_part") for *_, name in pairs])
    across = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    for *_, name in pairs:
        below = F.coalesce(F.sum(f"{name}_neg").over(across), F.lit(0)).cast("double")
        parts = parts.withColumn(f"{name}_sum", F.col(f"{name}_part")
                                 + 2 * F.col(f"{name}_pos").cast("double") * below)
    return parts.groupBy(*keys).agg(
        *[F.sum(f"{name}_pos").alias(f"{name}_pos") for *_, name in pairs],
        *[F.sum(f"{name}_neg").alias(f"{name}_neg") for *_, name in pairs],
        *[F.sum(f"{name}_sum").alias(f"{name}_conc2") for *_, name in pairs])


def auc_from(name: str) -> Column:
    pos, neg = F.col(f"{name}_pos").cast("double"), F.col(f"{name}_neg").cast("double")
    return ratio(F.col(f"{name}_conc2"), 2 * pos * neg)


def ranked_in_place(rows: DataFrame, keys: Sequence[str], score: str,
                    pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``_c_<name>``: twice the negatives below plus the tied ones, times the positives.

    For groups small enough for one task. ``rows`` must be partitioned by ``keys``; both frames
    share one sort and one pass.
    """
    order = W.partitionBy(*keys).orderBy(score)
    up_to = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = order.rangeBetween(W.currentRow, W.currentRow)
    return rows.select("*", *[
        (F.col(pos).cast("double") * (2 * F.sum(neg).over(up_to) - F.sum(neg).over(tied)).cast("double")).alias(f"_c_{name}")
        for pos, neg, name in pairs])


def by_size(rows: DataFrame, size: str | None, limit: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows of groups known to be small, and the rest, those of unknown size included."""
    if size is None:
        return None, rows
    return rows.where(F.col(size) <= limit), rows.where((F.col(size) > limit) | F.col(size).isNull())


def auc(df: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target",
        weight: str | None = None, size: str | None = None,
        hot_rows: int = HOT_ROWS) -> DataFrame:
    """ROC AUC per group; NULL where a class is missing.

    Rows without a score or a target are left out. ``weight`` is an integer multiplicity. ``size`` names a column that bounds the group's row
    count: groups up to ``hot_rows`` are shuffled once and ranked in one task each, larger ones
    (and all, without ``size``) are pre-aggregated per distinct score and ranked in buckets.
    """
    keys = list(keys)
    w = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    y = F.col(target) > 0
    rows = df.select(*keys, clean(F.col(score)).alias("score"), F.when(y, w).when(~y, 0).alias("p"),
                     F.when(y, 0).when(~y, w).alias("q"), *([F.col(size).alias("_size")] if size else []))
    small, rest = by_size(rows.where(F.col("score").isNotNull() & F.col("p").isNotNull()), "_size" if size else None, hot_rows)
    hist = rest.groupBy(*keys, score_bucket(F.col("score")).alias("_b"), "score").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"))
    out = concordance(hist, keys, [("p", "q", "a")])
    if small is not None:
        placed = ranked_in_place(small.drop("_size").repartition(*keys), keys, "score", [("p", "q", "a")])
        out = out.unionByName(placed.groupBy(*keys).agg(
            F.sum("p").alias("a_pos"), F.sum("q").alias("a_neg"), F.sum("_c_a").alias("a_conc2")))
    return out.select(*keys, F.col("a_pos").alias("n_pos"), F.col("a_neg").alias("n_neg"),
                      F.col("a_conc2").alias("conc2"), auc_from("a").alias("auc"))


def midranks(df: DataFrame, keys: Sequence[str], score: str = "score", kept: Sequence[str] = ("pos",),
             size: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, kept, mr2, group_rows): twice the midrank of every row in its group, and the group's rows.

    Ranks do not depend on a target, so one ranking serves any number of permuted targets. Rows without a score are left out.
    """
    keys, kept = list(keys), list(kept)
    rows = (df.select(*keys, *kept, clean(F.col(score)).alias("score"), *([F.col(size).alias("_size")] if size else []))
            .where(F.col("score").isNotNull()))
    small, rest = by_size(rows, "_size" if size else None, hot_rows)
    rest = rest.select(*keys, *kept, "score")
    hist = rest.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("m"))
    cum = running(hist, keys, "score", ["m"])
    cum = cum.select(*keys, "score", (2 * F.col("before_m") + F.col("m") + 1).alias("mr2"), F.col("all_m").alias("group_rows"))
    out = rest.join(cum, [*keys, "score"]).select(*keys, *kept, "mr2", "group_rows")
    if small is not None:
        order = W.partitionBy(*keys).orderBy("score")
        up_to = F.count(F.lit(1)).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
        tied = F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow))
        placed = small.repartition(*keys).select(*keys, *kept, (2 * up_to - tied + 1).alias("mr2"),
                                                 F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("group_rows"))
        out = out.unionByName(placed)
    return out


def auc_of_positives(ranks: DataFrame, positives: DataFrame, keys: Sequence[str], on: Sequence[str] = ("bag_id", "pos")) -> DataFrame:
    """(keys, n_pos, auc) from midranks and the positions of the positives alone.

    ``keys`` name a group of ``ranks`` under one replicate of ``positives``. Only positives are moved, so a replicate costs as much
    as it has positives. A group without a positive gives no row; one without a negative has a NULL auc.
    """
    found = positives.join(ranks, list(on)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pos"), F.sum("mr2").cast("double").alias("_s"), F.max("group_rows").cast("double").alias("_n"))
    p = F.col("n_pos").cast("double")
    return found.select(*keys, "n_pos", ratio(F.col("_s") - p * (p + 1), 2 * p * (F.col("_n") - p)).alias("auc"))


def list_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column and where each list begins; one more edge ends the last."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edges


def _auc_of_lists(keys: list[str], labels: list[str], schema: pa.Schema):
    def bag(key, rows: pa.Table, moved: pa.Table) -> pa.Table:
        if not rows.num_rows or not moved.num_rows:
            return schema.empty_table()
        order = np.argsort(rows["pos"].to_numpy())
        positions, score = rows["pos"].to_numpy()[order], rows["score"].to_numpy()[order]
        _, at, count = np.unique(score, return_inverse=True, return_counts=True)
        twice = (2 * np.cumsum(count) - count + 1)[at]
        values, edges = list_rows(moved["positives"])
        x = np.minimum(np.searchsorted(positions, values), len(positions) - 1)
        found = positions[x] == values
        p, total = (np.concatenate([[0], np.cumsum(c)]) for c in (found.astype(np.int64), np.where(found, twice[x], 0)))
        p, total = p[edges[1:]] - p[edges[:-1]], total[edges[1:]] - total[edges[:-1]]
        n, some = len(positions), pa.array(np.flatnonzero(p))
        pairs = 2.0 * p * (n - p)
        auc = pa.array((total - p * (p + 1)) / np.where(pairs > 0, pairs, 1), mask=pairs == 0)
        first = [pa.array([k.as_py()] * len(some), schema.field(c).type) for k, c in zip(key, keys)]
        names = [moved[c].combine_chunks().take(some) for c in labels]
        return pa.Table.from_arrays([*first, *names, pa.array(p).take(some), auc.take(some)], schema=schema)
    return bag


def auc_of_lists(rows: DataFrame, lists: DataFrame, score: str = "score", keys: Sequence[str] = ("bag_id",), labels: Sequence[str] = ("rep",)) -> DataFrame:
    """``auc_of_positives`` of bags of a bounded size, whose positives come as lists (keys, labels, positives): a bag is ranked once by one task."""
    keys, labels = list(keys), list(labels)
    named = [F.col(c).alias(f"_k_{c}") for c in keys]  # names of their own: both sides may stem from one table
    scored = rows.select(*named, F.col("pos").cast("bigint").alias("pos"), clean(F.col(score)).alias("score")).where(F.col("score").isNotNull())
    schema = StructType([*(lists.schema[c] for c in [*keys, *labels]), *StructType.fromDDL("n_pos BIGINT, auc DOUBLE")])
    grouped = scored.groupBy(*[f"_k_{c}" for c in keys]).cogroup(lists.select(*keys, *labels, "positives").groupBy(*keys))
    return grouped.applyInArrow(_auc_of_lists(keys, labels, to_arrow_schema(schema)), schema)


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "score",
                      target: str = "target", size: str | None = None,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Step sum over distinct scores from the top, with prevalence; NULL without a positive.

    Rows without a score or a target are left out.
    """
    keys = list(keys)
    rows = (df.select(*keys, clean(F.col(score)).alias("score"), (F.col(target) > 0).cast("bigint").alias("p"),
                      F.lit(1).cast("bigint").alias("n"), *([F.col(size).alias("_size")] if size else []))
            .where(F.col("score").isNotNull() & F.col("p").isNotNull()))
    small, rest = by_size(rows, "_size" if size else None, hot_rows)
    hist = rest.groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    cum = running(hist, keys, "score", ["p", "n"], descending=True).select(
        *keys, "p", "n", (F.col("before_p") + F.col("p")).alias("found"), (F.col("before_n") + F.col("n")).alias("seen"))
    if small is not None:
        down = W.partitionBy(*keys).orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
        cum = cum.unionByName(small.repartition(*keys).select(
            *keys, "p", "n", F.sum("p").over(down).alias("found"), F.sum("n").over(down).alias("seen")))
    term = F.col("p").cast("double") * F.col("found").cast("double") / F.col("seen").cast("double")
    return cum.groupBy(*keys).agg(
        ratio(F.sum(term), F.sum("p").cast("double")).alias("avg_precision"),
        (F.sum("p").cast("double") / F.sum("n").cast("double")).alias("prevalence"),
        F.sum("p").alias("n_pos"), F.sum("n").alias("n"))


def stratified_auc(df: DataFrame, keys: Sequence[str], strata: Sequence[str],
                   score: str = "score", target: str = "target",
                   size: str | None = None) -> DataFrame:
    """Concordant pairs counted inside strata only, with pair and stratum counts."""
    keys = list(keys)
    per = auc(df, [*keys, *strata], score, target, size=size)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return per.groupBy(*keys).agg(
        ratio(F.sum(F.when(pairs > 0, F.col("conc2") / 2)), F.sum(pairs)).alias("auc"),
        F.sum(pairs).cast("bigint").alias("n_pairs"),
        F.sum((pairs > 0).cast("bigint")).alias("n_strata_used"),
        F.count(F.lit(1)).alias("n_strata_total"))


STRATIFICATIONS = ("raw", "slice", "radial", "joint")


def stratified_axes(df: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target") -> DataFrame:
    """(keys, mode, auc, n_pairs) of every bag under four stratifications, from one pass over the instances.

    ``raw`` compares all instances, ``slice`` those of slices that hold a positive, ``radial`` those of one radial bin, ``joint`` those of one slice and
    bin. Needs slice, rbin and slice_pos. The joint histogram of scores is made once; the others are sums of it. Rows without a
    score or a target are left out; a mode without a comparable pair has a NULL auc and no pairs.
    """
    keys = list(keys)
    rows = df.select(*keys, "slice", "rbin", "slice_pos", clean(F.col(score)).alias("score"), (F.col(target) > 0).cast("bigint").alias("p"))
    joint = rows.where(F.col("score").isNotNull() & F.col("p").isNotNull()).groupBy(*keys, "slice", "rbin", "slice_pos", "score").agg(
        F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("q"))
    none, at = F.lit(None).cast("bigint"), {c: F.col(c).cast("bigint") for c in ("slice", "rbin")}
    strata = {"raw": (none, none), "slice": (none, none), "radial": (none, at["rbin"]), "joint": (at["slice"], at["rbin"])}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), a.alias("_a"), b.alias("_c")) for m, (a, b) in strata.items()])
    each = joint.withColumn("_m", F.explode(modes)).select(*keys, "_m.*", "slice_pos", "score", "p", "q").where((F.col("mode") != "slice") | (F.col("slice_pos") > 0))
    hist = each.groupBy(*keys, "mode", "_a", "_c", score_bucket(F.col("score")).alias("_b"), "score").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    per = concordance(hist, [*keys, "mode", "_a", "_c"], [("p", "q", "x")])
    pairs = F.col("x_pos").cast("double") * F.col("x_neg").cast("double")
    return per.groupBy(*keys, "mode").agg(ratio(F.sum(F.when(pairs > 0, F.col("x_conc2") / 2)), F.sum(pairs)).alias("auc"), F.sum(pairs).cast("bigint").alias("n_pairs"))


def axes(df: DataFrame, n_patch: int, keys: Sequence[str] = ("bag_id",), score: str = "score",
         target: str = "target", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flat, slice and within-slice AUC per bag.

    ``keys`` identify one scored bag, e.g. ``(scorer, bag_id)``. Needs ``slice`` and reuses, if
    present, ``n_slices`` (a size bound) and ``slice_pos`` (the slice holds a positive). Rows without a score or a target are left
    out. Bags with one class or a length that is then ragged give no row; a bag degenerate on one axis keeps its row and gets
    NULL there. Slice means are FLOAT like the scores they average.
    """
    keys = list(keys)
    rows = (df.withColumn("score", clean(F.col(score))).withColumn("p", (F.col(target) > 0).cast("bigint"))
            .where(F.col("score").isNotNull() & F.col("p").isNotNull()))
    extra = [c for c in ("n_slices", "slice_pos") if c in df.columns]
    rows = rows.select(*keys, "slice", "score", "p", *extra)
    small, rest = by_size(rows, "n_slices" if "n_slices" in extra else None, max(hot_rows // n_patch, 0))
    out = _axes_bucketed(rest, keys)
    if small is not None:
        out = out.unionByName(_axes_in_place(small, keys))
    wide = out.select(*keys, auc_from("a").alias("flat"), auc_from("s").alias("slice"), auc_from("w").alias("within_slice"),
                      (F.col("a_pos") + F.col("a_neg")).alias("_n"), (F.col("s_pos") + F.col("s_neg")).alias("n_slices"),
                      F.col("s_pos").alias("n_lesion_slices"))
    return wide.where(F.col("flat").isNotNull() & (F.col("_n") == F.col("n_slices") * F.lit(n_patch))).drop("_n")


class SliceHistograms:
    """One bag, ranked once: a cumulative histogram of dense ranks for every slice, which add up over any set of slices.

    ``positions`` holds pos of every row. For a positive x and a slice b the histogram gives twice the rows of b below x plus those tied with
    x. Rows of a set of slices are then compared with positives by adding the set's histograms; pairs of positives, p * p in all, are taken off.
    """
    CELLS = 1 << 24  # above this many cells slices are searched one by one instead

    def __init__(self, positions: np.ndarray, scores: np.ndarray, n_patch: int):
        order = np.argsort(positions, kind="stable")
        self.positions, scores = positions[order], scores[order]
        self.slices, self.slice_of = np.unique(self.positions // n_patch, return_inverse=True)
        self.whole = len(scores) == len(self.slices) * n_patch  # else the bag is ragged
        if not self.whole:
            return
        _, self.rank = np.unique(scores, return_inverse=True)
        self.flat = self._twice(np.bincount(self.rank))
        self.grid = np.sort(scores.reshape(-1, n_patch), axis=1)
        means = (np.cumsum(self.grid, axis=1)[:, -1] / n_patch).astype(np.float32)  # added in sorted order, as elsewhere
        _, at = np.unique(means, return_inverse=True)
        self.by_slice = self._twice(np.bincount(at))[at]
        self.scores, self.n_patch, self.table = scores, n_patch, None
        if len(self.slices) * len(self.flat) <= self.CELLS:
            counts = np.zeros((len(self.slices), len(self.flat)), np.int32)
            np.add.at(counts, (self.slice_of, self.rank), 1)
            self.table = 2 * np.cumsum(counts, axis=1, dtype=np.int32) - counts

    @staticmethod
    def _twice(counts: np.ndarray) -> np.ndarray:
        return 2 * np.cumsum(counts) - counts

    def axes(self, positives: np.ndarray):
        """(flat, slice, within_slice, n_lesion_slices) of a set of positives; None where an axis has one class."""
        x = np.searchsorted(self.positions, positives)
        x = x[(x < len(self.positions)) & (self.positions[np.minimum(x, len(self.positions) - 1)] == positives)]
        p, n = len(x), len(self.positions)
        if not 0 < p < n:
            return None
        held = np.unique(self.slice_of[x])
        if self.table is not None:
            below = self.table[held].sum(axis=0, dtype=np.int64)[self.rank[x]].sum()
        else:
            own = self.scores[x]
            below = sum(int(np.searchsorted(self.grid[b], own, side).sum()) for b in held for side in ("left", "right"))
        flat = (self.flat[self.rank[x]].sum() - p * p) / (2 * p * (n - p))
        s, f = len(self.slices), len(held)
        inside = f * self.n_patch - p
        return (float(flat), float((self.by_slice[held].sum() - f * f) / (2 * f * (s - f))) if f < s else None,
                float((below - p * p) / (2 * p * inside)) if inside else None, f)


def _axes_of_bag(n_patch: int, keys: list[str], labels: list[str], schema: pa.Schema):
    def bag(key, rows: pa.Table, moved: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and moved.num_rows:
            held = SliceHistograms(rows["pos"].to_numpy(), rows["score"].to_numpy(), n_patch)
            if held.whole:
                values, edges = list_rows(moved["_positives"])
                found = [held.axes(values[i:j]) for i, j in zip(edges, edges[1:])]
                names = list(zip(*(moved[c].to_pylist() for c in labels)))
                first = [k.as_py() for k in key]
                out = [(*first, *name, f[0], f[1], f[2], len(held.slices), f[3]) for name, f in zip(names, found) if f is not None]
        columns = zip(*out) if out else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
    return bag


def axes_of_positives(rows: DataFrame, positives: DataFrame, n_patch: int, score: str = "score", keys: Sequence[str] = ("bag_id",),
                      labels: Sequence[str] = ("rep",), hot_rows: int = HOT_ROWS, lists: DataFrame | None = None) -> DataFrame:
    """``axes`` of every bag under every label, where only positives (keys, labels, pos) move: a bag is ranked once, whatever the labels.

    ``rows`` has keys, pos and the score, and ``n_slices`` as a bound of a bag's slices. Bags up to ``hot_rows`` are held by one task as slice histograms; larger ones and those of
    unknown size are ranked under each label. Rows without a score are left out, and a bag that is then ragged gives no row.
    Positives of bags up to ``hot_rows`` may come as ``lists`` (keys, labels, positives) as well, of other labels than the rows.
    """
    given = lists
    keys, labels = list(keys), list(labels)
    scored = rows.withColumn("score", clean(F.col(score))).where(F.col("score").isNotNull())
    scored = scored.select(*keys, F.col("pos").cast("bigint").alias("pos"), "score", "n_slices")
    small, large = by_size(scored, "n_slices", max(hot_rows // n_patch, 0))
    lists = positives.groupBy(*keys, *labels).agg(F.collect_set(F.col("pos").cast("bigint")).alias("_positives"))
    under = lists
    if given is not None:
        lists = lists.unionByName(given.select(*keys, *labels, F.col("positives").cast("array<bigint>").alias("_positives")))
    kinds = {f.name: f.dataType for f in lists.schema}
    schema = StructType([*(StructField(c, kinds[c]) for c in [*keys, *labels]), *StructType.fromDDL(
        "flat DOUBLE, slice DOUBLE, within_slice DOUBLE, n_slices BIGINT, n_lesion_slices BIGINT")])
    named = [F.col(c).alias(f"_k_{c}") for c in keys]  # names of their own: both sides may stem from one table
    grouped = small.select(*named, "pos", "score").groupBy(*[f"_k_{c}" for c in keys]).cogroup(lists.groupBy(*keys))
    out = grouped.applyInArrow(_axes_of_bag(n_patch, keys, labels, to_arrow_schema(schema)), schema)
    on = lambda a: [F.col(c) == F.col(f"_k_{c}") for c in keys]
    under = under.select(*named, *labels)
    every = large.join(under, on(under)).drop(*[f"_k_{c}" for c in keys])
    true = positives.select(*keys, *labels, F.col("pos").cast("bigint").alias("pos"), F.lit(1).alias("target")).distinct()
    every = every.join(true, [*keys, *labels, "pos"], "left").withColumn("target", F.coalesce("target", F.lit(0)))
    every = every.withColumn("slice", F.floor(F.col("pos") / n_patch))
    return out.unionByName(axes(every, n_patch, [*keys, *labels], hot_rows=hot_rows).select(*out.columns))


PAIRS = (("p", "q", "a"), ("pw", "qw", "w"), ("ps", "qs", "s"))


def _axes_in_place(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whole bags in one task: a single exchange serves all three rankings.

    Slice and flags travel as one code, so that both branches read the same exchange.
    """
    if "slice_pos" not in rows.columns:
        rows = with_slice_flag(rows, keys, "p")
    code = F.col("slice").cast("bigint") * 4 + F.col("p") * 2 + F.col("slice_pos")
    placed = rows.select(*keys, "score", code.alias("_code")).repartition(*keys)
    p, has = F.shiftright("_code", 1).bitwiseAND(F.lit(1)), F.col("_code").bitwiseAND(F.lit(1))
    inst = placed.select(*keys, "score", p.alias("p"), (1 - p).alias("q"), (p * has).alias("pw"), ((1 - p) * has).alias("qw"))
    flat = _totals(ranked_in_place(inst, keys, "score", PAIRS[:2]), keys, PAIRS[:2])
    means = placed.groupBy(*keys, F.shiftright("_code", 2).alias("slice")).agg(
        exact_mean(F.col("score")).cast("float").alias("score"), F.max(has).alias("ps"))
    means = means.select(*keys, "score", "ps", (1 - F.col("ps")).alias("qs"))
    return _side_by_side(flat, _totals(ranked_in_place(means, keys, "score", PAIRS[2:]), keys, PAIRS[2:]), keys)


def _totals(ranked: DataFrame, keys: list[str], pairs) -> DataFrame:
    return ranked.groupBy(*keys).agg(*[F.sum(c).alias(f"{n}_{t}") for pos, neg, n in pairs
                                       for c, t in ((pos, "pos"), (neg, "neg"), (f"_c_{n}", "conc2"))])


def _axes_bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bags of any size: flat and within-slice share one histogram, slices have their own."""
    if "slice_pos" not in rows.columns:
        rows = with_slice_flag(rows, keys, "p")
    q = 1 - F.col("p")
    inst = rows.groupBy(*keys, score_bucket(F.col("score")).alias("_b"), "score").agg(
        F.sum("p").alias("p"), F.sum(q).alias("q"), F.sum(F.col("p") * F.col("slice_pos")).alias("pw"),
        F.sum(q * F.col("slice_pos")).alias("qw"))
    means = rows.groupBy(*keys, "slice").agg(
        exact_mean(F.col("score")).cast("float").cast("double").alias("score"),
        F.max("slice_pos").alias("has"))
    per_slice = means.groupBy(*keys, score_bucket(F.col("score")).alias("_b"), "score").agg(
        F.sum("has").alias("ps"), F.sum(1 - F.col("has")).alias("qs"))
    flat = concordance(inst, keys, PAIRS[:2])
    return _side_by_side(flat, concordance(per_slice, keys, PAIRS[2:]), keys)


def _side_by_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both, one row per key; unlike a join this keeps NULL keys."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def with_slice_flag(df: DataFrame, keys: Sequence[str] = ("bag_id",),
                    target: str = "target") -> DataFrame:
    """Mark rows whose slice holds a positive. A slice is at most ``n_patch`` rows."""
    w = W.partitionBy(*keys, "slice")
    return df.withColumn("slice_pos", F.max((F.col(target) > 0).cast("int")).over(w))
