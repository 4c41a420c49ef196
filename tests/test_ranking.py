import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchrank.operators import ranking as rk
from patchrank.operators import scale as sc
from patchrank.operators import slots as sl


def pair_auc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def tied_rows(n_bags=6, n=64, seed=0, values=9):
    rng = random.Random(seed)
    return [(b, p, p // 8, 8, rng.choice([-1, 1]) * rng.randrange(values) / 4.0, int(rng.random() < 0.3)) for b in range(n_bags) for p in range(n)]


COLS = "bag_id int, pos int, slice int, n_slices int, score double, target int"


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_auc_equals_pair_counts(spark, hot_rows):
    rows = tied_rows()
    df = spark.createDataFrame(rows, COLS).withColumn("n", F.lit(64))
    got = {r.bag_id: r.auc for r in rk.auc(df, ["bag_id"], size="n", hot_rows=hot_rows).collect()}
    for b in got:
        mine = [r for r in rows if r[0] == b]
        assert got[b] == pair_auc([r[5] for r in mine], [r[4] for r in mine])


def test_auc_without_size_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.25, 1), (2, 0.1, 0), (2, 0.3, 1)], "bag_id int, score double, target int")
    got = {r.bag_id: r.auc for r in rk.auc(df, ["bag_id"]).collect()}
    assert got == {1: None, 2: 1.0}


def test_nan_scores_are_left_out(spark):
    df = spark.createDataFrame([(1, float("nan"), 0), (1, 0.2, 0), (1, 0.3, 1)], "bag_id int, score double, target int")
    row = rk.auc(df, ["bag_id"]).first()
    assert (row.n_pos, row.n_neg, row.auc) == (1, 1, 1.0)


def test_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-12, 12, 3000), 2.0 ** np.arange(-40, 40),
                        np.nextafter(2.0 ** np.arange(-40, 40), 0), [0.0, -0.0]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", sc.score_bucket(F.col("x")).alias("b")).collect()
    b = [r.b for r in sorted(got, key=lambda r: r.x)]
    assert b == sorted(b)


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_axes_against_direct_computation(spark, hot_rows):
    rows = tied_rows(8, 64, 3)
    df = spark.createDataFrame(rows, COLS)
    got = {r.bag_id: r for r in rk.axes(df, 8, hot_rows=hot_rows).collect()}
    for b in range(8):
        y = np.array([r[5] for r in rows if r[0] == b]).reshape(8, 8)
        s = np.array([r[4] for r in rows if r[0] == b]).reshape(8, 8)
        has = y.any(axis=1)
        assert got[b].flat == pair_auc(y.ravel(), s.ravel())
        assert got[b].slice == pair_auc(has, s.mean(axis=1))
        assert got[b].within_slice == pair_auc(y[has].ravel(), s[has].ravel())
        assert (got[b].n_slices, got[b].n_lesion_slices) == (8, int(has.sum()))


def bag(spark, patches, slices, n_slices=8, n_patch=16, bag_id="a", extra=0):
    rows = [(bag_id, p, p // n_patch, p % n_patch, n_slices, int(p % n_patch in patches and p // n_patch in slices))
            for p in range(n_slices * n_patch + extra)]
    return spark.createDataFrame(rows, "bag_id string, pos int, slice int, patch int, n_slices int, target int")


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_in_plane_scorer_is_exactly_half_on_the_slice_axis(spark, hot_rows):
    df = bag(spark, {5, 6}, {2, 3}).withColumn("score", (1.0 / (F.col("patch") + 3)).cast("float"))
    row = rk.axes(df, 16, hot_rows=hot_rows).first()
    assert row.slice == 0.5 and row.within_slice > 0.5


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_axial_scorer_is_exactly_half_within_slices(spark, hot_rows):
    df = bag(spark, {5, 6}, {2, 3}).withColumn("score", F.when(F.col("slice").isin(2, 3), 0.7).otherwise(0.1 * F.col("slice")))
    row = rk.axes(df, 16, hot_rows=hot_rows).first()
    assert row.within_slice == 0.5


def test_degenerate_bags(spark):
    none, full = bag(spark, set(), set(), bag_id="none"), bag(spark, set(range(16)), set(range(8)), bag_id="full")
    ragged, every = bag(spark, {1}, {2}, bag_id="ragged", extra=3), bag(spark, {1}, set(range(8)), bag_id="every")
    df = none.unionByName(full).unionByName(ragged).unionByName(every).withColumn("score", F.col("patch") * 1.0)
    got = {r.bag_id: r for r in rk.axes(df, 16).collect()}
    assert set(got) == {"every"} and got["every"].slice is None and got["every"].flat is not None


def test_null_keys_keep_their_rows(spark):
    df = bag(spark, {5}, {2}).withColumn("score", F.col("patch") * 1.0).withColumn("seed", F.lit(None).cast("int"))
    assert rk.axes(df, 16, ["seed", "bag_id"]).count() == 1


def step_ap(y, s):
    out = tp = n = 0
    for v in sorted(set(s), reverse=True):
        d = sum(b for a, b in zip(s, y) if a == v)
        tp, n = tp + d, n + sum(a == v for a in s)
        out += d * tp / n
    return out / sum(y)


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_average_precision(spark, hot_rows):
    rows = tied_rows(4, 40, 5)
    df = spark.createDataFrame(rows, COLS).withColumn("n", F.lit(40))
    for r in rk.average_precision(df, ["bag_id"], size="n", hot_rows=hot_rows).collect():
        mine = [x for x in rows if x[0] == r.bag_id]
        assert r.avg_precision == pytest.approx(step_ap([x[5] for x in mine], [x[4] for x in mine]), abs=1e-12)


def test_stratified_auc_counts_pairs_inside_strata(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 1), (1, 0, 0.1, 0), (1, 1, 0.2, 1), (1, 1, 0.8, 0), (1, 2, 0.5, 1)],
                               "bag_id int, st int, score double, target int")
    r = rk.stratified_auc(df, ["bag_id"], ["st"]).first()
    assert (r.auc, r.n_pairs, r.n_strata_used, r.n_strata_total) == (0.5, 2, 2, 3)


def test_positions_and_quantiles_on_one_hot_group(spark):
    rng = random.Random(2)
    vals = [rng.randrange(50) / 7 for _ in range(500)]
    df = spark.createDataFrame([(0 if i % 3 else i, v, i) for i, v in enumerate(vals)], "g int, v double, i int")
    lead = df.withColumn("b", F.floor("v"))
    got = sorted((r.g, r.p, r.v, r.i) for r in sc.positions(lead, ["g"], ["b"], ["v", "i"], "p", "n").collect())
    for g in {r[0] for r in got}:
        mine = [r for r in got if r[0] == g]
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert [r[2:] for r in mine] == sorted(r[2:] for r in mine)
    q = sc.quantiles(df, ["g"], "v", (0.05, 0.5, 0.95), ("a", "b", "c")).where("g = 0").first()
    want = np.percentile([v for i, v in enumerate(vals) if i % 3], [5, 50, 95])
    assert [q.a, q.b, q.c] == pytest.approx(list(want))


def test_null_group_is_refused(spark):
    df = spark.createDataFrame([(None, 1)], "g int, i int").withColumn("b", F.lit(0))
    with pytest.raises(Exception, match="NULL in g"):
        sc.positions(df, ["g"], ["b"], ["i"]).collect()


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), F.col("id"), F.lit(9000).alias("n"))
    small = spark.createDataFrame([(1, "x", 9000), (2, "y", 1)], "k int, v string, n int")
    assert sc.salted_join(big, small, ["k"], F.col("id")).count() == 1000
    assert sc.salted_join(big, small, ["k"], F.col("id"), size="n").count() == 1000


def test_best_dice_ties_and_zero(spark):
    rows = [("a", p, 1, 0, float(p == 3), float(p == 3), int(p == 3)) for p in range(4)]
    rows += [("z", p, 1, 0, float(p == 0), float(p == 1), int(p == 3)) for p in range(4)]
    df = spark.createDataFrame(rows, "bag_id string, pos int, n_slices int, slice int, s0 double, s1 double, target int")
    got = {r.bag_id: r for r in sl.best_dice(df, ["s0", "s1"]).collect()}
    assert (got["a"].slot, got["a"].threshold, got["a"].dice) == (0, 0.3, 1.0)
    assert (got["z"].slot, got["z"].threshold, got["z"].dice) == (-1, None, 0.0)
    hits = {(r.bag_id, r.slot): r.hit for r in sl.pointing(df, ["s0", "s1"]).collect()}
    assert hits[("a", 0)] == 1 and hits[("z", 1)] == 0
