"""Axes of moved positives from slice histograms against a ranking of every replicate."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchrank.operators import ranking as rk


def rows_of(seed, bags=12, n_patch=4):
    rng = np.random.default_rng(seed)
    out, moved = [], []
    for b in range(bags):
        s = int(rng.integers(1, 6))
        ragged, lost = b % 5 == 4, b % 7 == 6
        for pos in range(s * n_patch - (1 if ragged else 0)):
            score = None if lost and pos == 2 else float("nan") if lost and pos == 1 else float(rng.integers(0, 4)) / 3
            out.append((f"b{b}", pos, pos // n_patch, s, score))
        for rep in range(5):
            p = int(rng.integers(0, s * n_patch + 1)) if rep else s * n_patch
            moved += [(f"b{b}", rep, int(x)) for x in rng.choice(s * n_patch, p, replace=False)]
    return out, moved


@pytest.mark.parametrize("hot_rows, cells", [(1 << 20, 1 << 24), (1 << 20, 0), (12, 1 << 24), (0, 1 << 24)])
def test_axes_of_positives_equal_a_ranking_of_every_replicate(spark, monkeypatch, hot_rows, cells):
    monkeypatch.setattr(rk.SliceHistograms, "CELLS", cells)
    rows, moved = rows_of(hot_rows + cells)
    df = spark.createDataFrame(rows, "bag_id STRING, pos INT, slice INT, n_slices INT, s DOUBLE").repartition(3)
    at = spark.createDataFrame([*moved, *moved[:9]], "bag_id STRING, rep INT, pos INT").repartition(3)
    got = {(r.bag_id, r.rep): r for r in rk.axes_of_positives(df, at, 4, "s", hot_rows=hot_rows).collect()}
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(at.distinct().withColumn("target", F.lit(1)), ["bag_id", "rep", "pos"], "left")
    want = {(r.bag_id, r.rep): r for r in rk.axes(each.withColumn("target", F.coalesce("target", F.lit(0))), 4, ["bag_id", "rep"], "s").collect()}
    assert set(got) == set(want) and len(got) > 15
    for k, r in want.items():
        for c in ("flat", "slice", "within_slice", "n_slices", "n_lesion_slices"):
            assert got[k][c] == pytest.approx(r[c], abs=1e-12) if r[c] is not None else got[k][c] is None


def test_no_positives_and_no_rows_give_none(spark):
    df = spark.createDataFrame([("a", 0, 1, 0.5), ("a", 1, 1, 0.25)], "bag_id STRING, pos INT, n_slices INT, score DOUBLE")
    at = spark.createDataFrame([("a", 0, 9), ("b", 0, 0)], "bag_id STRING, rep INT, pos INT")
    assert rk.axes_of_positives(df, at, 2).count() == 0
    assert rk.axes_of_positives(df.limit(0), at, 2).count() == 0 and rk.axes_of_positives(df, at.limit(0), 2).count() == 0
