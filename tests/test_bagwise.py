"""Several scores of a bag behind one exchange, against the rankings in buckets and one score at a time."""
import math
import random

from pyspark.sql import functions as F

from patchrank.operators import bagwise as bw
from patchrank.operators import ranking as rk

from test_instance_table import shuffled_records

N = 4


def scores():
    return {"a": F.col("a"), "b": F.col("b"), "sum": F.col("a") + F.col("b"), "one": F.lit(1.0)}


def bags(spark):
    rng, rows = random.Random(4), []
    odd = [float("inf"), -float("inf"), 1e-320, 0.0, 1e300, None, float("nan")]
    for bag in range(14):
        n = (1 + bag % 6) * N - (bag % 5 == 0)
        for pos in range(n):
            a = rng.choice(odd) if bag % 7 == 3 and pos % 5 == 0 else round(rng.random(), 1)
            y = None if bag == 9 and pos == 2 else int(rng.random() < (0.0, 0.3, 1.0)[min(bag % 8, 1) + (bag == 5)])
            rows.append((bag, pos, pos // N, math.ceil(n / N), y, pos % 2, a, rng.random()))
    df = spark.createDataFrame(rows, "bag_id bigint, pos bigint, slice bigint, n_slices bigint, target int, rbin bigint, a double, b double")
    return rk.with_slice_flag(df).withColumn("slice_pos", F.coalesce("slice_pos", F.lit(0)))


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=repr)


def test_both_paths_and_single_scores_agree(spark):
    df = bags(spark).cache()
    for many, single in ((lambda **k: bw.axes(df, N, scores(), **k), lambda s: rk.axes(df.withColumn("score", s), N)),
                         (lambda **k: bw.stratified_axes(df, N, scores(), **k), lambda s: rk.stratified_axes(df.withColumn("score", s), ["bag_id"]))):
        want = None
        for name, score in scores().items():
            one = single(score).withColumn("scorer", F.lit(name))
            want = one if want is None else want.unionByName(one)
        got = many()
        assert rows_of(got) == rows_of(want.select(*got.columns))
        assert rows_of(many(hot_rows=0)) == rows_of(got)


def test_instances_are_shuffled_once_whatever_the_scores(spark):
    df = spark.range(64 * 40).select(F.floor(F.col("id") / 64).alias("bag_id"), (F.col("id") % 64).alias("pos"))
    df = df.withColumns({"slice": F.floor(F.col("pos") / N), "n_slices": F.lit(16), "slice_pos": F.lit(1), "rbin": F.col("pos") % 2,
                         "target": (F.col("pos") % 3 == 0).cast("int"), "a": F.rand(1), "b": F.rand(2)}).localCheckpoint()
    for many in (bw.axes, bw.stratified_axes):
        assert shuffled_records(spark, lambda: many(df, N, scores()).collect()) <= 64 * 40
