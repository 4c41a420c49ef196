"""Slot maps of zeros, sums whose last bit is ranked, and groups above the old limit of direct draws."""
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.operators import alignment as al
from patchrank.operators import estimands as es

NAN = float("nan")


def test_an_empty_slot_is_undefined_on_request(spark):
    rows = [(1, 0, 1, 0, 0.5, 0.0), (1, 0, 1, 1, 0.2, 0.0), (2, 0, 1, 0, 0.5, 0.5), (2, 0, 1, 1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "bag_id int, slice int, n_slices int, pos int, a double, b double")
    assert math.isnan(al.redundancy(df, ["a", "b"], empty=NAN).first().mean_pairwise_cosine)
    assert al.redundancy(df, ["a", "b"]).first().mean_pairwise_cosine == 0.5
    health = {r.bag_id: r for r in al.slot_health(df, ["a", "b"], 0.3, empty=NAN).collect()}
    assert all(math.isnan(health[1][c]) for c in ("max_cosine", "mass_entropy", "diversity")) and health[1].n_active == 1
    assert abs(health[2].mass_entropy - math.log(2)) < 1e-12
    kl = {(r.bag_id, r.slot): r.kl for r in al.axial_normality(df, ["a", "b"], empty=NAN).collect()}
    assert math.isnan(kl[1, 1]) and not any(math.isnan(x) for k, x in kl.items() if k != (1, 1))


def test_ranked_shares_are_added_in_order(spark):
    values = [0.1, 0.2, 0.3, 1e16, -1e16, 0.7]
    df = spark.createDataFrame([(1, p, 6, 1, x, x) for p, x in enumerate(values)], "bag_id int, pos int, n_rows int, target int, a double, b double")
    want = 0.0
    for x in values:
        want += x
    for order in (F.col("pos"), -F.col("pos"), F.hash("pos")):
        got = al.ordered_affinity(df.repartition(3, "pos").sort(order), ["a", "b"], "pos", "n_rows").collect()
        assert [r.value for r in got] == [want / max(want, 1e-8)] * 2


def test_a_group_of_five_thousand_takes_the_drawn_units(spark):
    n, reps = 5000, 3
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("c"), (F.col("id") % 97).cast("double").alias("v"))
    order = sorted(range(n), key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), str(c)))
    units = np.array([c % 97 for c in order], float)
    drawn = df.select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), (draws.draw(0, F.col("rep"), F.col("c")) % n).cast("int").alias("ix"))
    means = [np.mean(units[[r.ix for r in drawn.where(F.col("rep") == k).collect()]]) for k in range(reps)]
    got = es.cluster_bootstrap(df, ["k"], "v", "c", reps, 0).first()
    assert abs(got.lo - np.percentile(means, 2.5)) < 1e-9 and abs(got.hi - np.percentile(means, 97.5)) < 1e-9
