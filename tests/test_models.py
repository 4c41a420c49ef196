import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchrank.functions import draws, geometry as geo, tails
from patchrank.operators import alignment as al
from patchrank.operators import estimands as es
from patchrank.operators import inference as inf
from patchrank.operators import nulls as nl
from patchrank.operators import pooling as pl
from patchrank.operators import ranking as rk
from patchrank.operators import selection as se
from patchrank.operators import templates as tp


def bags(spark, sizes, n_patch=16, seed=0):
    rng = random.Random(seed)
    rows = [(b, p, p // n_patch, p % n_patch, n, int(rng.random() < 0.1), rng.random(), rng.random())
            for b, n in enumerate(sizes) for p in range(n * n_patch)]
    return spark.createDataFrame(rows, "bag_id int, pos int, slice int, patch int, n_slices int, target int, s0 double, s1 double")


def test_roll_keeps_prevalence_and_moves_every_bag(spark):
    df = bags(spark, [3, 5, 4])
    out = nl.roll_targets(df, 16, 7, 3)
    n = df.groupBy("bag_id").agg(F.sum("target").alias("t"))
    got = out.groupBy("rep", "bag_id").agg(F.sum("target").alias("t2"), F.count_distinct("pos").alias("k"), F.count("*").alias("c")).join(n, "bag_id")
    assert got.where("t <> t2 OR k <> c").count() == 0
    moved = out.where("rep = 0").join(df.withColumnRenamed("target", "old"), ["bag_id", "pos"])
    assert moved.where("target <> old").count() > 0


def test_donors_have_no_fixed_point_and_tile(spark):
    df = bags(spark, [2, 7, 3, 5])
    sizes = df.groupBy("bag_id").agg(F.max("n_slices").alias("n_slices"))
    d = nl.donor_map(sizes, 1, 4)
    assert d.where("bag_id = donor_id").count() == 0 and d.count() == 16
    rows = {(r.bag_id, r.pos): r.target for r in df.collect()}
    who = {(r.rep, r.bag_id): (r.donor_id, r.donor_slices) for r in d.collect()}
    out = nl.shuffle_targets(df, d, 16, tiles=2).collect()
    assert len(out) == 4 * df.count()
    for r in out:
        donor, n = who[(r.rep, r.bag_id)]
        assert r.target == rows[(donor, r.pos % (n * 16))]


def cycle_type(donor: dict) -> tuple:
    left, sizes = set(donor), []
    while left:
        at, n = left.pop(), 1
        while donor[at] in left:
            at = donor[at]
            left.discard(at)
            n += 1
        sizes.append(n)
    return tuple(sorted(sizes))


def test_derangements_are_permutations_of_many_cycle_types(spark):
    for n in (2, 3, 9):
        sizes = spark.range(n).select(F.col("id").alias("bag_id"), (F.col("id") + 2).alias("n_slices"))
        donors = {}
        for r in nl.donor_map(sizes, 7, 100).collect():
            assert r.donor_slices == r.donor_id + 2 and r.n_slices == r.bag_id + 2
            assert donors.setdefault(r.rep, {}).setdefault(r.bag_id, r.donor_id) == r.donor_id
        assert len(donors) == 100
        for d in donors.values():
            assert sorted(d) == sorted(d.values()) == list(range(n)) and all(a != b for a, b in d.items())
        types = {cycle_type(d) for d in donors.values()}
        assert len(types) == 1 if n < 4 else len(types) > 3
        assert n < 3 or len({tuple(sorted(d.items())) for d in donors.values()}) > 1
    assert nl.donor_map(spark.range(0).select(F.col("id").alias("bag_id"), F.col("id").alias("n_slices")), 7, 3).count() == 0


def test_single_bag_keeps_its_target(spark):
    df = bags(spark, [2])
    d = nl.donor_map(df.groupBy("bag_id").agg(F.max("n_slices").alias("n_slices")), 0)
    assert d.first().donor_id == 0


def test_random_slots_are_normalised_and_entropy_falls_with_scale(spark):
    df = bags(spark, [8] * 4)
    ents = []
    for scale in (0.1, 1.0, 5.0):
        r = nl.random_slots(df, 3, scale, 1)
        assert r.where(F.abs(F.col("r0") + F.col("r1") + F.col("r2") - 1) > 1e-6).count() == 0
        ents.append(nl.slot_entropy(r, ["r0", "r1", "r2"]).first().slot_entropy)
    assert ents[0] > ents[1] > ents[2] and ents[0] <= math.log(3) + 1e-9


def test_match_scale_reaches_the_entropy(spark):
    probe = spark.range(4096).select(*[draws.normal("probe", F.col("id"), j).alias(f"z{j}") for j in range(3)])
    goal = spark.createDataFrame([(0.7,)], "slot_entropy double")
    scale = nl.match_scale(probe, ["z0", "z1", "z2"], goal).first().scale
    e = nl.random_slots(bags(spark, [40] * 4), 3, scale, 5)
    assert nl.slot_entropy(e, ["r0", "r1", "r2"]).first().slot_entropy == pytest.approx(0.7, abs=0.03)


def test_template_unobserved_cells_take_the_grand_mean(spark):
    df = bags(spark, [2])
    fam = tp.fill(tp.fit_cells(df, F.col("s0"), 8), 8, 16)
    grand = df.agg(F.avg("s0")).first()[0]
    hidden = fam.where("NOT observed")
    assert fam.count() == 128 and hidden.count() == 96
    assert hidden.agg(F.max(F.abs(F.col("joint") - grand))).first()[0] < 1e-12


def test_fit_refuses_the_test_split(spark):
    df = bags(spark, [2]).withColumn("split", F.lit("test"))
    with pytest.raises(Exception, match="template fit saw split"):
        tp.fit_cells(df, F.col("s0"), 4, refuse_split="test").collect()


def test_depth_bins_refuse_an_empty_bag(spark):
    df = spark.createDataFrame([(0, 0)], "s int, n int")
    with pytest.raises(Exception, match="n_slices must be positive"):
        df.select(geo.depth_bin(F.col("s"), F.col("n"), 4)).collect()


def test_joint_family_beats_chance_on_a_fixed_lesion(spark):
    rows = [(b, p, p // 16, p % 16, 8, int(p % 16 == 8 and p // 16 in (3, 4))) for b in range(6) for p in range(128)]
    df = spark.createDataFrame(rows, "bag_id int, pos int, slice int, patch int, n_slices int, target int")
    fam = tp.fill(tp.fit_cells(df, F.col("target"), 8), 8, 16)
    ax = rk.axes(tp.apply_family(df, fam, 8), 16, ["scorer", "bag_id"])
    got = {r.scorer: r for r in ax.groupBy("scorer").agg(F.avg("flat").alias("flat"), F.avg("slice").alias("sl"), F.avg("within_slice").alias("wi")).collect()}
    assert got["joint"].flat == 1.0 and got["inplane"].sl == 0.5 and got["axial"].wi == 0.5 and got["separable"].flat == 1.0


def test_bootstrap_uses_clusters(spark):
    rows = [(c, float(c % 2) + 0.01 * i) for c in range(20) for i in range(10)]
    df = spark.createDataFrame(rows + [(99, float("nan"))], "cluster int, v double")
    wide = es.cluster_bootstrap(df, [], "v", "cluster", 200).first()
    narrow = es.cluster_bootstrap(df.withColumn("row", F.monotonically_increasing_id()), [], "v", "row", 200).first()
    assert wide.n == 200 and wide.n_clusters == 20
    assert wide.hi - wide.lo > narrow.hi - narrow.lo > 0
    assert wide.lo < wide["mean"] < wide.hi
    assert es.cluster_bootstrap(df, [], "v", "cluster", 0).first().lo is None


def test_skill_bounds(spark):
    one = spark.range(1)
    assert one.select(es.skill(F.lit(0.8), F.lit(0.6)).alias("x")).first().x == pytest.approx(0.5)
    with pytest.raises(Exception, match="prior must be in"):
        one.select(es.skill(F.lit(0.8), F.lit(1.0))).collect()


def test_holm(spark):
    ps = [("a", 0.03), ("b", 0.04), ("c", float("nan")), ("d", 0.001)]
    df = spark.createDataFrame(ps, "id string, p double").withColumn("f", F.lit(0))
    got = {r.id: r for r in inf.holm(df, ["f"], "p", "id").collect()}
    assert got["d"].p_adjusted == pytest.approx(0.004) and got["a"].p_adjusted == pytest.approx(0.09)
    assert got["b"].p_adjusted == pytest.approx(0.09) and got["c"].p_adjusted is None and not got["c"].reject
    with pytest.raises(Exception, match="outside"):
        inf.holm(df.withColumn("p", F.lit(1.7)), ["f"], "p", "id").collect()


def brute_delong(y, a, b):
    def comp(s):
        pos, neg = s[y == 1], s[y == 0]
        k = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
        return k.mean(axis=1), k.mean(axis=0)
    (va, wa), (vb, wb) = comp(a), comp(b)
    cov = np.cov(np.vstack([va, vb])) / len(va) + np.cov(np.vstack([1 - wa, 1 - wb])) / len(wa)
    var = cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]
    return va.mean(), vb.mean(), (va.mean() - vb.mean()) / math.sqrt(var)


def test_delong_against_double_loop(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.3).astype(int)
    a, b = np.round(rng.normal(size=300) + y, 1), np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(int(i), float(u), float(w)) for i, u, w in zip(y, a, b)], "target int, a double, b double")
    r = inf.delong(df, [], "a", "b").first()
    want = brute_delong(y, a, b)
    assert [r.auc_a, r.auc_b, r.z] == pytest.approx(list(want), abs=1e-9)
    assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9)
    same = inf.delong(df, [], "a", "a").first()
    assert same.z == 0.0 and same.p == 1.0


def test_tail_probabilities():
    assert tails._t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails._normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails._binomial_two_sided(8, 10, 0.5) == pytest.approx(0.109375)
    assert tails._signed_rank_exact(0.0, 5) == pytest.approx(0.0625)


def test_spearman_and_purity(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i), float(i % 2), float((i + 1) % 2), i % 2) for i in range(20)],
                               "i int, x double, y double, s0 double, s1 double, target int")
    assert inf.spearman(df, [], "x", "y").first().rho == pytest.approx(1.0)
    p = al.purity(df, ["s0", "s1"]).first()
    assert (p.purity, p.n_active_slots) == (1.0, 2) and p.nmi == pytest.approx(1.0)


def test_axial_normality_of_known_profiles(spark):
    def kl(mass):
        rows = [(0, s, 48, float(mass(s))) for s in range(48)]
        df = spark.createDataFrame(rows, "bag_id int, slice int, n_slices int, s0 double")
        return al.axial_normality(df, ["s0"]).first().kl
    assert kl(lambda s: s == 20) == pytest.approx(0.9189, abs=1e-3)
    assert kl(lambda s: math.exp(-0.5 * (s - 24) ** 2)) == pytest.approx(0.0, abs=1e-3)
    assert kl(lambda s: 1.0) == pytest.approx(0.0895, abs=1e-3)


def test_faithfulness_hot_and_small_paths_agree(spark):
    df = bags(spark, [5, 6]).withColumn("n", F.lit(200))
    a = sorted(map(tuple, se.faithfulness_curves(df, "s0", "s1", 10, "n").collect()))
    b = sorted(map(tuple, se.faithfulness_curves(df, "s0", "s1", 10).collect()))
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert [r[4] for r in a] == pytest.approx([r[4] for r in b])


def test_probe_finds_a_planted_dimension(spark):
    rng = np.random.default_rng(0)
    rows = []
    for b in range(6):
        for p in range(48):
            t = int(p % 16 == 5)
            x = rng.normal(size=5)
            x[0] += 4 * t
            rows.append((b, p, t, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "bag_id int, pos int, target int, x array<double>")
    fit = pl.probe_fit_set(df, 4, 0)
    assert fit.where("target = 1").count() == 18 and fit.where("target = 0").count() == 72
    scored = pl.probe_scores(pl.fit_probe(fit, "x"), df, "x")
    assert scored.count() == df.count() and rk.auc(scored, []).first().auc > 0.95


def test_draws_match_a_plain_computation(spark):
    import hashlib
    got = spark.createDataFrame([(7, "b")], "i int, s string").select(draws.draw(3, F.col("i"), F.col("s")).alias("d")).first().d
    assert got == int(hashlib.md5(b"3|7|b").hexdigest()[:8], 16)
    even = int(hashlib.sha256(b"7").hexdigest(), 16) % 2 == 0
    assert spark.createDataFrame([(7,)], "i int").select(draws.half(F.col("i")).alias("h")).first().h == ("fit" if even else "score")
