"""Replicate arrays: the same draws as one by one, and exact multinomials for groups cut into blocks."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchrank.operators import estimands as es
from patchrank.operators import inference as inf
from patchrank.operators import replicates as rp


def draw(seed, rep, turn):
    return int(hashlib.md5(f"{seed}|{rep}|{turn}".encode()).hexdigest()[:8], 16)


def test_cluster_interval_equals_draws_one_by_one(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"c{c}", float(v)) for k in ("a", "b") for c in range(3 if k == "a" else 17) for v in rng.normal(size=rng.integers(1, 5))] + [("a", "c0", None)]
    df = spark.createDataFrame(rows, "k STRING, c STRING, v DOUBLE")
    got = {r.k: r for r in es.cluster_bootstrap(df, ["k"], "v", "c", 600, 4).collect()}
    for k in ("a", "b"):
        per = {}
        for kk, c, v in rows:
            if kk == k and v is not None:
                t, n = per.get(c, (0.0, 0))
                per[c] = t + v, n + 1
        names = sorted(per, key=lambda c: (hashlib.md5(c.encode()).hexdigest(), c))
        means = []
        for rep in range(600):
            chosen = [per[names[draw(4, rep, t) % len(names)]] for t in range(len(names))]
            means.append(sum(t for t, _ in chosen) / sum(n for _, n in chosen))
        assert got[k].lo == pytest.approx(np.percentile(means, 2.5)) and got[k].hi == pytest.approx(np.percentile(means, 97.5))
        assert got[k].n_clusters == len(names)


def test_blocks_draw_a_multinomial(monkeypatch):
    reps, sizes = 4000, [5, 1, 7, 3, 4]
    starts = [0, *np.cumsum(sizes).tolist()]
    found = np.stack([rp.block_draws(3, 0, reps, b, starts.__getitem__, 5) for b in range(5)])
    assert (found.sum(axis=0) == 20).all()
    assert np.allclose(found.mean(axis=1), sizes, rtol=0.05)
    p = np.array(sizes) / 20
    assert np.allclose(np.cov(found), 20 * (np.diag(p) - np.outer(p, p)), atol=0.25)


def test_large_groups_have_the_interval_of_small_ones(spark, monkeypatch):
    """The block path against the direct one: same data, intervals that agree but for the draws."""
    df = spark.range(300).select(F.lit("k").alias("k"), F.col("id").alias("c"), (F.sin(F.col("id") * 1.0) * 3).alias("v"))
    direct = es.cluster_bootstrap(df, ["k"], "v", "c", 3000, 1).first()
    monkeypatch.setattr(rp, "DIRECT", 64)
    blocks = es.cluster_bootstrap(df, ["k"], "v", "c", 3000, 1).first()
    assert blocks.mean == direct.mean and blocks.lo != direct.lo
    assert abs(blocks.lo - direct.lo) < 0.05 and abs(blocks.hi - direct.hi) < 0.05


def test_row_bootstrap_equals_draws_one_by_one_and_blocks_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.4), float(rng.integers(0, 12)) / 12) for i in range(90)] + [(990, None, 0.5), (991, 1, None)]
    df = spark.createDataFrame(rows, "k INT, y INT, s DOUBLE")
    per = {r.rep: r for r in rp.rank_replicates(df, "k", "y", "s", 300, 2).collect()}
    assert len(per) == 300
    order = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    for rep in (0, 1, 250, 299):
        drawn = [order[draw(2, rep, t) % 90] for t in range(90)]
        pos, neg = [s for _, y, s in drawn if y], [s for _, y, s in drawn if not y]
        pairs = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        r = per[rep]
        assert (r.n_pos, r.n_neg, r.concordant) == (len(pos), len(neg), pairs)
        assert (r.tp, r.fp, r.fn, r.tn) == (sum(s > 0.5 for s in pos), sum(s > 0.5 for s in neg), sum(s <= 0.5 for s in pos), sum(s <= 0.5 for s in neg))
    blocks = rp.rank_replicates(df, "k", "y", "s", 4000, 2, direct=20)
    got = blocks.agg(F.min(F.col("n_pos") + F.col("n_neg")), F.max(F.col("n_pos") + F.col("n_neg")), F.avg(F.col("concordant") / F.col("n_pos") / F.col("n_neg"))).first()
    exact = inf.binary_metrics(df.where("y IS NOT NULL AND s IS NOT NULL"), [], "y", "s").first().auc
    assert got[0] == got[1] == 90 and abs(got[2] - exact) < 0.01
    for metric in ("auc", "acc", "balanced_acc", "macro_f1"):
        r = inf.bag_bootstrap(df, "k", "y", "s", metric, 200).first()
        assert r.lo <= r["mean"] <= r.hi and r.n_boot == 200


def test_intervals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k STRING, c STRING, v DOUBLE")
    assert es.cluster_bootstrap(df, ["k"], "v", "c", 10).count() == 0
