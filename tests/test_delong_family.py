"""A family of paired tests ranks every score once and never multiplies the instances by pairs."""
import numpy as np

from patchrank.operators import inference as inf


def test_family_agrees_with_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i % 2), int(rng.random() < 0.4), float(rng.random()), float(rng.integers(4)), float(rng.integers(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "seed BIGINT, target INT, a DOUBLE, b DOUBLE, c DOUBLE")
    pairs = [("a", "c"), ("b", "c"), ("c", "a")]
    ranked = []
    real = inf._placements
    monkeypatch.setattr(inf, "_placements", lambda hist, keys: ranked.append(hist.count()) or real(hist, keys))
    family = {(r.seed, r.arm, r.reference): r for r in inf.delong_family(df, ["seed"], pairs).collect()}
    assert len(ranked) == 1 and len(family) == 6
    monkeypatch.setattr(inf, "LOOKUP_ROWS", 0)  # lookups that are joined, not sent
    for a, b in pairs:
        for r in inf.delong(df, ["seed"], a, b).collect():
            f = family[r.seed, a, b]
            assert (r.n_pos, r.n_neg) == (f.n_pos, f.n_neg)
            assert all(abs(r[x] - f[x]) < 1e-9 for x in ("auc_a", "auc_b", "delta", "z", "p"))
