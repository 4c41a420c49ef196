"""Deletion and insertion curves of pooled scores against pooling every shorter bag anew."""
import numpy as np
import pytest

from patchrank.operators import selection as se


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def brute(rows, classes, target, steps, attention):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    n, per = len(order), max(1, len(order) // steps)

    def score(kept):
        x = np.array([r[3] for r in kept])
        w = softmax(np.array([r[2] for r in kept])) if attention else np.full(len(kept), 1 / len(kept))
        return softmax(classes @ (w @ x))[target]
    out = {}
    for s in range(steps + 1):
        out["deletion", s] = score(order[s * per:] or order[-1:])
        out["insertion", s] = score(order[:s * per] or order[:1])
    return out


@pytest.mark.parametrize("attention", [True, False])
def test_curves_equal_pooling_anew(spark, attention):
    rng = np.random.default_rng(3)
    classes = rng.normal(size=(3, 5))
    data, bags = [], {}
    for bag, n in (("a", 1), ("b", 4), ("c", 23), ("d", 60)):
        bags[bag] = [(p, float(rng.integers(0, 9)), float(rng.normal() * (400 if bag == "d" else 1)), rng.normal(size=5).tolist()) for p in range(n)]
        data += [(bag, *r) for r in bags[bag]]
    data += [("b", 90, None, 1.0, [1.0] * 5), ("b", 91, 1.0, None if attention else 1.0, [1.0] * 5 if attention else None), ("e", 0, None, 0.0, [0.0] * 5)]
    df = spark.createDataFrame(data, "bag_id STRING, pos INT, s DOUBLE, l DOUBLE, v ARRAY<DOUBLE>").repartition(4)
    got = {(r.bag_id, r.kind, r.step): r.bag_score for r in se.pooled_faithfulness(df, "s", "v", classes, 1, 6, "l" if attention else None).collect()}
    want = {(b, *k): x for b, rows in bags.items() for k, x in brute(rows, classes, 1, 6, attention).items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
