"""Nulls measured by the task that holds a bag against the same nulls row by row."""
import numpy as np
from pyspark.sql import functions as F

from patchrank.plans import null_reports as nr


def test_bags_measured_in_place_equal_bags_measured_by_row(spark):
    rng = np.random.default_rng(2)
    rows = [(b, p, n // 4 + 1, n, float(rng.integers(5)) if b != 3 or p else None, float(rng.random()), int(rng.random() < 0.4) if b != 5 or p else None)
            for b, n in enumerate((4, 8, 3, 20, 12, 7, 1, 16, 5, 9, 11, 6)) for p in range(n)]
    df = spark.createDataFrame(rows, "bag_id BIGINT, pos BIGINT, n_slices BIGINT, n_rows BIGINT, s0 DOUBLE, s1 DOUBLE, target INT")
    bags = df.select("bag_id", "n_slices", "n_rows").distinct()
    got = [{(r.null, r.rep, r.bag_id, r.slot): (r.part, r.value, r.auc) for r in nr.null_measures(df, bags, ["s0", "s1"], 4, 2, 1, hot).collect()} for hot in (1 << 20, 13, 0)]
    assert len(got[0]) == (1 + 5 * 2 + 2 * 2) * 12 * 2
    for other in got[1:]:
        assert set(other) == set(got[0])
        for k, (part, value, auc) in other.items():
            p, v, a = got[0][k]
            assert p == part and abs((v or 0) - (value or 0)) < 1e-9
            assert (a is None) == (auc is None) and (a is None or abs(a - auc) < 1e-12)
