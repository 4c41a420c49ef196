"""Draws of whole columns against the draws of rows, and the untrained floor without rows that leave their task."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from patchrank.functions import block_draws, draws
from patchrank.operators import bagwise as bw
from patchrank.plans import reports as rp


def test_columns_are_drawn_as_rows(spark):
    keys = ["7|0", "-12|345", "", "x" * 47, "y" * 60, "é|1", "z" * 130]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    want = df.select(draws.draw("0m3", F.col("k"), 1, "u").alias("d"), draws.normal("0m12", F.col("k"), 11).alias("n")).collect()
    held = block_draws.Keys(pa.array(keys))
    assert held.draw("0m3", ["0|u", "1|u"])[1].tolist() == [r.d for r in want]
    assert np.allclose(held.normals("0m12", 12)[11], [r.n for r in want], rtol=1e-12)


def test_untrained_bags_agree_with_rows_and_stay_in_their_task(spark):
    rng = np.random.default_rng(0)
    rows = [(b, p, n, int(rng.random() < 0.3) if p % 11 else None) for b, n in ((1, 3), (2, 1), (-3, 2), (4, 2), (5, 4), (6, 1), (9, 2), (12, 3)) for p in range(16 * n)]
    df = spark.createDataFrame(rows, "bag_id BIGINT, pos BIGINT, n_slices BIGINT, target INT")
    fast, slow = (sorted(rp.untrained_bags(df, ["a", "b", "c"], 16, 4, hot_rows=h).collect()) for h in (1 << 20, 0))
    assert len(fast) == len(slow) > 0
    assert [r[:3] for r in fast] == [r[:3] for r in slow]
    assert all((a.auc is None and b.auc is None) or abs(a.auc - b.auc) < 1e-9 for a, b in zip(fast, slow))
    plan = bw.untrained(df, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Exchange hashpartitioning") == 1
