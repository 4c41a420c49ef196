"""Entropy matching for many keys at once against the search for one."""
import pytest
from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.operators import nulls as nl


def test_many_brackets_end_where_single_ones_do(spark):
    probe = spark.range(256).select(*[draws.normal("probe", F.col("id"), j).alias(f"z{j}") for j in range(3)])
    goals = [("a", 0.7), ("b", 0.2), ("c", 1.05), ("d", None)]
    df = spark.createDataFrame(goals, "arm STRING, slot_entropy DOUBLE")
    got = {r.arm: r for r in nl.match_scales(df, ["arm"], probe, ["z0", "z1", "z2"], rounds=4).collect()}
    for arm, goal in goals[:3]:
        one = nl.match_scale(probe, ["z0", "z1", "z2"], df.where(F.col("arm") == arm).select("slot_entropy"), rounds=4).first()
        assert got[arm].scale == pytest.approx(one.scale, abs=1e-9) and got[arm].achieved == pytest.approx(goal, abs=0.01) and got[arm].computable
    assert got["d"].scale is None and not got["d"].computable
    single = nl.match_scales(df, ["arm"], probe, ["z0"], rounds=2).collect()
    assert len(single) == 4 and not any(r.computable for r in single) and all(r.scale is None for r in single)
