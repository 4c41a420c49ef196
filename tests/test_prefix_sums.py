"""Prefix sums over any number of levels of blocks."""
import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from patchrank.operators.scale import prefix_sums
from patchrank.sources import cache as ca

SPARSE = [-(1 << 60), -7, -6, 0, 1, 2, 3, 4, 5, 63, 64, 65, 4096, 1 << 40, (1 << 55) + 1, (1 << 55) + 2, 1 << 60]


def before(items):
    total, out = 0, {}
    for k, v in sorted(items):
        out[k] = total
        total += v or 0
    return out


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_equal_whatever_the_block(spark, block):
    items = [(k, (i * 37) % 11 if i % 5 else None) for i, k in enumerate(SPARSE)]
    random.Random(1).shuffle(items)
    df = spark.createDataFrame(items, "k BIGINT, v BIGINT")
    got = {r.k: r.b for r in prefix_sums(df, "k", F.col("v"), "b", block).collect()}
    assert got == before(items)


def test_offsets_and_shards_with_blocks_of_four(spark):
    lengths = [(i, i, (i * 7) % 5) for i in range(301)]
    df = spark.createDataFrame(lengths, "bag_ix BIGINT, bag_id BIGINT, length BIGINT").repartition(5)
    want = before([(i, n) for i, _, n in lengths])
    for block in (4, 4096):
        assert {r.bag_ix: r.start for r in ca.bag_offsets(df, block).collect()} == want
    flat = spark.range(sum(n for _, _, n in lengths)).withColumnRenamed("id", "ix")
    cut = ca.unflatten(flat, df, 4).groupBy("bag_id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    assert {r.bag_id: (r.n, r.last) for r in cut} == {i: (n, n - 1) for _, i, n in lengths if n}
    ids = sorted(random.Random(2).sample(range(-10**12, 10**12), 200))
    shards = {r.k: r.shard for r in ca.shard_of(spark.createDataFrame([(i,) for i in ids], "k BIGINT"), "k", 7).collect()}
    assert shards == {k: i % 7 for i, k in enumerate(ids)}


def test_no_window_over_everything(spark):
    df = spark.range(1000).select(F.col("id").alias("bag_ix"), "id", F.lit(1).alias("length"))
    with redirect_stdout(io.StringIO()) as out:
        ca.bag_offsets(df, 4).explain()
    plan = out.getvalue()
    assert "Window" in plan and "SinglePartition" not in plan


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "k BIGINT, v BIGINT")
    assert prefix_sums(empty, "k", F.col("v"), "b").count() == 0 and prefix_sums(empty, "k", F.col("v"), "b").columns == ["k", "v", "b"]
    with pytest.raises(Exception, match="NULL in k"):
        prefix_sums(spark.createDataFrame([(None, 1), (2, 2)], "k BIGINT, v BIGINT"), "k", F.col("v"), "b").collect()
