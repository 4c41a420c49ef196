"""What null models ask of the driver."""
from pyspark.sql import functions as F

from patchrank.operators import nulls as nl
from patchrank.operators import scale


def plans(spark, work):
    """Plans of all queries that ``work`` runs, as they were carried out."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = work()
    bus.waitUntilEmpty(30_000)
    listed = store.executionsList()
    return out, [listed.apply(i).physicalPlanDescription() for i in range(before, listed.size())]


def test_numbering_gathers_no_starts_in_the_driver(spark):
    """Starts are a row for every key and bucket, up to 4,096 for each replicate; they are joined where the rows lie."""
    rows = spark.range(2000).select((F.col("id") % 7).alias("rep"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    got, found = plans(spark, lambda: scale.hashed_positions(rows, ["rep"], "h", ["id"], total="size").collect())
    want = {}
    for r in sorted(got, key=lambda r: (r.rep, r.h, r.id)):
        want.setdefault(r.rep, []).append(r)
    assert len(got) == 2000 and all(r.ix == i and r.size == len(of) for of in want.values() for i, r in enumerate(of))
    assert found and not [x for x in found if "BroadcastExchange" in x]


def test_a_derangement_of_many_replicates_is_whole(spark):
    bags = spark.range(300).select(F.col("id").alias("bag_id"), F.lit(2).alias("n_slices"))
    got = nl.donor_map(bags, 0, 20).collect()
    for rep in range(20):
        mine = {r.bag_id: r.donor_id for r in got if r.rep == rep}
        assert sorted(mine) == sorted(mine.values()) == list(range(300)) and all(a != b for a, b in mine.items())
