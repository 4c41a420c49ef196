"""What a search asks of the driver: few jobs, no confirming round over settled edges, and packed features instead of two arrays a row."""
import random
import uuid

import numpy as np

from patchrank.llm import common, jaccard, quality

from . import brute
from .test_census import corpus


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stars_are_not_joined_again(spark, monkeypatch):
    """Every round writes the edges anew; stars need none, and a chain that lies in several tasks ends with stars."""
    names = []
    keep = common.keep
    monkeypatch.setattr(common, "keep", lambda df, name: names.append(name) or keep(df, name))
    star = spark.createDataFrame([(i, 1) for i in range(2, 50)], "a BIGINT, b BIGINT").repartition(5)
    assert {r.node: r.component for r in common.components(star).collect()} == dict.fromkeys(range(1, 50), 1)
    assert len(names) == 1
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    want = brute.components({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT").repartition(9)).collect()} == want
    assert len(names) > 2


def test_settled_only_for_stars(spark):
    def told(*edges):
        return common.settled(spark.createDataFrame(list(edges), "a BIGINT, b BIGINT"))
    assert told() and told((2, 1)) and told((2, 1), (3, 1), (9, 8))
    assert not told((2, 1), (3, 2)) and not told((3, 1), (3, 2))


def test_a_sum_is_observed_while_rows_are_written(spark):
    rows = spark.range(1000).selectExpr("id", "cast(repeat('x', int(id % 5)) AS BINARY) AS members")
    (kept, total), n = jobs(spark, lambda: common.keep_bucketed_sum(rows, "observed", 3, "id", common.F.octet_length("members")))
    assert (kept.count(), total, n) == (1000, 2000, 1)
    kept, total = common.keep_bucketed_sum(rows.where("id < 0"), "observed", 3, "id", common.F.octet_length("members"))
    assert (kept.count(), total) == (0, 0)


def test_a_search_asks_for_few_jobs(spark, make):
    rows = corpus()
    got, n = jobs(spark, lambda: [tuple(r) for r in jaccard.classes_of(make(rows, 7), width=5, percent=80).collect()])
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(brute.jaccard(rows, 5, 80), key=key)
    assert n <= 70, n


def test_features_reach_the_driver_packed():
    """Prose of 6,000 words: at most a fifth of the eight bytes that two arrays take for a bucket, and the same values."""
    rng = np.random.default_rng(2)
    own = np.concatenate([rng.zipf(1.4, 6000) % (1 << 17), rng.integers(0, 1 << 17, 2000)]).astype(np.int32)
    buckets, counts = np.unique(own, return_counts=True)
    data = quality.folded(buckets, counts)
    b, c = quality.unfolded(data)
    assert np.array_equal(b, buckets) and b.dtype == np.int32 and np.array_equal(c, counts)
    assert 5 * len(data) <= 8 * len(buckets)
    assert [len(x) for x in quality.unfolded(quality.folded(buckets[:0], counts[:0]))] == [0, 0]


def plans(spark, work):
    """Plans of all queries that ``work`` runs, as they were carried out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = store.executionsList()
    return [listed.apply(i).physicalPlanDescription() for i in range(before, listed.size())]


def test_no_table_of_documents_is_broadcast(spark, make):
    """Files understate what a hashed relation takes of the driver; small tables too are joined as large ones are."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB")
    found = plans(spark, lambda: jaccard.dedup(make(corpus(), 7), width=5, percent=80).collect())
    assert found and not [x for x in found if "BroadcastExchange" in x]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a BIGINT, b BIGINT").repartition(9)
    assert not [x for x in plans(spark, lambda: common.components(chain).collect()) if "BroadcastExchange" in x]
