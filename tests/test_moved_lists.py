"""Donors' positives and targets as one row a request against the same row by row."""
import numpy as np
from pyspark.sql import functions as F

from patchrank.operators import nulls as nl
from patchrank.operators import ranking as rk
from patchrank.plans import reports as rp


def bags(spark, gaps=False):
    rng = np.random.default_rng(4)
    rows = [(b, p, n // 4 + 1, n, float(rng.integers(5)), int(rng.random() < 0.4)) for b, n in enumerate((4, 8, 3, 20, 12, 7, 1, 16)) for p in range(n) if not (gaps and b == 4 and p == 5)]
    df = spark.createDataFrame(rows, "bag_id BIGINT, pos BIGINT, n_slices BIGINT, n_rows BIGINT, s DOUBLE, target INT")
    return df, df.select("bag_id", "n_slices", "n_rows").distinct()


def test_lists_serve_the_requests_of_rows(spark):
    df, sizes = bags(spark)
    donors = nl.donor_map(sizes, 3, 6)
    want = {(r.rep, r.bag_id, r.pos) for r in nl.shuffle_positives(df, donors, 4).collect()}
    for hot in (1 << 20, 13, 0):
        lists, rest = nl.shuffle_lists(df, donors, 4, hot)
        got = {(r.rep, r.bag_id, x) for r in lists.collect() for x in r.positives} | {(r.rep, r.bag_id, r.pos) for r in nl.shuffle_positives(df, rest, 4).collect()}
        assert got == want and (hot > 13 or rest.count() > 0)
    assert nl.shuffle_lists(df, donors, 4)[0].count() <= donors.count()  # a row a request, not one a positive


def test_auc_of_lists_equals_auc_of_positives(spark):
    df, sizes = bags(spark)
    donors = nl.donor_map(sizes, 3, 6)
    ranks = rk.midranks(df, ["bag_id"], "s")
    want = sorted(rk.auc_of_positives(ranks, nl.shuffle_positives(df, donors, 4), ["rep", "bag_id"]).select("rep", "bag_id", "n_pos", "auc").collect())
    got = sorted(rk.auc_of_lists(df, nl.shuffle_lists(df, donors, 4)[0], "s").select("rep", "bag_id", "n_pos", "auc").collect())
    assert got == want
    small, hot = (rp._real_and_cross(df, sizes, "s", 4, 6, 3, h) for h in (1 << 20, 13))
    for a, b in zip(small, hot):
        assert sorted(a.select(sorted(a.columns)).collect(), key=str) == sorted(b.select(sorted(b.columns)).collect(), key=str)


def test_targets_in_arrays_equal_targets_in_rows(spark):
    for gaps in (False, True):
        df, sizes = bags(spark, gaps)
        df = df.withColumn("target", F.when(F.col("pos") == 2, F.lit(None)).otherwise(F.col("target")).cast("int"))
        donors = nl.donor_map(sizes, 3, 4)
        fast, mixed, slow = (sorted(nl.shuffle_targets(df, donors, 4, hot_rows=h).collect(), key=str) for h in (1 << 20, 13, 0))
        assert fast == slow and mixed == slow and len(fast) > 200


def test_rolled_members_move_lists(spark, monkeypatch):
    """Whole bags of known targets are not rolled row by row; bags with a gap or an unknown target are, with the same means."""
    import random

    from patchrank.operators import nulls
    from patchrank.plans import reports as rp
    rng = random.Random(5)
    rows = []
    for bag in range(40):
        n = rng.randrange(4, 30)
        for pos in range(n):
            if bag % 8 == 3 and pos == 2:
                continue
            target = None if bag % 8 == 5 and pos == 1 else int(rng.random() < 0.3)
            rows.append((bag, pos, pos // 4, pos % 4, -(-n // 4), n, target, None if rng.random() < 0.05 else float(rng.randrange(6))))
    df = spark.createDataFrame(rows, "bag_id BIGINT, pos BIGINT, slice BIGINT, patch BIGINT, n_slices BIGINT, n_rows BIGINT, target INT, s DOUBLE")
    sent = []
    replace = nulls.replace_target
    monkeypatch.setattr(nulls, "replace_target", lambda scores, targets: sent.append({r.bag_id for r in scores.select("bag_id").distinct().collect()}) or replace(scores, targets))

    def told(**kw):
        return sorted(tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in rp.content_free_members(df, "s", 4, 5, 2, **kw).collect())
    got, by_rows = told(), told(hot_rows=0)
    assert got == by_rows and len(got) == 7
    assert sent[0] and all(b % 8 in (3, 5) for b in sent[0]) and len(sent[1]) > len(sent[0])
