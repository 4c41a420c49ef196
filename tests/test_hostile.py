"""One right answer whatever the group size: infinite, tiny, huge and saturated scores, unknown sizes and targets."""
import random

import pytest
from pyspark.sql import functions as F

from patchrank.operators import filters as fl
from patchrank.operators import provenance as pv
from patchrank.operators import ranking as rk
from patchrank.operators import scale as sc
from patchrank.operators import templates as tp
from patchrank.streaming import ingest as ig

INF = float("inf")
SCORES = {
    "infinite": lambda r, i: r.choice([INF, -INF, 0.5, -0.5, 0.0]),
    "tiny": lambda r, i: r.random() * 1e-20,
    "huge": lambda r, i: r.choice([-1, 1]) * r.random() * 1e300,
    "saturated": lambda r, i: 1 - r.randrange(50) * 1e-13,
    "denormal": lambda r, i: r.randrange(9) * 5e-324 + r.randrange(2),
}


def brute_auc(pairs):
    p, q = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))


@pytest.mark.parametrize("kind", SCORES)
def test_auc_of_hostile_scores(spark, kind):
    rng = random.Random(kind)
    rows = [(b, SCORES[kind](rng, i), rng.choice([0, 1, 1, None]), rng.choice([40, None])) for b in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "bag_id INT, score DOUBLE, target INT, n INT")
    want = {b: brute_auc([(s + 0.0, y) for bag, s, y, _ in rows if bag == b and y is not None]) for b in range(3)}
    same = df.withColumn("n", F.when(F.col("bag_id") == 1, F.lit(None)).otherwise(F.lit(40)))
    for frame, size, hot in ((df, None, 1), (same, "n", 0), (same, "n", 1 << 20)):
        got = {r.bag_id: r.auc for r in rk.auc(frame, ["bag_id"], size=size, hot_rows=hot).collect()}
        assert got == pytest.approx(want, abs=1e-12)
        ap = rk.average_precision(frame, ["bag_id"], size=size, hot_rows=hot).collect()
        assert {r.bag_id: r.n for r in ap} == {b: sum(x[0] == b and x[2] is not None for x in rows) for b in range(3)}


@pytest.mark.parametrize("unit", [1.0, 2.0 ** -70, 2.0 ** 900])
@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_slice_means_at_any_scale(spark, unit, hot_rows):
    rows = [(0, s, p, s * 4 + p, 5, int(s in (1, 4) and p == 0), (1 + s) * 0.1 * unit * (1 + p % 2)) for s in range(5) for p in range(4)]
    df = spark.createDataFrame(rows, "bag_id INT, slice INT, patch INT, pos INT, n_slices INT, target INT, score DOUBLE")
    if unit > 1:
        df = df.withColumn("score", F.col("score") / F.lit(2.0 ** 800))  # slice means are FLOAT
    r = rk.axes(df, 4, hot_rows=hot_rows).first()
    assert r["slice"] == pytest.approx(4 / 6) and r.n_lesion_slices == 2


def test_axes_with_unknown_size_and_targets(spark):
    rows = [(b, s, p, s * 4 + p, None if b else 2, None if b == 2 and p == 3 else int(s == 0 and p == 1), float(s * 4 + p)) for b in range(3) for s in range(2) for p in range(4)]
    df = spark.createDataFrame(rows, "bag_id INT, slice INT, patch INT, pos INT, n_slices INT, target INT, score DOUBLE")
    assert {r.bag_id for r in rk.axes(df, 4).collect()} == {0, 1}  # a bag with unlabelled rows is ragged


def test_buckets_never_decrease_and_split_saturated_scores(spark):
    rng = random.Random(0)
    values = sorted({INF, -INF, 0.0, 1.0, 0.5, 0.25, 2.0, -1.0, 1e308, 5e-324, *[rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-30, 30) for _ in range(500)],
                     *[1 - 2.0 ** -k for k in range(1, 54)], *[1 - rng.random() * 1e-4 for _ in range(300)], *[0.5 + rng.random() / 2 for _ in range(300)]})
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    codes = {r.v: r.b for r in df.select("v", sc.score_bucket(F.col("v")).alias("b")).collect()}
    ordered = [codes[v] for v in values]
    assert ordered == sorted(ordered)
    assert len({codes[v] for v in values if 0.9999 < v < 1}) > 250


def test_salted_join_keeps_rows_of_unknown_size(spark):
    big = spark.createDataFrame([(1, i, None) for i in range(5)] + [(2, i, 9000) for i in range(5)], "k INT, pos INT, n INT")
    small = spark.createDataFrame([(1, None, "a"), (2, 9000, "b")], "k INT, n INT, v STRING")
    assert sc.salted_join(big, small, ["k"], F.col("pos"), size="n").groupBy("v").count().collect().__len__() == 2
    assert sc.salted_join(big, small, ["k"], F.col("pos"), size="n").count() == 10


def test_chain_sees_a_removed_entry(spark):
    h = [f"{i:016x}" for i in range(6)]
    rows = [(i, "amendment", h[i - 1], h[i]) for i in range(1, 6)]
    whole = spark.createDataFrame(rows, "seq BIGINT, kind STRING, before STRING, after STRING")
    assert {r.status for r in pv.chain_check(whole).collect()} == {"ok"}
    hole = whole.where("seq <> 3")
    assert {r.seq: r.status for r in pv.chain_check(hole).collect()} == {1: "ok", 2: "gap", 4: "ok", 5: "ok"}
    far = whole.withColumn("seq", F.col("seq") * 100_000)
    assert {r.status for r in pv.chain_check(far).collect()} == {"ok"}


def test_guards_raise(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 1, "fit"), (0, 0, 1, 1, 0, "score")], "bag_id INT, slice INT, patch INT, n_slices INT, target INT, part STRING")
    with pytest.raises(ValueError, match="no column"):
        tp.fit_cells(df, F.col("target"), 4, refuse_split="score")
    with pytest.raises(Exception, match="template fit saw split"):
        tp.fit_cells(df, F.col("target"), 4, refuse_split="score", split_column="part").collect()
    family = tp.fill(tp.fit_cells(df.withColumn("arm", F.lit("a")), F.col("target"), 2, ["arm"]), 2, 2, ["arm"])
    with pytest.raises(Exception, match="no fitted cell"):
        tp.apply_family(df.withColumn("arm", F.lit("b")), family, 2, ["arm"]).collect()
    region = spark.createDataFrame([(0, 0, 1.0)], "bag_id INT, pos INT, frac DOUBLE")
    rows = spark.createDataFrame([(0, 0), (0, 1)], "bag_id INT, pos INT")
    assert fl.restrict(rows.where("pos = 0"), region, 0.5).count() == 1
    with pytest.raises(Exception, match="no region value"):
        fl.restrict(rows, region, 0.5).collect()


def test_ingest_of_split_slices_and_of_bags_that_become_ragged(spark, tmp_path):
    schema = "bag_id INT, pos INT, slice INT, n_slices INT, slice_pos INT, target INT, s DOUBLE"
    rows = [(b, p, p // 4, 2, 0, int(p in (1, 6)), float((p * 7) % 8)) for b in range(3) for p in range(8)]
    first = spark.createDataFrame([r for r in rows if r[0] < 2 and r[1] % 2 == 0], schema)
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first.write.parquet(landing)
    ig.ingest(spark, landing, out, mark, first.schema, 4, "s")
    spark.createDataFrame([r for r in rows if r[0] < 2 and r[1] % 2 == 1] + [r for r in rows if r[0] == 2], schema).write.mode("append").parquet(landing)
    done = ig.ingest(spark, landing, out, mark, first.schema, 4, "s").collect()
    whole = {r.bag_id: r for r in rk.axes(spark.createDataFrame(rows, schema).drop("slice_pos", "n_slices"), 4, score="s").collect()}
    assert {r.bag_id: (r.flat, r["slice"], r.within_slice) for r in done} == {b: (r.flat, r["slice"], r.within_slice) for b, r in whole.items()}
    spark.createDataFrame([(1, 8, 2, 3, 0, 0, 1.0)], schema).write.mode("append").parquet(landing)
    again = ig.ingest(spark, landing, out, mark, first.schema, 4, "s")
    assert {r.bag_id for r in again.collect()} == {0, 2}


@pytest.mark.parametrize("hot_rows", [0, 1 << 20])
def test_moving_positives_equals_moving_targets(spark, hot_rows):
    from patchrank.operators import nulls as nl
    rng = random.Random(9)
    sizes = {0: 2, 1: 5, 2: 3, 3: 1}
    rows = [(b, p, n, n * 4, int(rng.random() < 0.3), rng.choice([0.1, 0.2, 0.5, 0.9])) for b, n in sizes.items() for p in range(n * 4)]
    df = spark.createDataFrame(rows, "bag_id INT, pos BIGINT, n_slices BIGINT, n_rows BIGINT, target INT, score DOUBLE")
    bags = df.groupBy("bag_id").agg(F.max("n_slices").alias("n_slices"))
    donors = nl.donor_map(bags, 3, 4)
    ranks = rk.midranks(df, ["bag_id"], size="n_rows", hot_rows=hot_rows)
    for targets, positives in ((nl.roll_targets(df, 4, 3, 4), nl.roll_positives(df, 4, 3, 4)), (nl.shuffle_targets(df, donors, 4), nl.shuffle_positives(df, donors, 4))):
        want = {(r.rep, r.bag_id): (r.n_pos, r.auc) for r in rk.auc(nl.replace_target(df, targets), ["rep", "bag_id"]).collect()}
        got = {(r.rep, r.bag_id): (r.n_pos, r.auc) for r in nl.every_replicate(rk.auc_of_positives(ranks, positives, ["rep", "bag_id"]), bags, 4).collect()}
        assert got.keys() == want.keys() and len(got) == 16
        for k, (n, a) in want.items():
            assert got[k][0] == n and (got[k][1] == pytest.approx(a) if a is not None else got[k][1] is None)


def test_atlas_refuses_bad_cases_and_counts_the_rest(spark):
    from patchrank.plans import atlas as at
    rows = [(b, p, p // 4, p % 4, int(b % 3 == 0 and p == 1)) for b in range(30) for p in range(8 + (b == 7))]
    df = spark.createDataFrame(rows, "bag_id INT, pos INT, slice INT, patch INT, target INT")
    out = at.atlas_coverage(df, 4).collect()
    assert sum(r.n_cases for r in out) == 30 and sum(r.n_kept for r in out) == 10 and sum(r.n_ragged for r in out) == 1 and sum(r.n_no_lesion for r in out) == 19
    for bad, text in ((df.union(df.limit(1)), "duplicate position"), (df.where("bag_id <> 3 OR pos <> 2"), "broken layout"), (df.withColumn("slice", F.lit(0)), "broken layout"),
                      (df.withColumn("target", F.lit(0)), "no usable case")):
        with pytest.raises(Exception, match=text):
            at.atlas_coverage(bad, 4).collect()


def test_blinding_is_inverted_and_refuses_shared_codes(spark):
    rows = spark.createDataFrame([("a", "a_seed0", "spec of a"), ("b", "b_seed1", "b"), ("ctl", "ctl_seed0", "ctl")], "arm STRING, tag STRING, spec STRING")
    key = spark.createDataFrame([("a", "X1", True), ("b", "X2", None), ("ctl", "X3", False)], "name STRING, code STRING, blind BOOLEAN")
    hidden = pv.blind(rows, key, "arm", ["tag"])
    assert sorted(r.tag for r in hidden.collect()) == ["X1_seed0", "X2_seed1", "ctl_seed0"]
    assert sorted(pv.blind(hidden, key, "arm", ["tag"], inverse=True).collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="several names share"):
        pv.blind(rows, key.withColumn("code", F.lit("X")), "arm").collect()
    with pytest.raises(Exception, match="no blinding key"):
        pv.blind(rows, key.where("name <> 'b'"), "arm").collect()


def test_grid_and_file_sizes(spark, tmp_path):
    from patchrank.sources import cache as ca
    with pytest.raises(ValueError, match="does not hold"):
        fl.grid_cells(spark.range(1).withColumnRenamed("id", "pos"), 16, 5)
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    r = ca.stored_size(spark.read.parquet(path)).first()
    assert r.n_files == 3 and r.n_bytes == sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))


def test_holm_family_keeps_a_member_that_cannot_be_paired(spark):
    from patchrank.plans import reports as rp
    rng = random.Random(3)
    rows = [(s, rng.randrange(2) if s < 2 else 1, rng.random(), rng.random(), rng.random()) for s in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "seed INT, target INT, a DOUBLE, b DOUBLE, ref DOUBLE")
    out = rp.holm_family(df, ["a", "b"], ["ref"]).collect()
    assert len(out) == 6
    assert {(r.seed, r.short, r.n_family) for r in out} == {(0, False, 2), (1, False, 2), (2, True, 2)}
    assert all((r.p_adjusted is None) == (r.seed == 2) for r in out)
