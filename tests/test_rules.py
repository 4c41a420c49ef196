import pytest
from pyspark.sql import functions as F

from patchrank.operators import filters as fl
from patchrank.operators import ingest as ing
from patchrank.operators import provenance as pv
from patchrank.operators import splits as sp
from patchrank.operators import verdicts as vd
from patchrank.sources import cache as ca
from patchrank.sources import registry as sr
from patchrank.streaming import ingest as ig


@pytest.fixture(scope="module")
def cond(spark):
    return spark.createDataFrame([("c",)], "condition string")


def gaps(spark, values):
    return spark.createDataFrame([("c", f"a{i}", float(v)) for i, v in enumerate(values)], "condition string, arm string, gap double")


def outcome(df):
    return df.first().outcome


def test_h1(spark, cond):
    control = gaps(spark, [0.0978, 0.0259])
    tie = gaps(spark, [0.0])
    assert outcome(vd.h1(cond, gaps(spark, [0.01] * 4 + [0.03] * 3), control, tie, 0.02)) == "PASS"
    assert outcome(vd.h1(cond, gaps(spark, [0.01] * 3 + [0.02] * 4), control, tie, 0.02)) == "FAIL"
    assert outcome(vd.h1(cond, gaps(spark, [0.01]), gaps(spark, [0.02]), tie, 0.02)) == "VOID"
    assert outcome(vd.h1(cond, gaps(spark, [0.01]), control, gaps(spark, [0.001]), 0.02)) == "VOID"
    assert outcome(vd.h1(cond, gaps(spark, [0.01]).limit(0), control, tie, 0.02)) == "NOT_RUN"


def test_h3_h4_h5_h8(spark, cond):
    floor = spark.createDataFrame([("c", 0.77, 30), ("c", 0.76, 30)], "condition string, p95 double, n int")
    assert outcome(vd.h3(cond, floor, 0.75, 30)) == "PASS"
    assert outcome(vd.h3(cond, floor, 0.765, 30)) == "FAIL"
    assert outcome(vd.h3(cond, floor, 0.75, 31)) == "VOID"
    s = spark.createDataFrame([("c", "a", 0.01), ("c", "b", 0.019)], "condition string, arm string, skill double")
    assert outcome(vd.h4(cond, s, 0.05, 0.02)) == "PASS"
    assert outcome(vd.h4(cond, s, 0.019, 0.02)) == "FAIL"
    assert outcome(vd.h5(cond, s, 0.019)) == "PASS"
    assert outcome(vd.h5(cond, s, 0.018)) == "FAIL"
    v = spark.createDataFrame([("x", 0.6)], "condition string, value double")
    assert outcome(vd.h8(cond, v, 0.5)) == "NOT_RUN"


def test_h7_and_h10(spark, cond):
    probe = spark.createDataFrame([("c", 0.7)], "condition string, skill double")
    m = spark.createDataFrame([("c", 0.01), ("c", None)], "condition string, skill double")
    assert outcome(vd.h7(cond, probe, m, 0.5, 0.1)) == "PASS"
    assert outcome(vd.h7(cond, probe, m, 0.7, 0.1)) == "FAIL"
    assert outcome(vd.h7(cond, probe, m.where("skill IS NULL"), 0.5, 0.1)) == "VOID"
    o = spark.createDataFrame([("c", k) for k in ("trained_wins", "trained_wins", "oracle_wins", None)], "condition string, interval string")
    assert outcome(vd.h10(cond, o, )) == "FAIL"
    assert outcome(vd.h10(cond, o.where("interval = 'oracle_wins'"))) == "PASS"


def test_h9(spark):
    schema = "lo_a double, hi_a double, lo_b double, hi_b double, skill_a double, skill_b double"
    rows = [(0.1, 0.2, 0.3, 0.4, None, None), (0.1, 0.35, 0.3, 0.4, None, None), (0.5, 0.6, 0.3, 0.4, None, None),
            (0.1, 0.2, 0.3, 0.4, 0.1, 0.2), (None, 0.2, 0.3, 0.4, None, None)]
    got = [(r.outcome, r.basis) for r in vd.h9(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [("PASS", "ordered"), ("FAIL", "indistinguishable"), ("FAIL", "reversed"), ("FAIL", "skill disagrees"), ("VOID", "undefined")]


def test_chain_and_stamps(spark):
    h = ["%016x" % i for i in range(6)]
    chain = spark.createDataFrame([(1, "amendment", h[0], h[1]), (2, "amendment", h[1], h[1]), (3, "deviation", h[1], h[2])],
                                  "seq bigint, kind string, before string, after string")
    assert {r.status for r in pv.chain_check(chain).collect()} == {"ok"}
    broken = chain.withColumn("after", F.when(F.col("seq") == 1, h[5]).otherwise(F.col("after")))
    assert {r.seq: r.status for r in pv.chain_check(broken).collect()}[1] == "gap"
    stamps = spark.createDataFrame([(i, x) for i, x in enumerate([h[0], h[1], h[2], "junk"])], "i int, hash string")
    got = {r.hash: (r.status, r.n_later) for r in pv.place_stamps(stamps, chain, "i").collect()}
    assert got[h[2]][0] == "current" and got["junk"][0] == "unknown"
    assert got[h[0]] == ("superseded", 2) and got[h[1]] == ("superseded", 1)


def test_gate_and_group(spark):
    declared = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h"), (4, "i")], "k int, grp string")
    found = spark.createDataFrame([(1, "now", "confirm", False), (2, "now", "confirm", True), (3, "now", "confirm", False)],
                                  "k int, hash string, role string, dirty boolean")
    g = pv.gate(declared, found, "k", "now", "confirm")
    assert {r.k: r.kind for r in g.collect()} == {1: "usable", 2: "UNTRUSTED", 3: "usable", 4: "ABSENT"}
    assert {r.grp: r.state for r in pv.gate_groups(g, "grp").collect()} == {"g": "VOID", "h": "usable", "i": "NOT_RUN"}


def test_strict_lookup_and_agreement_refuse(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, i int")
    config = spark.createDataFrame([("a", 1.0)], "key string, v double")
    with pytest.raises(Exception, match="undeclared parameter b"):
        pv.require(rows, config, "key", "v", "i").collect()
    ours = spark.createDataFrame([("a", 1.0)], "t string, v double")
    with pytest.raises(Exception, match="stored value differs"):
        pv.stored_agreement(ours, ours.withColumn("v", F.col("v") + 1e-6), ["t"], "v").collect()


def test_split_keeps_patients_whole(spark):
    rows = [(i, i % 40, (i % 40) % 3, i % 40 == 0) for i in range(200)]
    s = spark.createDataFrame(rows, "bag_id int, patient_id int, label int, has_mask boolean")
    a = sp.assign(s, sp.stratified_split(s))
    assert a.count() == 200 and sp.leaks(a).count() == 0
    moved = sp.masked_to_eval(a)
    assert sp.leaks(moved).count() == 0 and moved.where("split = 'train' AND has_mask").count() == 0
    with pytest.raises(Exception, match="would empty the training split"):
        sp.masked_to_eval(a.withColumn("has_mask", F.lit(True))).collect()


def test_scan_labels(spark):
    rows = [(1, 0, 4), (1, 0, 5), (1, 1, 1), (2, 0, 3), (3, 0, 1), (3, 1, 3)]
    df = spark.createDataFrame(rows, "bag_id int, finding int, reading int")
    assert {r.bag_id: r.label for r in fl.scan_labels(df).collect()} == {1: 1, 2: None, 3: 0}


def test_upsample_weights_sum_to_one(spark):
    w = fl.upsample_weights(spark, 4, 8).groupBy("y", "x").agg(F.sum("weight").alias("t"))
    assert w.count() == 64 and w.where(F.abs(F.col("t") - 1) > 1e-12).count() == 0


def test_adaptive_bins_overlap(spark):
    got = {(r.at, r.bin) for r in ing.bin_table(spark, 8, 3).collect()}
    assert (2, 0) in got and (2, 1) in got and (5, 1) in got and (5, 2) in got and len(got) == 10


def test_containment_without_positives_is_null(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (2, 1, 0.05), (2, 1, 0.9)], "bag_id int, target int, frac double")
    got = {(r.bag_id, r.cut): r.contained for r in ing.containment(df).collect()}
    assert got[(1, 0.1)] is None and got[(2, 0.0)] == 1.0 and got[(2, 0.05)] == 0.5


def test_merge_refuses_duplicates_and_unknown_scorers(spark):
    a = spark.createDataFrame([(1, "m")], "bag_id int, method string")
    with pytest.raises(Exception, match="series in two shards"):
        ca.merge_shards([a, a], "method").collect()
    with pytest.raises(KeyError):
        sr.score_all(a, ["nobody"])


def test_replace_series_is_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    ca.replace_series(spark.createDataFrame([(i, j, 1) for i in range(10) for j in range(3)], "bag_id int, j int, v int"), path, buckets=4)
    ca.replace_series(spark.createDataFrame([(3, 0, 2), (11, 0, 2)], "bag_id int, j int, v int"), path, buckets=4)
    got = sorted((r.bag_id, r.v) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, 1) for i in range(10) for _ in range(3) if i != 3] + [(3, 2), (11, 2)])


def test_streaming_scores_each_bag_once(spark, tmp_path):
    rows = spark.createDataFrame([(b, p, p // 4, 2, int(p == b % 8), float((p * 7) % 5)) for b in range(6) for p in range(8)],
                                 "bag_id int, pos int, slice int, n_slices int, target int, s double")
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows.where("bag_id < 3").write.parquet(landing)
    assert ig.ingest(spark, landing, out, mark, rows.schema, 4, "s").count() == 3
    rows.write.mode("append").parquet(landing)  # the first three again
    done = ig.ingest(spark, landing, out, mark, rows.schema, 4, "s")
    assert done.count() == 6 and done.select("bag_id").distinct().count() == 6
