"""The cross-patient chain against plain Python."""
from pyspark.sql import functions as F

from patchrank.operators import nulls as nl
from patchrank.plans import reports as rp


def auc(pairs):
    pos, neg = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def mean(values):
    values = [x for x in values if x is not None]
    return sum(values) / len(values) if values else None


def test_chain_equals_brute_force(spark):
    """Five bags; bag 3 has no positive and bag 4 only positives, so they have no real value but still are donors."""
    rows = [(b, p, 2 + b % 2, int(b == 4 or b != 3 and (p * 7 + b) % 5 == 0), float((p * 13 + b * 3) % 7)) for b in range(5) for p in range((2 + b % 2) * 4)]
    df = spark.createDataFrame(rows, "bag_id BIGINT, pos BIGINT, n_slices BIGINT, target INT, s DOUBLE")
    sizes = df.groupBy("bag_id").agg(F.max("n_slices").alias("n_slices"))
    template = spark.createDataFrame([(0, 0.6), (1, 0.7), (2, None)], "bag_id BIGINT, auc DOUBLE")
    donors = {(r.rep, r.bag_id): r.donor_id for r in nl.donor_map(sizes, 3, 6).collect()}
    by_bag = {b: sorted((p, t, s) for x, p, _, t, s in rows if x == b) for b in range(5)}
    real = {b: auc([(s, t) for _, t, s in by_bag[b]]) for b in by_bag}
    drawn = {(rep, b): auc([(s, by_bag[d][p % len(by_bag[d])][1]) for p, _, s in by_bag[b]]) for (rep, b), d in donors.items()}
    cross = {b: mean(drawn[rep, b] for rep in range(6)) for b in by_bag}
    both = [b for b in by_bag if real[b] is not None and cross[b] is not None]
    full, swapped = mean(real[b] for b in both), mean(cross[b] for b in both)
    links = [0.5, 0.65, swapped, full]
    got = rp.cross_patient_chain(df, sizes, template, "s", 4, 6, 3).collect()
    steps = {(r["from"], r["to"]): r for r in got}
    names = ["chance", "fitted_template", "cross_patient", "full"]
    assert len(got) == 4
    for i in range(3):
        r = steps[names[i], names[i + 1]]
        assert abs(r.delta - (links[i + 1] - links[i])) < 1e-12 and abs(r.frac - r.delta / (full - 0.5)) < 1e-9
    total = steps["chance", "full"]
    assert total.kind == "total" and abs(total.delta - (full - 0.5)) < 1e-12
    want = mean(mean(drawn[rep, b] for b in by_bag) for rep in range(6))
    for r in got:
        assert r.n_bags == len(both) and r.n_without == 0 and r.consistent and abs(r.mean_over_derangements - want) < 1e-12


def test_a_link_without_a_value_gives_null_steps(spark):
    df = spark.createDataFrame([(0, 0, 1, 1, 1.0), (0, 1, 1, 0, 0.0)], "bag_id BIGINT, pos BIGINT, n_slices BIGINT, target INT, s DOUBLE")
    sizes = df.groupBy("bag_id").agg(F.max("n_slices").alias("n_slices"))
    nothing = spark.createDataFrame([], "bag_id BIGINT, auc DOUBLE")
    got = {(r["from"], r["to"]): r.delta for r in rp.cross_patient_chain(df, sizes, nothing, "s", 2, 2).collect()}
    assert got == {("chance", "fitted_template"): None, ("fitted_template", "cross_patient"): None, ("cross_patient", "full"): 0.0, ("chance", "full"): 0.5}
