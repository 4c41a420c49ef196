"""Slot assignment for any number of findings against all permutations."""
import itertools
import random

import pytest

from patchrank.operators import alignment as al


def brute(cells, slots, findings):
    """The best slot of every finding, None where there is none left: most pairs, highest total, lowest slots."""
    best = None
    for chosen in itertools.product([None, *slots], repeat=len(findings)):
        used = [s for s in chosen if s is not None]
        if len(set(used)) < len(used) or any(s is not None and cells.get((s, f)) is None for s, f in zip(chosen, findings)):
            continue
        total = sum(round(cells[s, f] * 1e12) for s, f in zip(chosen, findings) if s is not None)
        key = (len(used), total, tuple(-s if s is not None else -10 ** 9 for s in chosen))
        if best is None or key > best[0]:
            best = key, chosen
    return dict(zip(findings, best[1]))


@pytest.mark.parametrize("n_findings", [1, 2, 3, 4, 5])
def test_assignment_equals_all_permutations(spark, n_findings):
    rng = random.Random(n_findings)
    rows, want = [], {}
    for key in range(24):
        slots = sorted(rng.sample(range(9), rng.randint(1, 6)))
        findings = sorted(rng.sample(range(-3, 9), n_findings))
        coarse = key % 3 == 0  # many ties
        cells = {(s, f): rng.choice([0.0, 0.5, 1.0]) if coarse else rng.random() * rng.choice([1, 1, -1]) for s in slots for f in findings}
        if key % 4 == 1:
            cells[slots[0], findings[0]] = None
        if key % 8 == 3:
            cells[slots[-1], findings[-1]] = float("nan")
        rows += [(key, s, f, x) for (s, f), x in cells.items()]
        want[key] = brute({k: None if x is None or x != x else x for k, x in cells.items()}, slots, findings)
    aff = spark.createDataFrame(rows, "key INT, slot INT, finding INT, affinity DOUBLE").repartition(4)
    got: dict = {}
    for r in al.assignment(aff, ["key"]).collect():
        got.setdefault(r.key, {})[r.finding] = r.slot
    assert got == want


def test_no_finding_is_lost_and_an_empty_table_gives_none(spark):
    rows = [(s, f, 1.0) for s in range(2) for f in range(7)]
    aff = spark.createDataFrame(rows, "slot INT, finding INT, affinity DOUBLE")
    out = {r.finding: r.slot for r in al.assignment(aff).collect()}
    assert sorted(out) == list(range(7)) and sorted(x for x in out.values() if x is not None) == [0, 1]
    assert al.assignment(aff.where("slot > 5")).count() == 0
    with pytest.raises(Exception, match="13 findings"):
        al.assignment(spark.createDataFrame([(0, f, 1.0) for f in range(13)], "slot INT, finding INT, affinity DOUBLE")).collect()


def test_bags_without_a_finding_are_left_out(spark):
    rows = [("a", 1.0, 3.0, 1, 0), ("a", 1.0, 1.0, 0, 1), ("b", 1.0, 1.0, 0, 0), ("c", 2.0, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, "bag_id STRING, s0 DOUBLE, s1 DOUBLE, m0 INT, m1 INT")
    got = {(r.slot, r.finding): (r.affinity, r.n_bags) for r in al.finding_affinity(df, ["s0", "s1"], ["m0", "m1"]).collect()}
    assert got == {(0, 0): (0.75, 2), (0, 1): (0.75, 2), (1, 0): (0.375, 2), (1, 1): (0.125, 2)}
