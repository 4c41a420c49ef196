"""Which slot attends to which finding, and how reliably."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import xlogx
from .scale import HOT_ROWS, clean, require, salted_join

EPS = 1e-8


def _stack(wide: DataFrame, keys: Sequence[str], cells) -> DataFrame:
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in ids.items()], col.alias("value"))
                     for ids, col in cells])
    return wide.withColumn("_e", F.explode(each)).select(*keys, "_e.*")


def bag_affinity(df: DataFrame, slots: Sequence[str], keys: Sequence[str] = (),
                 raw: bool = False) -> DataFrame:
    """(keys, bag_id, slot, finding, value): share of a slot's mass inside each finding.

    Finding 0 is the lesion, finding 1 its complement. One aggregation over the instances.
    """
    t = F.col("target").cast("double")
    wide = df.groupBy(*keys, "bag_id").agg(
        F.sum(t).alias("_t"), *[F.sum(s).alias(f"_a_{s}") for s in slots],
        *[F.sum(F.col(s) * t).alias(f"_l_{s}") for s in slots])
    cells = []
    for i, s in enumerate(slots):
        mass = F.lit(1.0) if raw else F.greatest(F.col(f"_a_{s}"), F.lit(EPS))
        cells += [({"slot": i, "finding": 0}, F.col(f"_l_{s}") / mass),
                  ({"slot": i, "finding": 1}, (F.col(f"_a_{s}") - F.col(f"_l_{s}")) / mass)]
    return _stack(wide, [*keys, "bag_id"], cells)


def ordered_affinity(df: DataFrame, slots: Sequence[str], order: str, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(bag_id, slot, value): share of a slot's mass inside the lesion, each sum added up in the order of ``order``.

    Ranking the shares makes ties of equal doubles, so the last bit counts: the same rows always give the same one. ``size`` bounds a
    bag's rows; bags above ``hot_rows`` and those of unknown size are summed as they come.
    """
    small = df.where(F.col(size) <= hot_rows)
    rest = df.where((F.col(size) > hot_rows) | F.col(size).isNull())
    t = F.col("target").cast("double")
    cells = F.struct(F.col(order).alias("_o"), *[x.cast("double").alias(n) for i, s in enumerate(slots) for n, x in ((f"a{i}", F.col(s)), (f"l{i}", F.col(s) * t))])
    lists = small.groupBy("bag_id").agg(F.array_sort(F.collect_list(cells)).alias("_c"))

    def total(name):
        return F.aggregate("_c", F.lit(0.0), lambda x, c: x + F.coalesce(c[name], F.lit(0.0)))
    each = _stack(lists, ["bag_id"], [({"slot": i}, total(f"l{i}") / F.greatest(total(f"a{i}"), F.lit(EPS))) for i in range(len(slots))])
    return each.unionByName(bag_affinity(rest, slots).where("finding = 0").select("bag_id", "slot", "value"))


def affinity(df: DataFrame, slots: Sequence[str], keys: Sequence[str] = (),
             raw: bool = False) -> DataFrame:
    """(keys, slot, finding, affinity, n_bags): mean over bags."""
    per = bag_affinity(df, slots, keys, raw)
    return per.groupBy(*keys, "slot", "finding").agg(F.avg("value").alias("affinity"),
                                                     F.count(F.lit(1)).alias("n_bags"))


def lesion_slot(aff: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The frozen lesion slot: highest lesion affinity, lowest slot on ties."""
    return aff.where("finding = 0").groupBy(*keys).agg(
        F.max_by("slot", F.struct(F.col("affinity"), -F.col("slot"))).alias("slot"),
        F.max("affinity").alias("affinity"))


def finding_affinity(df: DataFrame, slots: Sequence[str], findings: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slot, finding, affinity, n_bags) for any declared list of mask columns; finding is the column's place in the list.

    Bags without a single masked instance are left out, as they have no annotated finding. One aggregation over the instances; masks may overlap.
    """
    keys = list(keys)
    mask = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in findings}
    wide = df.groupBy(*keys, "bag_id").agg(
        F.sum(sum(mask.values())).alias("_any"), *[F.sum(s).alias(f"_a_{s}") for s in slots],
        *[F.sum(F.col(s) * mask[f]).alias(f"_l_{s}_{j}") for s in slots for j, f in enumerate(findings)]).where("_any > 0")
    cells = [({"slot": i, "finding": j}, F.col(f"_l_{s}_{j}") / F.greatest(F.col(f"_a_{s}"), F.lit(EPS)))
             for i, s in enumerate(slots) for j in range(len(findings))]
    per = _stack(wide, [*keys, "bag_id"], cells)
    return per.groupBy(*keys, "slot", "finding").agg(F.avg("value").alias("affinity"), F.count(F.lit(1)).alias("n_bags"))


MOST_FINDINGS, UNIT = 12, 1e12


def assignment(aff: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best one-to-one (slot, finding) assignment: one row per finding, its slot NULL if there are more findings than slots.

    As many findings as possible get a slot of their own; among those assignments the largest total affinity wins (compared in whole units of
    1e-12, so that the order of addition is moot), then the lowest slot of the first finding, of the second, and so on. A pair without an
    affinity is never assigned. A fold over the slots holds the best partial assignment for every set of findings: 2**F states per key, for F up to ``MOST_FINDINGS``.
    """
    keys = list(keys)
    rows = require(aff, [*keys, "slot", "finding"]).groupBy(*keys).agg(
        F.array_sort(F.collect_set("finding")).alias("_f"), F.array_sort(F.collect_set("slot")).alias("_s"),
        F.collect_list(F.struct("slot", "finding", F.round(clean(F.col("affinity")) * UNIT).cast("bigint").alias("units"))).alias("_c"))
    rows = rows.where(F.size("_f") > 0)  # no rows, no keys
    many = F.raise_error(F.concat(F.size("_f").cast("string"), F.lit(f" findings, at most {MOST_FINDINGS}"))).cast("int")
    rows = rows.withColumn("_n", F.when(F.size("_f") > MOST_FINDINGS, many).otherwise(F.size("_f")))
    cell = lambda s, f: F.get(F.filter("_c", lambda c: (c["slot"] == s) & (c["finding"] == f)), 0)["units"]
    rows = rows.withColumn("_grid", F.transform("_s", lambda s: F.struct(s.alias("slot"), F.transform("_f", lambda f: cell(s, f)).alias("units"))))
    states = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("_n")) - 1)
    state = "STRUCT<n: INT, total: BIGINT, order: ARRAY<BIGINT>>"  # order: minus the slot of each finding, so that the largest struct is the best
    none = F.lit(-(1 << 62))
    start = F.transform(states, lambda m: F.when(m == 0, F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("total"), F.array_repeat(none, F.col("_n")).alias("order"))).cast(state))

    def with_slot(best, row):
        def extended(m, f):
            before = F.get(best, m - F.call_function("shiftleft", F.lit(1), f))
            units = F.get(row["units"], f)
            order = F.transform(before["order"], lambda x, k: F.when(k == f, -row["slot"].cast("bigint")).otherwise(x))
            return F.when(before["n"].isNotNull() & units.isNotNull(), F.struct((before["n"] + 1).alias("n"), (before["total"] + units).alias("total"), order.alias("order"))).cast(state)
        taken = lambda m: F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda f: F.call_function("getbit", m, f) == 1)
        return F.transform(states, lambda m: F.array_max(F.concat(F.array(F.get(best, m)), F.transform(taken(m), lambda f: extended(m, f)))))
    best = F.array_max(F.aggregate("_grid", start, with_slot))
    named = F.posexplode(F.col("_b.order")).alias("_k", "_x")
    chosen = rows.select(*keys, "_f", best.alias("_b")).select(*keys, "_f", named)
    slot = F.when(F.col("_x") > none, -F.col("_x")).cast(aff.schema["slot"].dataType)
    return chosen.select(*keys, F.get("_f", F.col("_k")).alias("finding"), slot.alias("slot"))


def apply_findings(aff: DataFrame, frozen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Held-out affinity of every finding under a frozen assignment: (keys, finding, slot, affinity, mean_assigned, chance, lift).

    A finding without a slot keeps its row with a NULL affinity and is not part of the means.
    """
    keys = list(keys)
    on = [*keys, "finding", "slot"]
    named = frozen.join(aff.select(*on, "affinity"), on, "left")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    chance = aff.groupBy(*keys).agg(F.avg("affinity").alias("chance"))
    out = named.withColumn("mean_assigned", F.avg("affinity").over(whole))
    out = out.join(chance, keys) if keys else out.withColumn("chance", aff.agg(F.avg("affinity")).scalar())
    return out.withColumn("lift", F.col("mean_assigned") / F.greatest(F.col("chance"), F.lit(EPS)))


def apply_assignment(aff: DataFrame, frozen: DataFrame) -> DataFrame:
    """Held-out affinity under a frozen assignment, with lift over the mean of the matrix."""
    joined = aff.join(frozen.withColumn("named", F.lit(1)), ["slot", "finding"], "left")
    return joined.agg(
        F.avg(F.when(F.col("named") == 1, F.col("affinity"))).alias("mean_assigned_affinity"),
        F.max(F.when((F.col("named") == 1) & (F.col("finding") == 0), F.col("affinity"))).alias("lesion_affinity"),
        F.max(F.when((F.col("named") == 1) & (F.col("finding") == 1), F.col("affinity"))).alias("background_affinity"),
        F.avg("affinity").alias("chance_affinity"),
        (F.avg(F.when(F.col("named") == 1, F.col("affinity")))
         / F.greatest(F.avg("affinity"), F.lit(EPS))).alias("lift_over_chance"),
        F.count_distinct("slot").alias("n_slots"), F.count_distinct("finding").alias("n_findings"))


def winner(slots: Sequence[str]):
    """Index of the highest slot of an instance, the first on ties."""
    top = F.greatest(*slots)
    out = F.lit(len(slots) - 1)
    for i in range(len(slots) - 2, -1, -1):
        out = F.when(F.col(slots[i]) == top, F.lit(i)).otherwise(out)
    return out


def purity(df: DataFrame, slots: Sequence[str], label: str = "target") -> DataFrame:
    """Purity and normalised mutual information of the winning slot against the label.

    The contingency table has (slots x labels) rows; everything after it is tiny.
    """
    table = df.groupBy(winner(slots).alias("slot"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = table.groupBy("slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    labels = table.groupBy("label").agg(F.sum("n").alias("n"))
    by_slot = rows.agg(F.sum(xlogx("n")).alias("a"), F.sum("n").alias("n"), F.sum("top").alias("top"),
                       F.count(F.lit(1)).alias("k"))
    ha, hb, hab = (by_slot.select("a").scalar(), labels.agg(F.sum(xlogx("n"))).scalar(),
                   table.agg(F.sum(xlogx("n"))).scalar())
    n = F.col("n").cast("double")
    # entropies from sums of n ln n: H = ln N - sum(n ln n) / N
    h_slot, h_label, h_both = (F.log(n) - x / n for x in (ha, hb, hab))
    mutual = F.greatest(h_slot + h_label - h_both, F.lit(0.0))
    mean = (h_slot + h_label) / 2
    nmi = F.when((h_slot < 1e-15) & (h_label < 1e-15), F.lit(1.0)).when(mean > 0, mutual / mean).otherwise(F.lit(0.0))
    return by_slot.select((F.col("top") / F.col("n")).alias("purity"), nmi.alias("nmi"),
                          F.col("n").alias("n_instances"), F.col("k").alias("n_active_slots"))


def consistency(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Modal finding of each slot over bags against chance, one row per slot."""
    per = bag_affinity(df, slots).groupBy("bag_id", "slot").agg(
        F.max_by("finding", F.struct(F.col("value"), -F.col("finding"))).alias("finding"))
    counts = per.groupBy("slot", "finding").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.greatest(F.max("finding") + 1, F.lit(2))).scalar()
    return counts.groupBy("slot").agg(
        (F.max("n") / F.sum("n")).alias("rate"), F.sum("n").alias("n_bags")).withColumn(
        "chance", F.lit(1.0) / top).withColumn("lift", F.col("rate") / F.col("chance"))


def _cosine(top: Column, a: Column, b: Column, empty: float) -> Column:
    """Cosine from a product and two sums of squares; ``empty`` with a map of zeros."""
    norm = [F.greatest(F.sqrt(x), F.lit(EPS)) for x in (a, b)]
    return F.when((a == 0) | (b == 0), F.lit(empty)).otherwise(top / (norm[0] * norm[1]))


def redundancy(df: DataFrame, slots: Sequence[str], empty: float = 0.0) -> DataFrame:
    """Mean pairwise cosine of the slot maps per bag, averaged over bags. A map of zeros has the cosine ``empty``: NaN makes the mean undefined."""
    pairs = list(combinations(range(len(slots)), 2))
    wide = df.groupBy("bag_id").agg(
        *[F.sum(F.col(s) * F.col(s)).alias(f"q{i}") for i, s in enumerate(slots)],
        *[F.sum(F.col(slots[i]) * F.col(slots[j])).alias(f"x{i}_{j}") for i, j in pairs])
    cosines = [_cosine(F.col(f"x{i}_{j}"), F.col(f"q{i}"), F.col(f"q{j}"), empty) for i, j in pairs]
    per = wide.select("bag_id", (sum(cosines[1:], cosines[0]) / len(pairs)).alias("cosine"))
    return per.agg(F.avg("cosine").alias("mean_pairwise_cosine"), F.count(F.lit(1)).alias("n_bags"))


def winner_share(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Winning slot of every instance and its share of the instance's mass."""
    total = sum((F.col(s) for s in slots[1:]), F.col(slots[0]))
    return (df.withColumn("winner", winner(slots))
            .withColumn("share", F.greatest(*slots) / F.greatest(total, F.lit(EPS))))


def slot_mass(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Mass share of each slot in its bag."""
    total = sum((F.col(s) for s in slots[1:]), F.col(slots[0]))
    wide = df.groupBy("bag_id").agg(F.sum(total).alias("_t"), *[F.sum(s).alias(s) for s in slots])
    return _stack(wide, ["bag_id"], [({"slot": i}, F.col(s) / F.greatest(F.col("_t"), F.lit(EPS)))
                                     for i, s in enumerate(slots)]).withColumnRenamed("value", "share")


def slot_health(df: DataFrame, slots: Sequence[str], threshold: float, empty: float = 0.0) -> DataFrame:
    """Per bag: slots above the mass threshold, entropy of the shares, largest pairwise cosine. ``empty`` stands for what a map of zeros adds: NaN makes the bag undefined."""
    pairs = list(combinations(range(len(slots)), 2))
    total = sum((F.col(s) for s in slots[1:]), F.col(slots[0]))
    wide = df.groupBy("bag_id").agg(
        F.sum(total).alias("_t"), *[F.sum(s).alias(f"m{i}") for i, s in enumerate(slots)],
        *[F.sum(F.col(s) * F.col(s)).alias(f"q{i}") for i, s in enumerate(slots)],
        *[F.sum(F.col(slots[i]) * F.col(slots[j])).alias(f"x{i}_{j}") for i, j in pairs])
    shares = [F.col(f"m{i}") / F.greatest(F.col("_t"), F.lit(EPS)) for i in range(len(slots))]
    cosines = [_cosine(F.col(f"x{i}_{j}"), F.col(f"q{i}"), F.col(f"q{j}"), empty) for i, j in pairs]
    active = sum(((s > threshold).cast("int") for s in shares[1:]), (shares[0] > threshold).cast("int"))
    terms = [F.when(s == 0, F.lit(empty)).otherwise(s * F.log(F.greatest(s, F.lit(EPS)))) for s in shares]
    squares = [c * c for c in cosines]
    return wide.select("bag_id", active.alias("n_active"),
                       (F.greatest(*cosines) if len(cosines) > 1 else cosines[0]).alias("max_cosine"),
                       (-sum(terms[1:], terms[0])).alias("mass_entropy"),
                       (sum(squares[1:], squares[0]) / len(squares)).alias("diversity"))


def axial_normality(df: DataFrame, slots: Sequence[str], var_floor: float = 1.0, empty: float = 0.0) -> DataFrame:
    """KL of each slot's slice marginal to the Normal with its own moments, variance floored. The marginal of a slot without mass is ``empty``: NaN makes it undefined.

    sum(m (ln m - ln q)) with ln q = -(c - mu)^2 / 2 var - lse. Moments come from one
    aggregation per bag; the slice rows are then joined with them, salted by slice.
    """
    from .slots import long_slots
    per = df.groupBy("bag_id", "slice", "n_slices").agg(*[F.sum(s).alias(s) for s in slots])
    rows = long_slots(per, slots).withColumn("c", F.col("slice").cast("double"))
    sums = rows.groupBy("bag_id", "slot", "n_slices").agg(
        F.sum("score").alias("s"), F.sum(F.col("score") * F.col("c")).alias("sc"))
    first = salted_join(rows, sums, ["bag_id", "slot"], F.col("slice"), size="n_slices", per_copy=1 << 20)
    share = lambda x: F.when(F.col("s") == 0, F.lit(empty)).otherwise(F.col(x) / F.greatest(F.col("s"), F.lit(EPS)))
    first = first.withColumn("m", share("score")).withColumn("mu", share("sc")).drop("s", "sc")
    gap = (F.col("c") - F.col("mu")) * (F.col("c") - F.col("mu"))
    spread = first.groupBy("bag_id", "slot", "n_slices").agg(F.sum(F.col("m") * gap).alias("var"))
    second = salted_join(first, spread, ["bag_id", "slot"], F.col("slice"), size="n_slices", per_copy=1 << 20)
    raw = F.lit(-0.5) * gap / F.greatest(F.col("var"), F.lit(var_floor))
    out = second.groupBy("bag_id", "slot").agg(
        F.sum(F.col("m") * F.log(F.greatest(F.col("m"), F.lit(EPS)))).alias("neg_entropy"),
        F.sum(F.col("m") * raw).alias("cross"), F.sum(F.exp(raw)).alias("z"), F.sum("m").alias("mass"))
    return out.select("bag_id", "slot", (F.col("neg_entropy") - F.col("cross")
                                         + F.log("z") * F.col("mass")).alias("kl"))
