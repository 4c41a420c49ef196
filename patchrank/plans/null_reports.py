"""Null battery, crosstab and axis decomposition under nulls."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import bagwise as bw
from ..operators import nulls as nl
from ..operators import ranking as rk
from ..operators import templates as tp
from ..operators.scale import HOT_ROWS
from ..session import pin

SCALES = (0.5, 1.0, 2.0, 4.0)
BIAS = (0.5, 0.0, -0.5)


def random_kinds(scales: Sequence[float]) -> list[tuple[str, float, float]]:
    """(null, scale, weight of the bias) of random attention."""
    return [(f"random_{s:g}", float(s), 0.0) for s in scales] + [("random_bias", 1.0, 1.0)]


def null_rows(rows: DataFrame, bags: DataFrame, slots: Sequence[str], n_patch: int, reps: int,
              seed: int = 0, scales: Sequence[float] = SCALES,
              bias: Sequence[float] = BIAS, donors: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """All nulls as one table: (null, rep, bag, instance, target, slots, part).

    Replicates are rows, so one evaluation pass serves the whole battery. Random attention is
    row-local; the permuted targets are joined by identity. ``given`` are the donors' rows where they are not among ``rows``.
    """
    keep = ["bag_id", "pos", "n_slices", "target", *slots]
    base = rows.select(*keep)
    real = base.withColumn("null", F.lit("reference")).withColumn("rep", F.lit(0))
    kinds = random_kinds(scales)
    each = F.array(*[F.struct(F.lit(n).alias("null"), F.lit(s).alias("scale"), F.lit(b).alias("bias"),
                              F.lit(r).alias("rep")) for n, s, b in kinds for r in range(reps)])
    rand = base.withColumn("_k", F.explode(each)).select("bag_id", "pos", "n_slices", "target", "_k.*")
    rand = nl.random_slots(rand, len(slots), F.col("scale"), F.concat(F.lit(f"{seed}r"), F.col("rep").cast("string")),
                           [F.col("bias") * F.lit(float(b)) for b in bias[:len(slots)]])
    for i, s in enumerate(slots):
        rand = rand.withColumnRenamed(f"r{i}", s)
    rolled = nl.replace_target(base, nl.roll_targets(rows, n_patch, seed, reps)).withColumn("null", F.lit("roll"))
    donors = pin(nl.donor_map(bags, seed, reps)) if donors is None else donors
    source = base if given is None else given.select(*keep)
    shuffled = nl.replace_target(base, nl.shuffle_targets(source, donors, n_patch)).withColumn("null", F.lit("shuffle"))
    cols = ["null", "rep", *keep]
    out = real.select(*cols)
    for part in (rand, rolled, shuffled):
        out = out.unionByName(part.select(*cols))
    return out.withColumn("part", draws.half(F.col("bag_id")))


def null_measures(rows: DataFrame, bags: DataFrame, slots: Sequence[str], n_patch: int, reps: int, seed: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(null, rep, part, bag_id, slot, value, auc): ``null_rows`` measured per bag.

    The task that holds a bag draws and ranks all its nulls; targets of other bags come as one list a request. Bags above ``hot_rows``, bags with
    targets other than 0 and 1, and those that get their targets from one, are measured row by row.
    """
    donors = pin(nl.donor_map(bags, seed, reps))
    plain = F.coalesce((F.col("n_slices") <= max(hot_rows // n_patch, 0)) & F.col("target").isin(0, 1), F.lit(False))
    other = rows.groupBy("bag_id").agg(F.bool_and(plain).alias("_plain")).where("NOT _plain").select("bag_id")
    asked = donors.join(other.select(F.col("bag_id").alias("donor_id")), "donor_id", "left_semi").select("bag_id")
    apart = pin(other.unionByName(asked).distinct())
    some = not apart.isEmpty()
    small = rows.join(apart, "bag_id", "left_anti") if some else rows
    mine = donors.join(apart, "bag_id", "left_anti") if some else donors
    lists = nl.roll_lists(small, n_patch, seed, reps).withColumn("null", F.lit("roll"))
    lists = lists.unionByName(nl.shuffle_lists(rows, mine, n_patch, hot_rows)[0].withColumn("null", F.lit("shuffle")))
    every = mine.select("bag_id", "rep", F.explode(F.array(F.lit("roll"), F.lit("shuffle"))).alias("null"))
    lists = every.join(lists, ["bag_id", "rep", "null"], "left").withColumn("positives", F.coalesce("positives", F.array().cast("array<int>")))
    out = bw.battery(small, slots, random_kinds(SCALES), reps, seed, BIAS).unionByName(bw.measures_of_lists(small, slots, lists))
    out = out.select("null", "rep", "bag_id", "slot", "value", "auc")
    if some:
        own, asking = (df.join(apart, "bag_id", "left_semi") for df in (rows, donors))
        rest = null_rows(own, bags, slots, n_patch, reps, seed, donors=asking, given=rows)
        out = out.unionByName(nl.measured(rest, slots, ["null", "rep"], n_patch).select(*out.columns))
    return out.withColumn("part", draws.half(F.col("bag_id")))


def null_battery(rows: DataFrame, bags: DataFrame, slots: Sequence[str], n_patch: int, reps: int,
                 seed: int = 0) -> DataFrame:
    """Mean, population deviation and extremes over replicates of the evaluation under each null."""
    per = pin(null_measures(rows, bags, slots, n_patch, reps, seed))
    out = nl.evaluated(per, ["null", "rep"])
    chosen = nl.best_of(per.where(F.col("null") == "random_1"), ["null", "rep"])
    out = out.unionByName(chosen.withColumn("null", F.lit("selection_bias")))
    return out.groupBy("null").agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"),
                                   F.min("auc").alias("lo"), F.max("auc").alias("hi"),
                                   F.count(F.lit(1)).alias("n_reps"))


def moved_positives(rows: DataFrame, bags: DataFrame, n_patch: int, seed: int = 0, reps: int = 1) -> DataFrame:
    """(condition, rep, bag_id, pos) of the positives: as they are, rolled, and of another bag."""
    targets = rows.select("bag_id", "pos", *[c for c in ("n_slices", "n_rows") if c in rows.columns], "target")
    real = targets.where(F.col("target") > 0).select("bag_id", "pos").withColumns({"condition": F.lit("real"), "rep": F.lit(0)})
    rolled = nl.roll_positives(targets, n_patch, seed, reps).withColumn("condition", F.lit("roll"))
    swapped = nl.shuffle_positives(targets, pin(nl.donor_map(bags, seed, reps)), n_patch).withColumn("condition", F.lit("shuffle"))
    return real.unionByName(rolled).unionByName(swapped)


def crosstab_scorers(rows: DataFrame, slot: str, grid: int, template: DataFrame) -> DataFrame:
    """The slot, the centre prior, the global template, the bag's own map and the residual."""
    static = tp.bag_static(rows, slot)
    tiled = tp.tile(static, template)
    from ..functions import geometry as geo
    centre = geo.centre_prior(F.col("slice"), F.col("n_slices"), F.col("patch"), grid).cast("double")
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), c.cast("double").alias("score")) for n, c in (
        ("slot", F.col(slot)), ("centre_prior", centre), ("global_template", F.col("template")),
        ("bag_static", F.col("static")), ("residual", F.col("residual")))])
    return tiled.withColumn("_e", F.explode(each)).select("bag_id", "pos", "slice", "n_slices", "target", "_e.*")


def crosstab(rows: DataFrame, bags: DataFrame, slot: str, template: DataFrame, n_patch: int, grid: int,
             seed: int = 0) -> DataFrame:
    """Five scorers by three targets, with the differences real - shuffle and shuffle - roll.

    Each scorer is ranked once; the targets differ in their positives only.
    """
    scored = crosstab_scorers(rows, slot, grid, template)
    positives = moved_positives(rows, bags, n_patch, seed).drop("rep")
    ranks = rk.midranks(scored.withColumn("n_rows", F.col("n_slices") * F.lit(n_patch)), ["scorer", "bag_id"], size="n_rows")
    per = rk.auc_of_positives(ranks, positives, ["scorer", "condition", "bag_id"])
    table = per.groupBy("scorer").pivot("condition", ["real", "shuffle", "roll"]).agg(F.avg("auc"))
    return (table.withColumn("real_minus_shuffle", F.col("real") - F.col("shuffle"))
            .withColumn("shuffle_minus_roll", F.col("shuffle") - F.col("roll")))


def axes_under_nulls(rows: DataFrame, bags: DataFrame, slot: str, n_patch: int, seed: int = 0, reps: int = 1) -> DataFrame:
    """Mean of each axis under each condition over the axis's own defined bags and replicates. The scores are ranked once."""
    moved = moved_positives(rows, bags, n_patch, seed, reps)
    per = rk.axes_of_positives(rows, moved, n_patch, slot, labels=["condition", "rep"])
    return per.groupBy("condition").agg(
        *[f(c).alias(f"{n}{c}") for c in ("flat", "slice", "within_slice") for n, f in (("", F.avg), ("n_", F.count))])
