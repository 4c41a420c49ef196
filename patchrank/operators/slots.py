"""Statistics of several score columns (slots) per instance."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from . import ranking as rk
from .scale import salted_join

THRESHOLDS = (0.3, 0.5, 0.7)


def long_slots(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """One row per (instance, slot)."""
    kept = [c for c in df.columns if c not in slots]
    pairs = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).cast("double").alias("score"))
                      for i, s in enumerate(slots)])
    return df.withColumn("_p", F.explode(pairs)).select(*kept, "_p.slot", "_p.score")


def slot_auc(df: DataFrame, slots: Sequence[str], keys: Sequence[str] = ("bag_id",),
             with_max: bool = False, size: str | None = None) -> DataFrame:
    """AUC per (bag, slot). Slot -1 is the maximum over slots: a confidence, not a saliency."""
    names, rows = list(slots), df
    if with_max:
        rows = df.withColumn("_any", F.greatest(*slots) if len(names) > 1 else F.col(names[0]))
        out = long_slots(rows, [*names, "_any"])
        out = out.withColumn("slot", F.when(F.col("slot") == len(names), -1).otherwise(F.col("slot")))
    else:
        out = long_slots(rows, names)
    return rk.auc(out, [*keys, "slot"], size=size)


def slot_report(df: DataFrame, slots: Sequence[str], frozen: int,
                size: str | None = None) -> DataFrame:
    """Frozen-slot, max-over-slots and oracle-slot AUC with average precision and lift."""
    per = slot_auc(df, slots, with_max=True, size=size).where(F.col("auc").isNotNull())
    bag = per.groupBy("bag_id").agg(
        F.max(F.when(F.col("slot") == frozen, F.col("auc"))).alias("frozen"),
        F.max(F.when(F.col("slot") == -1, F.col("auc"))).alias("over"),
        F.max(F.when(F.col("slot") >= 0, F.col("auc"))).alias("oracle"))
    ap = rk.average_precision(df, ["bag_id"], slots[frozen], size=size).select(
        "bag_id", "avg_precision", "prevalence")
    return bag.join(ap, "bag_id").agg(
        F.avg("frozen").alias("auc_frozen_slot"),
        (F.stddev_pop("frozen") / F.sqrt(F.count(F.lit(1)))).alias("auc_sem"),
        F.avg("over").alias("auc_max_over_slots"), F.avg("oracle").alias("auc_oracle_slot"),
        F.avg("avg_precision").alias("avg_precision"), F.avg("prevalence").alias("prevalence"),
        (F.avg("avg_precision") / F.greatest(F.avg("prevalence"), F.lit(1e-12))).alias("ap_lift"),
        F.count(F.lit(1)).alias("n_bags"))


def normalised(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Min-max normalise each slot inside its bag (0 where flat): columns ``h_<slot>``."""
    ext = df.groupBy("bag_id", "n_slices").agg(*[f(s).alias(f"_{n}_{s}") for s in slots
                                     for n, f in (("lo", F.min), ("hi", F.max))])
    out = salted_join(df, ext, ["bag_id"], F.col("pos"), size="n_slices")
    for s in slots:
        lo, hi = F.col(f"_lo_{s}"), F.col(f"_hi_{s}")
        out = out.withColumn(f"h_{s}", F.when(hi > lo, (F.col(s) - lo) / (hi - lo)).otherwise(0.0))
    return out.drop(*[f"_{n}_{s}" for s in slots for n in ("lo", "hi")])


def dice_iou(df: DataFrame, slots: Sequence[str],
             thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """Dice and IoU per (bag, slot, threshold), counted in one pass over the rows."""
    rows, t = normalised(df, slots), F.col("target") > 0
    combos = [(i, th) for i in range(len(slots)) for th in thresholds]
    sums = []
    for n, (i, th) in enumerate(combos):
        p = F.col(f"h_{slots[i]}") > th
        sums += [F.sum((p & t).cast("bigint")).alias(f"i{n}"), F.sum((p | t).cast("bigint")).alias(f"u{n}")]
    wide = rows.groupBy("bag_id").agg(F.sum(t.cast("bigint")).alias("n_pos"), *sums)
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(th)).alias("threshold"),
                              F.col(f"i{n}").alias("inter"), F.col(f"u{n}").alias("either"))
                     for n, (i, th) in enumerate(combos)])
    out = wide.withColumn("_e", F.explode(each)).select("bag_id", "n_pos", "_e.*")
    total = F.col("inter") + F.col("either")  # |p| + |t| = |p and t| + |p or t|
    return out.select("bag_id", "slot", "threshold", "n_pos",
                      F.when(total > 0, 2 * F.col("inter") / total).otherwise(0.0).alias("dice"),
                      F.when(F.col("either") > 0, F.col("inter") / F.col("either")).otherwise(0.0)
                      .alias("iou"))


def best_dice(df: DataFrame, slots: Sequence[str],
              thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Best (slot, threshold) per bag by Dice, first one on ties; slot -1 if all are zero."""
    each = dice_iou(df, slots, thresholds)
    rank = F.struct(F.col("dice"), -F.col("slot"), -F.col("threshold"))
    best = each.groupBy("bag_id", "n_pos").agg(
        F.max_by(F.struct("slot", "threshold", "dice", "iou"), rank).alias("b"))
    hit = F.col("b.dice") > 0
    return best.select("bag_id", "n_pos", F.when(hit, F.col("b.slot")).otherwise(-1).alias("slot"),
                       F.when(hit, F.col("b.threshold")).alias("threshold"),
                       F.col("b.dice").alias("dice"),
                       F.when(hit, F.col("b.iou")).otherwise(0.0).alias("iou"))


def pointing(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Is the highest instance (first on ties) a positive, per (bag, slot)."""
    t = (F.col("target") > 0).cast("int")
    wide = df.groupBy("bag_id").agg(*[F.max_by(t, F.struct(F.col(s), -F.col("pos"))).alias(s)
                                      for s in slots])
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("hit"))
                     for i, s in enumerate(slots)])
    return wide.withColumn("_e", F.explode(each)).select("bag_id", "_e.slot", "_e.hit")


def localisation_summary(df: DataFrame, slots: Sequence[str], frozen: int,
                         size: str | None = None) -> DataFrame:
    """Split-level summary over bags with a positive."""
    best = best_dice(df, slots).where(F.col("n_pos") > 0)
    hits = pointing(df, slots)
    last = len(slots) - 1  # slot -1 addresses the last map
    best = best.withColumn("_s", F.when(F.col("slot") < 0, last).otherwise(F.col("slot")))
    best = best.join(hits.withColumnRenamed("slot", "_s"), ["bag_id", "_s"])
    a = rk.auc(df, ["bag_id"], slots[frozen], size=size).select("bag_id", "auc")
    ap = rk.average_precision(df, ["bag_id"], slots[frozen], size=size).select(
        "bag_id", "avg_precision", "prevalence")
    both = best.join(a, "bag_id", "left").join(ap, "bag_id", "left")
    defined = F.col("auc").isNotNull()
    ap_mean = F.avg(F.when(defined, F.col("avg_precision")))
    prev_mean = F.avg(F.when(defined, F.col("prevalence")))
    return both.agg(
        F.avg("dice").alias("dice"), F.stddev_pop("dice").alias("dice_std"),
        F.avg("iou").alias("iou"), F.avg("hit").alias("pointing_game"),
        F.avg("auc").alias("instance_auc"), F.stddev_pop("auc").alias("instance_auc_std"),
        ap_mean.alias("avg_precision"), prev_mean.alias("prevalence"),
        (ap_mean / F.greatest(prev_mean, F.lit(1e-12))).alias("ap_lift"),
        F.count(F.lit(1)).alias("n_bags"))


def radial_table(spark, n_patch: int, grid: int, n_bins: int, closed: str = "left") -> DataFrame:
    """(patch, radius, rbin): equal-count radial bins of the patch grid, ``n_patch`` rows.

    ``closed='left'`` puts a radius on an edge into the upper bin, ``'right'`` into the lower.
    """
    cells = spark.range(n_patch).select(F.col("id").alias("patch"),
                                        geo.pixel_radius(F.col("id"), grid).alias("radius"))
    cuts = [float(i) / n_bins for i in range(1, n_bins)]
    edges = cells.agg(F.percentile("radius", F.array(*[F.lit(c) for c in cuts])).alias("edges"))
    cells = cells.withColumn("edges", edges.scalar())
    below = ((lambda e: e <= F.col("radius")) if closed == "left" else (lambda e: e < F.col("radius")))
    return cells.select(
        "patch", "radius", F.size(F.filter("edges", below)).cast("bigint").alias("rbin"))


def with_radial_bin(df: DataFrame, n_patch: int, grid: int, n_bins: int,
                    closed: str = "left") -> DataFrame:
    bins = radial_table(df.sparkSession, n_patch, grid, n_bins, closed).select("patch", "rbin")
    return df.join(F.broadcast(bins), "patch")


def radial_profile(df: DataFrame, slots: Sequence[str], n_patch: int, grid: int,
                   n_bins: int) -> DataFrame:
    """Mean score and positive density per (slot, radial bin), means taken per bag first."""
    rows = with_radial_bin(df, n_patch, grid, n_bins)
    per = rows.groupBy("bag_id", "rbin").agg(
        *[F.avg(s).alias(s) for s in slots], F.avg((F.col("target") > 0).cast("double")).alias("density"))
    out = long_slots(per, slots)
    return out.groupBy("slot", "rbin").agg(F.avg("score").alias("mean_score"),
                                           F.avg("density").alias("density"),
                                           F.count(F.lit(1)).alias("n_bags"))


def concentration(df: DataFrame, slots: Sequence[str], normalise: bool = True,
                  floor: float = 1e-12) -> DataFrame:
    """Entropy of each slot over its bag's instances, optionally divided by log N."""
    sums = df.groupBy("bag_id", "n_slices").agg(F.count(F.lit(1)).alias("_n"),
                                    *[F.sum(s).alias(f"_m_{s}") for s in slots])
    rows = salted_join(df, sums, ["bag_id"], F.col("pos"), size="n_slices")
    terms = []
    for s in slots:
        p = F.col(s) / F.greatest(F.col(f"_m_{s}"), F.lit(floor))
        held = F.greatest(p, F.lit(floor))
        terms.append(F.sum((p if normalise else held) * F.log(held)).alias(s))
    per = rows.groupBy("bag_id", "_n").agg(*terms)
    out = long_slots(per, slots)
    base = F.when(F.col("_n") > 1, F.log(F.col("_n").cast("double"))) if normalise else F.lit(1.0)
    return out.select("bag_id", "slot", (-F.col("score") / base).alias("entropy"))
