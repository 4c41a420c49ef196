"""Slot selection rules, per-bag systematicity and faithfulness curves."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import alignment as al
from . import slots as sl
from .pooling import matrix_udf
from .scale import attach, positions, route


def selection_rules(df: DataFrame, slots: Sequence[str], size: str) -> DataFrame:
    """Score-half AUC under four rules fitted on ``part='fit'``.

    affinity arg-max; fit-AUC arg-max; sign-calibrated (the slot farthest from 0.5, flipped if it
    lies below); per-bag oracle.
    """
    aff = al.lesion_slot(al.affinity(df.where("part = 'fit'"), slots))
    per = sl.slot_auc(df, slots, ["part", "bag_id"], size=size).where(F.col("auc").isNotNull())
    means = per.groupBy("part", "slot").agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_bags"))
    fit, test = means.where("part = 'fit'"), means.where("part <> 'fit'")
    rank = F.struct(F.col("auc"), -F.col("slot"))
    by_auc = fit.agg(F.max_by("slot", rank).alias("slot"))
    far = F.abs(F.col("auc") - 0.5)
    signed = fit.agg(F.max_by(F.struct("slot", (F.col("auc") < 0.5).alias("flip")),
                              F.struct(far, -F.col("slot"))).alias("b")).select("b.*")
    keep = F.lit(False)
    picks = (aff.select("slot", keep.alias("flip"), F.lit("affinity").alias("rule"))
             .unionByName(by_auc.select("slot", keep.alias("flip"), F.lit("fit_auc").alias("rule")))
             .unionByName(signed.withColumn("rule", F.lit("sign_calibrated"))))
    ruled = picks.join(test, "slot").select(
        "rule", F.when(F.col("flip"), 1 - F.col("auc")).otherwise(F.col("auc")).alias("auc"), "n_bags")
    oracle = per.where("part <> 'fit'").groupBy("bag_id").agg(F.max("auc").alias("auc"))
    return ruled.unionByName(oracle.agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n_bags"))
                             .withColumn("rule", F.lit("oracle")).select("rule", "auc", "n_bags"))


def systematicity(df: DataFrame, slots: Sequence[str], size: str) -> DataFrame:
    """Per slot: mean AUC and the share of bags below one half."""
    per = sl.slot_auc(df, slots, size=size).where(F.col("auc").isNotNull())
    return per.groupBy("slot").agg(F.avg("auc").alias("mean_auc"),
                                   F.avg((F.col("auc") < 0.5).cast("double")).alias("share_below"),
                                   F.count(F.lit(1)).alias("n_bags"))


def faithfulness_curves(df: DataFrame, score: str, value: str, steps: int = 20,
                        size: str | None = None) -> DataFrame:
    """(bag_id, kind, step, fraction, bag_score) for an additive bag score: the mean of ``value``.

    Deletion removes the instances in descending ``score`` (first position on ties), ``n DIV
    steps`` per step, always leaving one; insertion adds them, starting from the first. Ranks come
    from bucketed positions; the cumulative window runs over ``steps + 1`` rows per bag.
    """
    ranked = positions(df.withColumn("_b", -route(F.col(score), F.col(size) if size else None))
                       .withColumn("_neg", -F.col(score)), ["bag_id"], ["_b"], ["_neg", "pos"],
                       name="_rank", total="_n")
    per_step = F.greatest(F.lit(1), F.floor(F.col("_n") / steps))
    step = F.least(F.floor(F.col("_rank") / per_step), F.lit(steps)).cast("int")
    groups = ranked.groupBy("bag_id", "_n", step.alias("g")).agg(
        F.sum(value).alias("v"), F.count(F.lit(1)).alias("c"),
        F.max(F.when(F.col("_rank") == 0, F.col(value))).alias("first"),
        F.max(F.when(F.col("_rank") == F.col("_n") - 1, F.col(value))).alias("last"))
    per = groups.groupBy("bag_id", "_n").agg(
        F.sum("v").alias("total"), F.max("first").alias("first"), F.max("last").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("g", F.struct("v", "c")))).alias("m"))
    grid = per.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    part = F.try_element_at("m", F.col("step") - 1)
    w = W.partitionBy("bag_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    grid = (grid.withColumn("_v", F.sum(F.coalesce(part["v"], F.lit(0.0))).over(w))
            .withColumn("_c", F.sum(F.coalesce(part["c"], F.lit(0))).over(w)))
    left = F.col("_n") - F.col("_c")
    deletion = F.when(left > 0, (F.col("total") - F.col("_v")) / F.greatest(left, F.lit(1))).otherwise(F.col("last"))
    insertion = F.when(F.col("_c") > 0, F.col("_v") / F.greatest(F.col("_c"), F.lit(1))).otherwise(F.col("first"))
    kinds = F.array(F.struct(F.lit("deletion").alias("kind"), deletion.alias("bag_score")),
                    F.struct(F.lit("insertion").alias("kind"), insertion.alias("bag_score")))
    return grid.withColumn("_k", F.explode(kinds)).select(
        "bag_id", "_k.kind", "step", (F.col("step") / F.lit(steps)).alias("fraction"), "_k.bag_score")


def pooled_faithfulness(df: DataFrame, score: str, vector: str, classes: np.ndarray, target_class: int, steps: int = 20,
                        logit: str | None = None, size: str | None = None) -> DataFrame:
    """(bag_id, kind, step, fraction, bag_score) where the bag score is the model's probability of ``target_class`` for the instances present.

    The model pools vectors by softmax attention over ``logit`` (uniformly without one) and applies ``classes`` (classes x dimensions) and a
    softmax. As the classifier is linear, sums of projected vectors are enough: each removal step has its largest logit, its attention mass and its projected sums relative to
    that, and a shorter bag is pooled by rescaling and adding the steps that are left, ``steps + 1`` rows of a bag at most. Order, steps and the instance that always stays are those of
    ``faithfulness_curves``. Instances without a score, a logit or a vector are left out.
    """
    rows = df.where(F.size(vector) > 0).withColumns({"_y": matrix_udf(np.asarray(classes, np.float64))(F.col(vector)), "_l": F.col(logit).cast("double") if logit else F.lit(0.0)})
    rows = rows.where(F.col(score).isNotNull() & F.col("_l").isNotNull()).withColumns({
        "_b": -route(F.col(score), F.col(size) if size else None), "_neg": -F.col(score)})
    ranked = positions(rows, ["bag_id"], ["_b"], ["_neg", "pos"], name="_rank", total="_n")
    per_step = F.greatest(F.lit(1), F.floor(F.col("_n") / steps))
    ranked = ranked.select("bag_id", "_n", "_rank", "_l", "_y", F.least(F.floor(F.col("_rank") / per_step), F.lit(steps)).cast("int").alias("g"))
    tops = ranked.groupBy("bag_id", "g").agg(F.max("_l").alias("_t"))
    placed = attach(ranked, tops, ["bag_id", "g"], "_rank").withColumn("_e", F.exp(F.col("_l") - F.col("_t")))
    many = range(len(classes))
    parts = placed.groupBy("bag_id", "_n", "g").agg(
        F.max("_t").alias("t"), F.sum("_e").alias("z"), F.array(*[F.sum(F.col("_e") * F.get("_y", F.lit(c))) for c in many]).alias("y"),
        F.max(F.when(F.col("_rank") == 0, F.col("_y"))).alias("first"), F.max(F.when(F.col("_rank") == F.col("_n") - 1, F.col("_y"))).alias("last"))
    per = parts.groupBy("bag_id", "_n").agg(F.collect_list(F.struct("g", "t", "z", "y")).alias("m"), F.max("first").alias("first"), F.max("last").alias("last"))
    grid = per.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))

    def pooled(present, otherwise):
        top = F.array_max(F.transform(present, lambda x: x["t"]))
        mass = F.aggregate(present, F.lit(0.0), lambda s, x: s + x["z"] * F.exp(x["t"] - top))
        scaled = lambda c: F.aggregate(present, F.lit(0.0), lambda s, x: s + F.get(x["y"], F.lit(c)) * F.exp(x["t"] - top))
        logits = [scaled(c) / mass for c in many]
        return F.when(F.size(present) > 0, F.array(*logits)).otherwise(otherwise)
    kinds = F.array(F.struct(F.lit("deletion").alias("kind"), pooled(F.filter("m", lambda x: x["g"] >= F.col("step")), F.col("last")).alias("o")),
                    F.struct(F.lit("insertion").alias("kind"), pooled(F.filter("m", lambda x: x["g"] < F.col("step")), F.col("first")).alias("o")))
    out = grid.withColumn("_k", F.explode(kinds)).select("bag_id", "step", "_k.*")
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("o")))
    return out.select("bag_id", "kind", "step", (F.col("step") / F.lit(steps)).alias("fraction"),
                      (F.exp(F.get("o", F.lit(target_class)) - F.array_max("o")) / total).alias("bag_score"))


def faithfulness_summary(curves: DataFrame) -> DataFrame:
    """Area under each curve by the trapezoid rule, then means and deviations over bags."""
    last = curves.groupBy("bag_id", "kind").agg(F.max("step").alias("_last"))
    rows = curves.join(last, ["bag_id", "kind"])
    edge = (F.col("step") == 0) | (F.col("step") == F.col("_last"))
    weight = F.when(edge, 0.5).otherwise(1.0) / F.col("_last")
    area = rows.groupBy("bag_id").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("bag_score") * weight)).alias(k) for k in ("deletion", "insertion")])
    return area.agg(
        F.avg("deletion").alias("deletion_auc"), F.stddev_pop("deletion").alias("deletion_auc_std"),
        F.avg("insertion").alias("insertion_auc"), F.stddev_pop("insertion").alias("insertion_auc_std"),
        (F.avg("insertion") - F.avg("deletion")).alias("insertion_minus_deletion"),
        F.count(F.lit(1)).alias("n_bags"))
