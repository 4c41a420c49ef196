"""Patient-grouped splits and their checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from .scale import attach, hashed_positions


def patient_strata(series: DataFrame) -> DataFrame:
    """(patient_id, stratum, n_series): the most frequent label, the smallest on ties."""
    counts = series.groupBy("patient_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("patient_id").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("stratum"), F.sum("n").alias("n_series"))


def stratified_split(series: DataFrame, fracs: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """(patient_id, stratum, split): whole patients, shuffled inside each stratum, cut at rounded shares.

    A stratum may hold most patients, so they are numbered by bucketed positions.
    """
    patients = patient_strata(series).withColumn("_h", draws.order_key(seed, F.col("patient_id")))
    placed = hashed_positions(patients, ["stratum"], "_h", ["patient_id"], name="_ix", total="_n")
    first = F.bround(F.lit(float(fracs[0])) * F.col("_n"))
    second = first + F.bround(F.lit(float(fracs[1])) * F.col("_n"))
    split = F.when(F.col("_ix") < first, "train").when(F.col("_ix") < second, "val").otherwise("test")
    return placed.select("patient_id", "stratum", "n_series", split.alias("split"))


def assign(series: DataFrame, split: DataFrame) -> DataFrame:
    """Splits of the series through their patient; a prolific patient is spread."""
    return attach(series, split.select("patient_id", "split"), ["patient_id"], "bag_id")


def masked_to_eval(assigned: DataFrame, seed: int = 0, limit: float = 0.5) -> DataFrame:
    """Move patients with a masked series out of train, half to val and half to test, kept whole.

    Refused when more than ``limit`` of the training series would move.
    """
    masked = assigned.where("has_mask").select("patient_id").distinct().withColumn("_m", F.lit(True))
    flagged = attach(assigned, masked, ["patient_id"], "bag_id", how="left")
    moving = (F.col("split") == "train") & F.coalesce(F.col("_m"), F.lit(False))
    share = flagged.agg((F.sum(moving.cast("double")) / F.greatest(F.sum((F.col("split") == "train").cast("double")),
                                                                   F.lit(1.0))).alias("s")).scalar()
    movers = flagged.where(moving).select("patient_id").distinct().withColumn("_h", draws.order_key(seed, F.col("patient_id")))
    ranked = hashed_positions(movers, [], "_h", ["patient_id"], name="_ix", total="_n")
    target = ranked.select("patient_id", F.when(F.col("_ix") < F.floor(F.col("_n") / 2), "val").otherwise("test").alias("_to"))
    out = attach(flagged.withColumn("_share", share), target, ["patient_id"], "bag_id", how="left")
    bad = F.raise_error(F.lit("moving masked patients would empty the training split"))
    new = (F.when(F.col("_share") > limit, bad.cast("string")).when(moving, F.col("_to")).otherwise(F.col("split")))
    return out.withColumn("split", new).drop("_m", "_share", "_to")


def leaks(assigned: DataFrame) -> DataFrame:
    """Patients present in more than one split; must be empty."""
    return assigned.groupBy("patient_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def class_counts(assigned: DataFrame, labels: Sequence) -> DataFrame:
    """One row per split, one column per label, and whether a class is empty."""
    out = assigned.groupBy("split").pivot("label", list(labels)).agg(F.count(F.lit(1))).fillna(0)
    empty = F.lit(False)
    for label in labels:
        empty = empty | (F.col(str(label)) == 0)
    return out.withColumn("empty_class", empty)
