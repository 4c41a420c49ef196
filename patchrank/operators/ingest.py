"""Table jobs on voxels: windows, patch coverage, region containment, reader consensus."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_level(value: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] and scale to [0, 1]."""
    return (F.greatest(F.least(value, F.lit(hi)), F.lit(lo)) - F.lit(lo)) / F.lit(hi - lo)


def bin_table(spark, size: int, bins: int) -> DataFrame:
    """(at, bin): adaptive bins floor(i*size/bins) .. ceil((i+1)*size/bins); they may overlap."""
    spans = [(math.floor(i * size / bins), math.ceil((i + 1) * size / bins)) for i in range(bins)]
    each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                     for i, (a, b) in enumerate(spans)])
    rows = spark.range(size).select(F.col("id").alias("at"), F.explode(each).alias("s"))
    return rows.where((F.col("at") >= F.col("s.a")) & (F.col("at") < F.col("s.b"))).select("at", "s.bin")


def patch_coverage(voxels: DataFrame, mask: str, height: int, width: int, grid: int,
                   mode: str = "mean") -> DataFrame:
    """(bag_id, slice, patch, coverage) from a pixel mask; the bin tables have a few rows per pixel row."""
    spark = voxels.sparkSession
    rows = bin_table(spark, height, grid).select(F.col("at").alias("y"), F.col("bin").alias("by"))
    cols = bin_table(spark, width, grid).select(F.col("at").alias("x"), F.col("bin").alias("bx"))
    binned = voxels.join(F.broadcast(rows), "y").join(F.broadcast(cols), "x")
    m = F.col(mask).cast("double")
    value = F.avg(m) if mode == "mean" else F.max((m > 0).cast("double"))
    return binned.groupBy("bag_id", "slice", (F.col("by") * grid + F.col("bx")).alias("patch")).agg(value.alias("coverage"))


def organ_slices(voxels: DataFrame, inside: Column, min_frac: float, margin: int) -> DataFrame:
    """First and last slice whose region share exceeds ``min_frac``, widened; all slices if none."""
    area = voxels.groupBy("bag_id", "slice").agg(F.avg(inside.cast("double")).alias("area"))
    hit = F.when(F.col("area") > min_frac, F.col("slice"))
    per = area.groupBy("bag_id").agg(F.min(hit).alias("a"), F.max(hit).alias("b"), F.max("slice").alias("top"))
    return per.select("bag_id", F.greatest(F.coalesce(F.col("a") - margin, F.lit(0)), F.lit(0)).alias("first_slice"),
                      F.least(F.coalesce(F.col("b") + margin, F.col("top")), F.col("top")).alias("last_slice"),
                      F.col("a").isNotNull().alias("found"))


def split_finding(mask: Column, hu: Column, threshold: float) -> Column:
    """0 outside, 1 below the threshold, 2 at or above it."""
    return F.when(mask <= 0, 0).when(hu >= threshold, 2).otherwise(1)


def lesion_class(voxels: DataFrame, label: str, dataset: str) -> DataFrame:
    """Lesion mask under a dataset's own label convention."""
    # fixed values: which voxel label counts as a lesion, by collection
    rules = {"covid_ct_seg": F.col(label) > 0, "kits19": F.col(label) == 2,
             "msd_task06": F.col(label) > 0, "lits": F.col(label) == 2}
    if dataset not in rules:
        raise KeyError(f"unknown dataset {dataset}")
    return voxels.withColumn("mask", rules[dataset].cast("int")).withColumn("dataset", F.lit(dataset))


# fixed values: how much of a patch must lie inside the region
REGION_CUTS = (0.0, 0.05, 0.1, 0.25, 0.5)


def containment(df: DataFrame, cuts: Sequence[float] = REGION_CUTS, keys: Sequence[str] = ("bag_id",)) -> DataFrame:
    """Share of positives inside the region and the region's share, per bag and cut.

    All cuts are counted in one pass; a bag without positives has no containment.
    """
    hit = F.col("target") > 0
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("bigint")).alias("n_lesion"),
        *[F.sum((F.col("frac") > c).cast("bigint")).alias(f"r{i}") for i, c in enumerate(cuts)],
        *[F.sum((hit & (F.col("frac") > c)).cast("bigint")).alias(f"c{i}") for i, c in enumerate(cuts)])
    each = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"r{i}").alias("r"), F.col(f"c{i}").alias("c"))
                     for i, c in enumerate(cuts)])
    return wide.withColumn("_e", F.explode(each)).select(
        *keys, "_e.cut", "n_lesion", (F.col("_e.r") / F.col("n")).alias("region_frac"),
        F.when(F.col("n_lesion") > 0, F.col("_e.c") / F.col("n_lesion")).alias("contained"))


def containment_summary(per: DataFrame, keys: Sequence[str], minimum: float) -> DataFrame:
    """Weighted by positives, with the worst bag and whether the minimum is met."""
    rows = per.where(F.col("contained").isNotNull())
    out = rows.groupBy(*keys).agg(
        (F.sum(F.col("contained") * F.col("n_lesion")) / F.sum("n_lesion")).alias("aggregate"),
        F.avg("contained").alias("mean"), F.min("contained").alias("worst"),
        F.avg((F.col("contained") >= 0.999).cast("double")).alias("frac_full"),
        F.avg((F.col("contained") >= minimum).cast("double")).alias("frac_above_min"),
        F.avg("region_frac").alias("mean_region_frac"), F.count(F.lit(1)).alias("n_bags"))
    return out.withColumn("usable", F.col("aggregate") >= minimum)


def consensus(marks: DataFrame, readers: DataFrame, level: float = 0.5) -> DataFrame:
    """Voxels of each bag that at least ``level`` of its readers mark for some finding.

    ``readers`` has the number of readers per (bag, finding).
    """
    n = marks.groupBy("bag_id", "finding", "voxel").agg(F.count_distinct("reader").alias("n"))
    agreed = n.join(readers, ["bag_id", "finding"]).where(F.col("n") / F.col("n_readers") >= level)
    return agreed.select("bag_id", "voxel").distinct()
