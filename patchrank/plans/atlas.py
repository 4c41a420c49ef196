"""Confound atlas: what position alone achieves, with intervals over patients."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import estimands as es
from ..operators import ranking as rk
from ..operators import templates as tp

AXES = ("flat", "slice", "within_slice")


def content_free_scores(fit: DataFrame, rest: DataFrame, n_patch: int, grid: int,
                        n_bins: int) -> DataFrame:
    """Fit the mask family on ``fit``; score ``rest`` with it and with the centre prior. A row of the score half is refused."""
    cells = tp.fit_cells(fit, F.col("target"), n_bins, refuse_split="score", split_column="_half")
    family = tp.fill(cells, n_bins, n_patch)
    scored = tp.apply_family(rest, family, n_bins)
    return scored.unionByName(tp.centre_prior_rows(rest, grid))


def atlas_axes(rows: DataFrame, n_patch: int, grid: int, n_bins: int) -> DataFrame:
    part = rows.withColumn("_half", draws.half(F.col("bag_id")))
    keep = ["bag_id", "pos", "slice", "patch", "n_slices", "target", "slice_pos"]
    fit = part.where(F.col("_half") == "fit").select(*keep, "_half")
    rest = part.where(F.col("_half") == "score").select(*keep)
    scored = content_free_scores(fit, rest, n_patch, grid, n_bins)
    return rk.axes(scored, n_patch, ["scorer", "bag_id"])


def atlas_cases(rows: DataFrame, n_patch: int) -> DataFrame:
    """(bag_id, half, n, state) per case: kept, no_lesion, no_background or ragged.

    A position that occurs twice, or whose slice and patch do not follow from it, is an error, and so is a gap between positions.
    """
    pos = F.col("pos")
    broken = (F.col("slice") != F.floor(pos / n_patch)) | (F.col("patch") != pos % n_patch)
    each = rows.groupBy("bag_id", "pos").agg(F.count(F.lit(1)).alias("times"), F.max((F.col("target") > 0).cast("int")).alias("y"), F.bool_or(broken).alias("broken"))
    per = each.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"), F.min("pos").alias("first"), F.max("pos").alias("last"),
                                     F.bool_or("broken").alias("broken"), F.max("y").alias("any"), F.min("y").alias("every"))
    name = F.col("bag_id").cast("string")
    state = (F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("duplicate position in case "), name)).cast("string"))
             .when(F.coalesce("broken", F.lit(True)) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1),
                   F.raise_error(F.concat(F.lit("broken layout in case "), name)).cast("string"))
             .when(F.col("n") % n_patch != 0, "ragged").when(F.coalesce("any", F.lit(0)) == 0, "no_lesion").when(F.col("every") == 1, "no_background")
             .otherwise("kept"))
    return per.select("bag_id", draws.half(F.col("bag_id")).alias("half"), "n", state.alias("state"))


def atlas_coverage(rows: DataFrame, n_patch: int) -> DataFrame:
    """(half, n_cases, n_kept, n_no_lesion, n_no_background, n_ragged); a half without a usable case is an error."""
    out = atlas_cases(rows, n_patch).groupBy("half").agg(F.count(F.lit(1)).alias("n_cases"), *[
        F.sum((F.col("state") == s).cast("bigint")).alias(f"n_{s}") for s in ("kept", "no_lesion", "no_background", "ragged")])
    bad = F.raise_error(F.concat(F.lit("no usable case in half "), F.col("half"))).cast("bigint")
    return out.withColumn("n_kept", F.when(F.col("n_kept") > 0, F.col("n_kept")).otherwise(bad))


def confound_atlas(rows: DataFrame, bags: DataFrame, n_patch: int, grid: int, n_bins: int,
                   reps: int = 10000, seed: int = 0) -> DataFrame:
    """One row per (scorer, axis): interval over patients of the score half."""
    per_bag = atlas_axes(rows, n_patch, grid, n_bins).join(bags, "bag_id")
    return intervals(per_bag, ["scorer"], reps, seed)


def intervals(per_bag: DataFrame, keys, reps: int, seed: int = 0) -> DataFrame:
    long = es.melt(per_bag, [*keys, "patient_id"], AXES, "axis", "value")
    return es.cluster_bootstrap(long, [*keys, "axis"], "value", "patient_id", reps, seed)
