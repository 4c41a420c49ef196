"""Position-only reference scorers: fitted on one split, applied to another."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .scale import exact_total, salted_join

MEMBERS = ("inplane", "axial", "separable", "joint")


def whole_slices(df: DataFrame, n_patch: int) -> DataFrame:
    """Cut a ragged tail: keep the rows of complete slices (``n_slices`` counts those)."""
    return df.where(F.col("slice") < F.col("n_slices"))


def fit_cells(df: DataFrame, value: Column, n_bins: int, keys: Sequence[str] = (),
              refuse_split: str | None = None, split_column: str = "split") -> DataFrame:
    """Sum and count per (depth bin, patch): at most ``n_bins * n_patch`` rows per key.

    The whole family derives from these cells, so the instances are read once. Sums are doubles:
    template scores are FLOAT, which absorbs the order of addition. With
    ``refuse_split`` a row of that split, or of none, is an error, and so is a missing ``split_column``: references are never
    fitted on test.
    """
    rows = df
    if refuse_split is not None:
        if split_column not in df.columns:
            raise ValueError(f"no column {split_column} to refuse {refuse_split} by")
        bad = F.raise_error(F.lit(f"template fit saw split {refuse_split}")).cast("boolean")
        rows = df.where(F.when(F.col(split_column) != refuse_split, F.lit(True)).otherwise(bad))
    b = geo.depth_bin(F.col("slice"), F.col("n_slices"), n_bins)
    return (rows.groupBy(*keys, b.alias("bin"), "patch")
            .agg(F.sum(value.cast("double")).alias("total"), F.count(F.lit(1)).alias("cells")))


def fill(cells: DataFrame, n_bins: int, n_patch: int, keys: Sequence[str] = ()) -> DataFrame:
    """Means of all three levels on the full grid; an unobserved cell takes the grand mean.

    One row per (keys, bin, patch): ``inplane``, ``axial``, ``joint`` and ``observed``. The
    windows run over the bounded grid of one key.
    """
    keys = list(keys)
    spark = cells.sparkSession
    grid = spark.range(n_bins * n_patch).select(
        F.floor(F.col("id") / n_patch).alias("bin"), (F.col("id") % n_patch).alias("patch"))
    if keys:
        cells_per_key = cells.select(*keys).distinct()
        grid = cells_per_key.withColumn("_c", F.explode(
            F.sequence(F.lit(0), F.lit(n_bins * n_patch - 1)))).select(
            *keys, F.floor(F.col("_c") / n_patch).alias("bin"), (F.col("_c") % n_patch)
            .cast("bigint").alias("patch"))
    full = grid.join(cells, [*keys, "bin", "patch"], "left")

    def mean_over(*parts):
        w = W.partitionBy(*keys, *parts)
        return (F.sum("total").over(w).cast("double") / F.sum("cells").over(w).cast("double"))

    grand = mean_over()
    return full.select(
        *keys, "bin", "patch",
        F.coalesce(mean_over("patch"), grand).alias("inplane"),
        F.coalesce(mean_over("bin"), grand).alias("axial"),
        F.coalesce(F.col("total").cast("double") / F.col("cells").cast("double"),
                   grand).alias("joint"),
        F.col("cells").isNotNull().alias("observed"))


def apply_family(df: DataFrame, family: DataFrame, n_bins: int, keys: Sequence[str] = (),
                 members: Sequence[str] = MEMBERS) -> DataFrame:
    """Score instances with the fitted family: one row per (instance, scorer).

    The family has ``n_bins * n_patch`` rows by construction, so it is broadcast; with ``keys``
    (arms, seeds) it grows with their number and Spark chooses the join by measured size. A key, or a cell, that was never fitted
    is an error.
    """
    binned = df.withColumn("bin", geo.depth_bin(F.col("slice"), F.col("n_slices"), n_bins))
    small = family.select(*keys, "bin", "patch", "inplane", "axial", "joint")
    joined = binned.join(small if keys else F.broadcast(small), [*keys, "bin", "patch"], "left")
    bad = F.raise_error(F.concat_ws(" ", F.lit("no fitted cell for"), *[F.col(c).cast("string") for c in (*keys, "bin", "patch")])).cast("double")
    joined = joined.withColumn("joint", F.coalesce("joint", bad))
    joined = joined.withColumn("inplane", F.coalesce("inplane", bad)).withColumn("axial", F.coalesce("axial", bad))
    value = {"inplane": F.col("inplane"), "axial": F.col("axial"), "joint": F.col("joint"),
             "separable": F.col("axial") * F.col("inplane")}
    rows = F.array(*[F.struct(F.lit(m).alias("scorer"), value[m].cast("float").alias("score"))
                     for m in members])
    kept = [c for c in df.columns if c not in ("scorer", "score")]
    return (joined.withColumn("_m", F.explode(rows))
            .select(*kept, "_m.scorer", F.col("_m.score").cast("double").alias("score")))


def centre_prior_rows(df: DataFrame, grid: int) -> DataFrame:
    score = geo.centre_prior(F.col("slice"), F.col("n_slices"), F.col("patch"), grid)
    return df.withColumn("scorer", F.lit("centre_prior")).withColumn("score", score.cast("double"))


def global_template(df: DataFrame, value: Column) -> DataFrame:
    """Mean score per patch over all slices of all bags, as FLOAT."""
    return df.groupBy("patch").agg(
        F.avg(value.cast("double")).cast("float").alias("template"),
        F.count(F.lit(1)).alias("n_slices_fit"))


def tile(df: DataFrame, template: DataFrame) -> DataFrame:
    """Attach a per-patch template (``n_patch`` rows) to every instance."""
    return df.join(F.broadcast(template.select("patch", "template")), "patch")


def bag_static(df: DataFrame, value: str, floor: float = 1e-12) -> DataFrame:
    """The bag's own slice-averaged map and the residual ``value / map``.

    (bag, patch) holds one row per slice, so the join back is salted by slice.
    """
    own = df.groupBy("bag_id", "patch", "n_slices").agg(
        (exact_total(F.col(value)) / F.count(F.lit(1))).alias("static"))
    out = salted_join(df, own, ["bag_id", "patch"], F.col("slice"), size="n_slices")
    return out.withColumn("residual", F.col(value) / F.greatest(F.col("static"), F.lit(floor)))


def top_mass(template: DataFrame, k: int = 16) -> DataFrame:
    """Share of a template's mass in its ``k`` largest cells, with extremes (bounded input)."""
    w = W.orderBy(F.col("template").desc(), F.col("patch"))
    ranked = template.withColumn("_r", F.row_number().over(w))
    t = F.col("template").cast("double")
    return ranked.agg((F.sum(F.when(F.col("_r") <= k, t)) / F.sum(t)).alias("top_share"),
                      F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(t).alias("n_cells"))


def centre_gaussian(df: DataFrame, sigma: float = 0.25) -> DataFrame:
    """Attention of a centred Gaussian over depth, normalised over the bag's instances."""
    z = geo.spread(F.col("slice"), F.col("n_slices"))
    raw = df.withColumn("_e", F.exp(F.lit(-0.5) * (z / F.lit(sigma)) * (z / F.lit(sigma))))
    sums = raw.groupBy("bag_id", "n_slices").agg(F.sum("_e").alias("_z"))
    out = salted_join(raw, sums, ["bag_id"], F.col("slice"), size="n_slices")
    return out.withColumn("attention", F.col("_e") / F.col("_z")).drop("_e", "_z")
