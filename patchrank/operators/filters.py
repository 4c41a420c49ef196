"""Projections, inclusion rules and name handling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import geometry as geo
from .scale import salted_join


def binarise(coverage: Column, threshold: float = 0.0) -> Column:
    """Strictly greater."""
    return (coverage > F.lit(threshold)).cast("int")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One copy of the rows per declared threshold, with its target."""
    each = F.array(*[F.lit(float(t)) for t in thresholds])
    out = df.withColumn("threshold", F.explode(each))
    return out.withColumn("target", (F.col("coverage") > F.col("threshold")).cast("int"))


def findings(df: DataFrame) -> DataFrame:
    """Complementary channels: finding 0 is the lesion, finding 1 the background."""
    t = F.col("target").cast("double")
    pair = F.array(F.struct(F.lit(0).alias("finding"), t.alias("inside")),
                   F.struct(F.lit(1).alias("finding"), (F.lit(1.0) - t).alias("inside")))
    return df.withColumn("_f", F.explode(pair)).select(*df.columns, "_f.finding", "_f.inside")


def bag_inclusion(df: DataFrame, n_patch: int, keys: Sequence[str] = ("bag_id",)) -> DataFrame:
    """Size, positives and the reason a bag is kept or dropped."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                F.sum((F.col("target") > 0).cast("bigint")).alias("n_pos"))
    reason = (F.when(F.col("n_pos") == 0, "all_negative").when(F.col("n_pos") == F.col("n"), "all_positive")
              .when(F.col("n") % n_patch != 0, "ragged").otherwise("kept"))
    return per.withColumn("n_slices", F.floor(F.col("n") / n_patch)).withColumn("reason", reason)


def check_counts(a: DataFrame, b: DataFrame, key: str = "bag_id") -> DataFrame:
    """Per-bag row counts of two tables; a disagreement is an error."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = left.join(right, key, "left").withColumn("n_right", F.coalesce("n_right", F.lit(0)))
    bad = F.raise_error(F.concat(F.lit("row counts differ for bag "), F.col(key).cast("string")))
    return both.withColumn("aligned", F.when(F.col("n_left") == F.col("n_right"), F.lit(True))
                           .otherwise(bad.cast("boolean")))


def restrict(df: DataFrame, region: DataFrame, threshold: float) -> DataFrame:
    """Rows inside the region (``frac`` strictly above the threshold), joined by identity.

    A row that the region table lacks is an error: a short table would shrink a bag unseen.
    """
    held = region.select("bag_id", "pos", "frac", F.lit(True).alias("_held"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("no region value for"), F.col("bag_id").cast("string"), F.col("pos").cast("string"))).cast("boolean")
    both = df.join(held, ["bag_id", "pos"], "left")
    return both.where(F.when(F.col("_held"), F.col("frac") > F.lit(threshold)).otherwise(bad)).drop("_held")


def grid_cells(df: DataFrame, n_patch: int, grid: int) -> DataFrame:
    """Position as (slice, row, col); a grid that does not hold ``n_patch`` patches is refused."""
    if grid * grid != n_patch:
        raise ValueError(f"a grid of {grid} x {grid} does not hold {n_patch} patches")
    return (df.withColumn("slice", geo.slice_of(F.col("pos"), n_patch))
            .withColumn("row", F.floor((F.col("pos") % n_patch) / grid))
            .withColumn("col", (F.col("pos") % n_patch) % grid))


def upsample_weights(spark, grid: int, out: int) -> DataFrame:
    """(patch, y, x, weight): bilinear weights with half-pixel centres; at most 4 * out**2 rows."""
    def ends(i: Column):
        at = F.greatest((i.cast("double") + 0.5) * F.lit(grid / out) - 0.5, F.lit(0.0))
        low = F.least(F.floor(at), F.lit(grid - 1))
        return low, F.least(low + 1, F.lit(grid - 1)), at - low
    base = spark.range(out * out).select(F.floor(F.col("id") / out).alias("y"),
                                         (F.col("id") % out).alias("x"))
    y0, y1, fy = ends(F.col("y"))
    x0, x1, fx = ends(F.col("x"))
    parts = F.array(*[F.struct((r * grid + c).cast("bigint").alias("patch"), w.alias("weight"))
                      for r, wr in ((y0, 1 - fy), (y1, fy)) for c, w in
                      ((x0, wr * (1 - fx)), (x1, wr * fx))])
    return base.withColumn("_p", F.explode(parts)).select("y", "x", "_p.*").groupBy(
        "patch", "y", "x").agg(F.sum("weight").alias("weight")).where("weight > 0")


def upsample(df: DataFrame, score: str, grid: int, out: int) -> DataFrame:
    """Patch scores on the pixel grid of their own slice; slices never mix. A pixel that needs a missing patch is left out."""
    weights = upsample_weights(df.sparkSession, grid, out)
    part = df.join(F.broadcast(weights), "patch")
    return part.groupBy("bag_id", "slice", "y", "x").agg(
        F.sum(F.col(score) * F.col("weight")).alias("value"), F.sum("weight").alias("_known")).where("_known > 0.999999").drop("_known")


def slice_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of a group, one row per dimension."""
    return (df.select(*keys, F.posexplode(vector).alias("dim", "x"))
            .groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean")))


def subsample_slices(slices: DataFrame, cap: int, seed: int, epoch: int) -> DataFrame:
    """At most ``cap`` slices per bag, a function of (seed, epoch, bag) alone.

    The rank is compared with a constant, so each task keeps at most ``cap`` rows per bag before
    the shuffle.
    """
    order = draws.order_key(seed, epoch, F.col("bag_id"), F.col("slice"))
    w = W.partitionBy("bag_id").orderBy("_h", "slice")
    return (slices.withColumn("_h", order).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= cap).drop("_h", "_r"))


def longest_contained(text: Column, names: Sequence[str]) -> Column:
    """Longest declared name contained in ``text``; NULL if none."""
    hits = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n))
    ranked = F.transform(hits, lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))
    return F.array_max(ranked)["n"]


def arm_tag(spec: Column, seed: Column) -> Column:
    return F.concat(F.replace(spec, F.lit(":"), F.lit("_")), F.lit("_seed"), seed.cast("string"))


def arm_of(tag: Column) -> Column:
    return F.regexp_replace(tag, "_seed[0-9]+$", "")


def parse_arm(spec: Column) -> tuple[Column, Column]:
    """``name:k=v,k=v`` as a name and a map."""
    rest = F.when(F.contains(spec, F.lit(":")), F.substring_index(spec, ":", -1))
    return F.substring_index(spec, ":", 1), F.str_to_map(rest, F.lit(","), F.lit("="))


def arm_set(arms: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Arms of the given scoring classes; an arm without a class is an error."""
    bad = F.raise_error(F.concat(F.lit("no scoring class for "), F.col("arm"))).cast("boolean")
    known = F.when(F.col("scoring_class").isNull(), bad).otherwise(F.lit(True))
    return arms.where(known & F.col("scoring_class").isin(*classes))


def remap_labels(df: DataFrame, pairs: dict[int, int]) -> DataFrame:
    """Replace label values; others stay."""
    expr = F.col("label")
    out = expr
    for src, dst in pairs.items():
        out = F.when(expr == src, F.lit(dst)).otherwise(out)
    return df.withColumn("label", out)


def relabel(df: DataFrame, labels: DataFrame, key: str = "bag_id") -> DataFrame:
    """Labels from another table; bags absent there are dropped."""
    return df.drop("label").join(labels.select(key, "label"), key)


def scan_labels(readings: DataFrame, undecided: float = 3.0) -> DataFrame:
    """Bag label from findings read several times.

    A finding's level is the median of its readings; one equal to ``undecided`` has no say; the
    label is 1 if any other exceeds it, 0 if none does, NULL if no finding decides.
    """
    med = readings.groupBy("bag_id", "finding").agg(F.percentile("reading", F.lit(0.5)).alias("m"))
    decisive = F.col("m") != undecided
    return med.groupBy("bag_id").agg(
        F.max(F.when(decisive, (F.col("m") > undecided).cast("int"))).alias("label"),
        F.count(F.lit(1)).alias("n_findings"),
        F.sum(decisive.cast("bigint")).alias("n_decisive"))


def bag_level(df: DataFrame, per_bag: DataFrame) -> DataFrame:
    """Attach one row per bag to the instances."""
    return salted_join(df, per_bag, ["bag_id"], F.col("pos"))
