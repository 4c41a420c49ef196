"""Skills, reference chains and cluster bootstraps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import pin
from . import replicates
from .scale import clean, hashed_positions, quantiles, require


def skill(value: Column, prior: Column) -> Column:
    """Share of the headroom above ``prior``; a prior outside [0, 1) is an error."""
    bad = F.raise_error(F.concat(F.lit("prior must be in [0, 1), got "), prior.cast("string")))
    return (F.when((prior < 0) | (prior >= 1), bad.cast("double"))
            .otherwise((value - prior) / (F.lit(1.0) - prior)))


def patient_specific(real: Column, cross: Column) -> Column:
    return real - cross


def interval_outcome(lo: Column, hi: Column) -> Column:
    """NULL for an undefined interval."""
    return (F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("string"))
            .when(lo > 0, F.lit("oracle_wins")).when(hi < 0, F.lit("trained_wins"))
            .otherwise(F.lit("indistinguishable")))


def reference_chain(links: DataFrame, keys: Sequence[str], step: str, name: str,
                    value: str) -> DataFrame:
    """Adjacent differences along an ordered chain, each with its share, and a total row.

    The chain is a declared list of a few links per key.
    """
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(step)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    rows = links.select(
        *keys, F.lag(name).over(w).alias("from"), F.col(name).alias("to"),
        (F.col(value) - F.lag(value).over(w)).alias("delta"), (last - first).alias("_total"),
        F.first(name).over(whole).alias("_first"), F.last(name).over(whole).alias("_last"))
    share = F.when(F.col("_total") != 0, F.col("delta") / F.col("_total"))
    steps = rows.where(F.col("from").isNotNull()).select(
        *keys, "from", "to", "delta", share.alias("frac"), F.lit("step").alias("kind"))
    total = (rows.where(F.col("from").isNotNull()).groupBy(*keys).agg(
        F.first("_first").alias("from"), F.first("_last").alias("to"),
        F.first("_total").alias("delta"))
        .select(*keys, "from", "to", "delta",
                F.when(F.col("delta") != 0, F.lit(1.0)).alias("frac"), F.lit("total").alias("kind")))
    return steps.unionByName(total)


def cluster_sums(df: DataFrame, keys: Sequence[str], value: str, cluster: str) -> DataFrame:
    """Sum and count per cluster, undefined values left out before anything is drawn."""
    return (require(df, [*keys, cluster]).withColumn("_v", clean(F.col(value))).where(F.col("_v").isNotNull())
            .groupBy(*keys, F.col(cluster).cast("string").alias("cluster"))
            .agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("rows")))


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], value: str, cluster: str,
                      reps: int = 10000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean and percentile interval, resampling clusters: ``mean, lo, hi, n, n_clusters``.

    Each key's clusters are numbered 0..C-1 and packed into arrays; a task draws a batch of replicates for them and returns one
    array of sums (``replicates``), so what is shuffled does not grow with draws. ``reps=0`` gives the mean alone.
    """
    if not keys:  # one group
        one = cluster_bootstrap(df.withColumn("_all", F.lit(0)), ["_all"], value, cluster, reps,
                                seed, alpha)
        return one.drop("_all")
    keys = list(keys)
    per = cluster_sums(df, keys, value, cluster)
    if reps > 0:
        per = pin(per)  # the scores behind it are computed once
    point = per.groupBy(*keys).agg(
        (F.sum("total") / F.sum("rows")).alias("mean"), F.sum("rows").alias("n"),
        F.count(F.lit(1)).alias("n_clusters"))
    if reps <= 0:
        null = F.lit(None).cast("double")
        return point.select(*keys, "mean", null.alias("lo"), null.alias("hi"), "n", "n_clusters")
    numbered = hashed_positions(per.withColumn("_h", F.md5("cluster")), keys, "_h", ["cluster"],
                                name="ix", total="size")
    edges = replicates.edges(replicates.cluster_means(numbered, keys, reps, seed), keys, alpha)
    return point.join(edges, keys).select(*keys, "mean", "lo", "hi", "n", "n_clusters")


def paired_rows(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Differences over the units present in both; alignment is by identity, never by row."""
    left = a.select(*on, F.col(value).alias("a"))
    right = b.select(*on, F.col(value).alias("b"))
    return left.join(right, list(on)).withColumn("delta", F.col("a") - F.col("b"))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str,
         value: str) -> DataFrame:
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def seed_summary(df: DataFrame, keys: Sequence[str], value: str, seed: str) -> DataFrame:
    """Mean, sample deviation (0 for one seed), count and values in seed order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seed), F.col(value)))),
                          lambda s: s[value])
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std"),
        F.count(value).alias("n"), ordered.alias("values"))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, p5, p95, min, max of a replicated statistic."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.min(value).alias("lo"), F.max(value).alias("hi"))
    return base.join(quantiles(df, keys, value, (0.5, 0.05, 0.95), ("median", "p5", "p95")), keys)


def draw_summary(df: DataFrame, keys: Sequence[str], value: str, draw: str) -> DataFrame:
    """Replicated null: mean, median, sample deviation, extremes, first draw, computable count."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.min_by(value, draw).alias("first_draw"), F.count(value).alias("n_computable"))


def power_note(df: DataFrame, lo_a: str, hi_a: str, mean_a: str, lo_b: str, hi_b: str,
               mean_b: str) -> DataFrame:
    """Separation two intervals needed for a to lie below b, against the one observed.

    The facing half-widths add up to the requirement; a positive shortfall means that the
    intervals were too wide for the observed separation.
    """
    return (df.withColumn("observed", F.col(mean_b) - F.col(mean_a))
            .withColumn("required", (F.col(mean_b) - F.col(lo_b)) + (F.col(hi_a) - F.col(mean_a)))
            .withColumn("shortfall", F.col("required") - F.col("observed"))
            .withColumn("orders", F.col(hi_a) < F.col(lo_b)))
