"""Paired and unpaired tests, multiplicity correction and classification metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tails
from ..session import pin
from . import ranking as rk
from .replicates import rank_replicates
from .scale import clean, require, running


LOOKUP_ROWS = 1 << 16  # a lookup of at most this many rows is sent to every task


def _placements(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scorer, score) -> DeLong components of a positive (v10) and of a negative (v01)."""
    cum = running(hist, [*keys, "scorer"], "score", ["p", "q"])
    v10 = rk.ratio((2 * F.col("before_q") + F.col("q")).cast("double"), 2.0 * F.col("all_q"))
    v01 = rk.ratio((2 * F.col("all_p") - 2 * F.col("before_p") - F.col("p")).cast("double"), 2.0 * F.col("all_p"))
    return cum.select(*keys, "scorer", "score", v10.alias("v10"), v01.alias("v01"))


def delong_family(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], target: str = "target") -> DataFrame:
    """Paired DeLong tests of declared pairs of score columns: (keys, arm, reference, auc_a, auc_b, delta, n_pos, n_neg, z, p).

    Every score is ranked once, whatever the number of its pairs, and the instances are never multiplied by pairs: placements are looked
    up per distinct score as columns, small lookups (counted) in place, and all moments are plain sums of one aggregation. A variance of zero gives z = 0 and p = 1.
    """
    keys, pairs = list(keys), list(pairs)
    scores = list(dict.fromkeys(c for pair in pairs for c in pair))
    named = {c: f"_x{i}" for i, c in enumerate(scores)}
    rows = df.select(*keys, (F.col(target) > 0).cast("int").alias("_y"), *[clean(F.col(c)).alias(x) for c, x in named.items()])
    rows = require(rows, [*keys, *named.values()])
    each = F.array(*[F.struct(F.lit(x).alias("scorer"), F.col(x).alias("score")) for x in named.values()])
    hist = rows.select(*keys, "_y", F.explode(each).alias("_e")).groupBy(*keys, "_e.scorer", "_e.score").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("q"))
    placed = pin(_placements(pin(hist), keys))
    counted = {r.scorer: r.n for r in placed.groupBy("scorer").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per declared score
    for x in sorted(named.values(), key=lambda x: counted.get(x, 0)):
        lookup = placed.where(F.col("scorer") == x).select(*keys, F.col("score").alias(x), F.col("v10").alias("_p"), F.col("v01").alias("_q"))
        joined = rows.join(F.broadcast(lookup) if counted.get(x, 0) <= LOOKUP_ROWS else lookup, [*keys, x])
        rows = joined.withColumn(x, F.when(F.col("_y") == 1, F.col("_p")).otherwise(F.col("_q"))).drop("_p", "_q")
    products = {(a, b): F.col(named[a]) * F.col(named[b]) for a, b in [*((c, c) for c in scores), *pairs]}
    code = {k: f"_m{i}" for i, k in enumerate(products)}
    sums = rows.groupBy(*keys, "_y").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(x) for x in named.values()],
                                         *[F.sum(p).alias(code[k]) for k, p in products.items()])

    def cov(x: Column, y: Column, xy: Column) -> Column:
        return F.when(F.col("n") > 1, (xy - x * y / F.col("n")) / (F.col("n") - 1))

    def test(a, b):
        x, y = F.col(named[a]), F.col(named[b])
        spread = (cov(x, x, F.col(code[a, a])) + cov(y, y, F.col(code[b, b])) - 2 * cov(x, y, F.col(code[a, b]))) / F.col("n")
        return F.struct(F.lit(a).alias("arm"), F.lit(b).alias("reference"), (x / F.col("n")).alias("ma"), (y / F.col("n")).alias("mb"), spread.alias("v"))
    per = sums.select(*keys, "_y", "n", F.explode(F.array(*[test(a, b) for a, b in pairs])).alias("_t")).select(*keys, "_y", "n", "_t.*")
    pos, neg = F.col("_y") == 1, F.col("_y") == 0
    out = per.groupBy(*keys, "arm", "reference").agg(
        F.max(F.when(pos, F.col("ma"))).alias("auc_a"), F.max(F.when(pos, F.col("mb"))).alias("auc_b"),
        F.max(F.when(pos, F.col("n"))).cast("bigint").alias("n_pos"),
        F.max(F.when(neg, F.col("n"))).cast("bigint").alias("n_neg"), F.sum("v").alias("_v"))
    out = out.withColumn("delta", F.col("auc_a") - F.col("auc_b"))
    z = F.when(F.col("_v") > 1e-18, F.col("delta") / F.sqrt("_v")).when(F.col("_v").isNotNull(), F.lit(0.0))
    return out.withColumn("z", z).withColumn("p", tails.normal_p("z")).drop("_v")


def delong(df: DataFrame, keys: Sequence[str], a: str, b: str, target: str = "target") -> DataFrame:
    """Paired DeLong test of two scores per key: ``auc_a, auc_b, delta, z, p`` and class counts; one pair of ``delong_family``."""
    if not keys:
        return delong(df.withColumn("_all", F.lit(0)), ["_all"], a, b, target).drop("_all")
    return delong_family(df, keys, [(a, b)], target).drop("arm", "reference")


def holm(df: DataFrame, family: Sequence[str], p: str, order: str, alpha: float = 0.05) -> DataFrame:
    """Holm step-down per family: ``p_adjusted, reject, n_family, n_reject``.

    An undefined p (NaN or NULL) counts toward the family, sorts last, is never rejected and
    stays undefined. A family is a declared list of tests. p outside [0, 1] is an error.
    """
    known = F.col(p).isNotNull() & ~F.isnan(p)
    bad = F.raise_error(F.concat(F.lit("p-value outside [0, 1]: "), F.col(p).cast("string"))).cast("double")
    value = F.when(known, F.when((F.col(p) < 0) | (F.col(p) > 1), bad).otherwise(F.col(p)))
    rows = df.withColumn("_p", value)
    w = W.partitionBy(*family).orderBy(F.col("_p").asc_nulls_last(), order)
    whole = W.partitionBy(*family)
    rows = rows.withColumn("n_family", F.count(F.lit(1)).over(whole)).withColumn(
        "_s", F.col("_p") * (F.col("n_family") - F.row_number().over(w) + 1))
    top = F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("p_adjusted", F.when(F.col("_p").isNotNull(), F.least(top, F.lit(1.0))))
    rows = rows.withColumn("reject", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))
    return rows.withColumn("n_reject", F.sum(F.col("reject").cast("bigint")).over(whole)).drop("_p", "_s")


def paired_battery(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Paired comparison: means, standard error, share better, t and signed-rank tests."""
    if not keys:
        return paired_battery(df.withColumn("_all", F.lit(0)), ["_all"], a, b).drop("_all")
    keys = list(keys)
    rows = df.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d").isNotNull())
    base = rows.groupBy(*keys).agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("_d").alias("mean_diff"),
        (F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).alias("sem_diff"),
        F.avg((F.col("_d") > 0).cast("double")).alias("frac_better"), F.count(F.lit(1)).alias("n"))
    hist = rows.where(F.col("_d") != 0).groupBy(*keys, F.abs("_d").alias("size")).agg(
        F.count(F.lit(1)).alias("m"), F.sum((F.col("_d") > 0).cast("bigint")).alias("up"))
    cum = running(hist, keys, "size", ["m"])
    m = F.col("m").cast("double")
    mid = F.col("before_m") + (m + 1) / 2
    ranks = cum.groupBy(*keys).agg(F.sum(F.col("up") * mid).alias("w_plus"), F.sum("m").alias("n_used"),
                                   F.sum(m * m * m - m).alias("_ties"))
    n = F.col("n_used").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = base.join(ranks, keys, "left")
    out = out.withColumn("t", rk.ratio(F.col("mean_diff"), F.col("sem_diff"))).withColumn(
        "z", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)))
    return (out.withColumn("t_p", tails.t_p("t", (F.col("n") - 1).cast("double")))
            .withColumn("wilcoxon_p", tails.signed_rank_p("w_plus", n, "z", "_ties")).drop("_ties"))


def welch(df: DataFrame, keys: Sequence[str], group: str, first, value: str) -> DataFrame:
    """Welch's t between the rows where ``group == first`` and the rest."""
    a, b = F.col(group) == F.lit(first), F.col(group) != F.lit(first)
    s = df.groupBy(*keys).agg(*[f(F.when(c, F.col(value))).alias(f"{n}{i}") for i, c in ((1, a), (2, b))
                                for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    ea, eb = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    df_ = (ea + eb) * (ea + eb) / (ea * ea / (F.col("n1") - 1) + eb * eb / (F.col("n2") - 1))
    out = s.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(ea + eb)).withColumn("df", df_)
    return out.withColumn("p", tails.t_p("t", "df"))


def mann_whitney(df: DataFrame, keys: Sequence[str], in_first: str, value: str) -> DataFrame:
    """U of the rows flagged by ``in_first`` against the rest, tie-corrected z, two-sided p."""
    if not keys:
        return mann_whitney(df.withColumn("_all", F.lit(0)), ["_all"], in_first, value).drop("_all")
    keys = list(keys)
    base = rk.auc(df, keys, value, in_first)
    ties = (df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("m"))
            .groupBy(*keys).agg(F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("t")))
    x, y = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = x + y
    sd = F.sqrt(x * y / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    gap = F.greatest(F.abs(F.col("u") - x * y / 2) - 0.5, F.lit(0.0))
    out = base.join(ties, keys).withColumn("u", F.col("conc2") / 2)
    out = out.withColumn("z", F.when(sd > 0, F.signum(F.col("u") - x * y / 2) * gap / sd))
    return out.withColumn("p", tails.normal_p("z")).select(*keys, "n_pos", "n_neg", "u", "z", "p")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with midranks."""
    if not keys:
        return spearman(df.withColumn("_all", F.lit(0)), ["_all"], x, y).drop("_all")
    keys = list(keys)
    pairs = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("m")))

    def ranks(name: str) -> DataFrame:
        hist = pairs.groupBy(*keys, name).agg(F.sum("m").alias("c"))
        cum = running(hist, keys, name, ["c"])
        return cum.select(*keys, name, (F.col("before_c") + (F.col("c") + 1) / 2).alias(f"r_{name}"))
    rows = pairs.join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"])
    m, a, b = F.col("m").cast("double"), F.col("r_x"), F.col("r_y")
    s = rows.groupBy(*keys).agg(F.sum(m).alias("n"), F.sum(m * a).alias("a"), F.sum(m * b).alias("b"),
                                F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb"), F.sum(m * a * b).alias("ab"))
    n = F.col("n")
    top = F.col("ab") - F.col("a") * F.col("b") / n
    low = (F.col("aa") - F.col("a") * F.col("a") / n) * (F.col("bb") - F.col("b") * F.col("b") / n)
    return s.select(*keys, n.cast("bigint").alias("n"), F.when(low > 0, top / F.sqrt(low)).alias("rho"))


def binary_metrics(df: DataFrame, keys: Sequence[str], y: str, score: str, cut: float = 0.5,
                   weight: str | None = None) -> DataFrame:
    """AUC, macro F1, accuracy and balanced accuracy of a binary score."""
    if not keys:
        return binary_metrics(df.withColumn("_all", F.lit(0)), ["_all"], y, score, cut, weight).drop("_all")
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    yes, hit = F.col(y) == 1, F.col(score) > cut
    cells = {"tp": yes & hit, "fp": ~yes & hit, "fn": yes & ~hit, "tn": ~yes & ~hit}
    counts = df.groupBy(*keys).agg(*[F.sum(F.when(c, w).otherwise(0)).cast("double").alias(n) for n, c in cells.items()])
    out = counts.select(*keys, *_from_cells())
    a = rk.auc(df, keys, score, y, weight=weight)
    return out.join(a.select(*keys, "auc", "n_pos", "n_neg"), keys)


def _from_cells() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = _over_present((2 * tp, 2 * tp + fp + fn), (2 * tn, 2 * tn + fp + fn))
    return [f1.alias("macro_f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("acc"), _over_present((tp, tp + fn), (tn, tn + fp)).alias("balanced_acc")]


def _over_present(*ratios: tuple[Column, Column]) -> Column:
    """Mean of the ratios whose denominator is positive: a class that never occurs has no say."""
    present = [(low > 0).cast("int") for _, low in ratios]
    values = [_guard(top, low) for top, low in ratios]
    return sum(values[1:], values[0]) / F.greatest(sum(present[1:], present[0]), F.lit(1))


def _guard(top: Column, low: Column) -> Column:
    return F.when(low > 0, top / low).otherwise(F.lit(0.0))


def multiclass_metrics(df: DataFrame, y: str, scores: str, n_classes: int) -> DataFrame:
    """Macro one-vs-rest AUC, macro F1, accuracy, balanced accuracy from a score array."""
    pred = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    rows = df.select(F.col(y).alias("y"), pred.alias("pred"), F.posexplode(scores).alias("cls", "score"))
    a = rk.auc(rows.withColumn("is", (F.col("y") == F.col("cls")).cast("int")), ["cls"], "score", "is")
    table = df.groupBy(F.col(y).alias("y"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("y").alias("cls"), (F.col("y") == F.col("pred")).cast("int").alias("tp"),
                            F.lit(1).alias("t"), F.lit(0).alias("p")),
                   F.struct(F.col("pred").alias("cls"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    per = table.withColumn("_e", F.explode(both)).select("n", "_e.*").groupBy("cls").agg(
        F.sum(F.col("n") * F.col("tp")).alias("tp"), F.sum(F.col("n") * F.col("t")).alias("t"),
        F.sum(F.col("n") * F.col("p")).alias("p"))
    tp, t, p = (F.col(c).cast("double") for c in ("tp", "t", "p"))
    m = per.agg(F.avg(_guard(2 * tp, t + p)).alias("macro_f1"), (F.sum(tp) / F.sum(t)).alias("acc"),
                F.avg(F.when(t > 0, tp / t)).alias("balanced_acc"), F.sum("t").alias("n"))
    return m.withColumn("auc", a.agg(F.avg("auc")).scalar())


def bag_bootstrap(df: DataFrame, key: str, y: str, score: str, metric: str = "auc", reps: int = 2000,
                  seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of a classification metric, resampling rows; one-class resamples are skipped.

    A replicate is a set of weights over the histogram of scores (``replicates.rank_replicates``).
    """
    per = rank_replicates(df, key, y, score, reps, seed)
    per = per.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    per = per.select((F.col("concordant") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), *_from_cells())
    return per.agg(F.avg(metric).alias("mean"), F.percentile(metric, F.lit(alpha / 2)).alias("lo"),
                   F.percentile(metric, F.lit(1 - alpha / 2)).alias("hi"), F.count(F.lit(1)).alias("n_boot"))


def best_against_others(df: DataFrame, arm: str, value: str, candidates: Sequence[str],
                        alpha: float = 0.05) -> DataFrame:
    """The candidate arm with the highest mean against every other arm, by Welch's t over seeds.

    Significant wins and losses of the best arm are both reported. Arms are a declared list.
    """
    per = df.groupBy(arm).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    top = per.where(F.col(arm).isin(*candidates)).agg(
        F.max_by(F.struct(F.col(arm).alias("arm"), "m", "v", "n"), F.struct(F.col("m"), F.col(arm)))).scalar()
    rows = per.withColumn("_b", top).where(F.col(arm) != F.col("_b.arm"))
    ea, eb = F.col("_b.v") / F.col("_b.n"), F.col("v") / F.col("n")
    dof = (ea + eb) * (ea + eb) / (ea * ea / (F.col("_b.n") - 1) + eb * eb / (F.col("n") - 1))
    usable = (F.col("_b.n") > 1) & (F.col("n") > 1) & (ea + eb > 0)
    rows = rows.select(F.col("_b.arm").alias("best"), F.col(arm).alias("other"), (F.col("_b.m") - F.col("m")).alias("delta"),
                       F.when(usable, (F.col("_b.m") - F.col("m")) / F.sqrt(ea + eb)).alias("t"), F.when(usable, dof).alias("df"))
    rows = rows.withColumn("p", tails.t_p("t", "df"))
    return (rows.withColumn("wins", (F.col("delta") > 0) & (F.col("p") < alpha))
            .withColumn("loses", (F.col("delta") < 0) & (F.col("p") < alpha)))


def multilabel_metrics(df: DataFrame, labels: Sequence[tuple[str, str]], cut: float = 0.5) -> DataFrame:
    """Macro AUC and positive-class F1 over labels, accuracy over all decisions."""
    each = F.array(*[F.struct(F.lit(i).alias("label"), F.col(y).alias("y"), F.col(s).alias("score"))
                     for i, (y, s) in enumerate(labels)])
    rows = df.select(F.explode(each).alias("_e")).select("_e.*")
    yes, hit = F.col("y") == 1, F.col("score") > cut
    per = rows.groupBy("label").agg(
        F.sum((yes & hit).cast("double")).alias("tp"), F.sum(yes.cast("double")).alias("t"),
        F.sum(hit.cast("double")).alias("p"), F.sum((yes == hit).cast("double")).alias("ok"),
        F.count(F.lit(1)).alias("n"))
    a = rk.auc(rows, ["label"], "score", "y").select("label", "auc")
    return per.join(a, "label").agg(
        F.avg("auc").alias("auc"), (F.sum("ok") / F.sum("n")).alias("acc"),
        F.avg(_guard(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("macro_f1"))
