"""Reports over scored tags: families, gates, paired intervals, in-region checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import alignment as al
from ..operators import bagwise as bw
from ..operators import estimands as es
from ..operators import filters as fl
from ..operators import inference as inf
from ..operators import nulls as nl
from ..operators import ranking as rk
from ..operators import slots as sl
from ..operators import templates as tp
from ..operators.scale import HOT_ROWS
from ..session import pin
from .atlas import AXES, intervals


def family_axes(fit: DataFrame, test: DataFrame, score: str, n_patch: int, grid: int, n_bins: int) -> DataFrame:
    """Axes per (scorer, bag): the arm, four members fitted to masks, four to scores, the centre prior.

    All ten scorers go through one ranking pass. ``fit`` has ``part``; a row of the score half is refused.
    """
    keep = ["bag_id", "pos", "slice", "patch", "n_slices", "target", "slice_pos"]
    base = test.select(*keep)
    rows = test.select(*keep, F.lit("trained").alias("scorer"), F.col(score).cast("double").alias("score"))
    for source, value in (("masks", F.col("target")), ("attention", F.col(score))):
        family = tp.fill(tp.fit_cells(fit, value, n_bins, refuse_split="score", split_column="part"), n_bins, n_patch)
        part = tp.apply_family(base, family, n_bins)
        rows = rows.unionByName(part.withColumn("scorer", F.concat(F.lit(f"{source}:"), F.col("scorer"))))
    rows = rows.unionByName(tp.centre_prior_rows(base, grid))
    return rk.axes(rows, n_patch, ["scorer", "bag_id"])


def family_report(axes: DataFrame, bags: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Interval per (scorer, axis), skill of each scorer's flat AUC against the pinned denominator."""
    ci = intervals(axes.join(bags, "bag_id"), ["scorer"], reps, seed)
    pinned = ci.where((F.col("scorer") == "attention:inplane") & (F.col("axis") == "flat")).select("mean").scalar()
    out = ci.withColumn("_d", pinned)
    return out.withColumn("skill", F.when(F.col("axis") == "flat", es.skill(F.col("mean"), F.col("_d")))).drop("_d")


def family_paired(axes: DataFrame, bags: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Every mask-fitted member minus the arm, per bag, with its interval outcome."""
    flat = axes.select("scorer", "bag_id", "flat")
    arm = flat.where("scorer = 'trained'").drop("scorer")
    members = flat.where(F.col("scorer").startswith("masks:"))
    pairs = members.join(arm.withColumnRenamed("flat", "_arm"), "bag_id").withColumn("delta", F.col("flat") - F.col("_arm"))
    ci = es.cluster_bootstrap(pairs.join(bags, "bag_id"), ["scorer"], "delta", "patient_id", reps, seed)
    return ci.withColumn("outcome", es.interval_outcome(F.col("lo"), F.col("hi")))


def axis_gate(axes: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """Interval per (tag, axis) and whether it covers one half."""
    ci = intervals(axes, ["tag"], reps, seed)
    return ci.withColumn("covers_half", (F.col("lo") <= 0.5) & (F.col("hi") >= 0.5))


def covering_share(gate: DataFrame, arms: Column) -> DataFrame:
    rows = gate.where(arms & (F.col("axis") == "slice"))
    return rows.agg(F.avg(F.col("covers_half").cast("double")).alias("share"), F.count(F.lit(1)).alias("n_tags"))


def paired_slice(axes: DataFrame, reference: str, reps: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reference minus arm on the slice axis: per tag, and per arm with all seeds of a patient together."""
    ref = axes.where(F.col("tag") == reference).select("bag_id", F.col("slice").alias("_ref"))
    arms = axes.where(F.col("seed").isNotNull()).join(ref, "bag_id").withColumn("delta", F.col("_ref") - F.col("slice"))
    def outcome(df):
        return df.withColumn("outcome", es.interval_outcome(F.col("lo"), F.col("hi")))
    return (outcome(es.cluster_bootstrap(arms, ["arm", "seed"], "delta", "patient_id", reps, seed)),
            outcome(es.cluster_bootstrap(arms, ["arm"], "delta", "patient_id", reps, seed)))


def _moved_lists(rows: DataFrame, sizes: DataFrame, n_patch: int, derangements: int, seed: int, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rep, bag_id, positives) of bags up to ``hot_rows``, their own under rep -1, and (rep, bag_id, pos) of all other requests, None without any."""
    donors = pin(nl.donor_map(sizes, seed, derangements))
    lists, rest = nl.shuffle_lists(rows, donors, n_patch, hot_rows)
    small, large = rk.by_size(rows, "n_slices", max(hot_rows // n_patch, 0))
    own = nl.lists_of_positives(small).withColumn("rep", F.lit(-1))
    lists = lists.unionByName(own.select(*lists.columns))
    if rest.isEmpty() and large.isEmpty():
        return lists, None
    own = large.where(F.col("target") > 0).select(F.lit(-1).alias("rep"), "bag_id", "pos")
    return lists, own.unionByName(nl.shuffle_positives(rows, rest, n_patch))


def _real_and_cross(rows: DataFrame, sizes: DataFrame, score: str, n_patch: int, derangements: int, seed: int, hot_rows: int = HOT_ROWS):
    """(bag_id, real) and (rep, bag_id, auc) under derangements; the scores are ranked once and only positives move."""
    keep = rows.select("bag_id", "pos", "n_slices", "target", score)
    lists, rest = _moved_lists(keep, sizes, n_patch, derangements, seed, hot_rows)
    small, _ = rk.by_size(keep, "n_slices", max(hot_rows // n_patch, 0))
    per = rk.auc_of_lists(small, lists, score).select("rep", "bag_id", "n_pos", "auc")
    if rest is not None:
        asked = keep.join(rest.select("bag_id").distinct(), "bag_id", "left_semi").withColumn("n_rows", F.col("n_slices") * F.lit(n_patch))  # a bound
        per = per.unionByName(rk.auc_of_positives(rk.midranks(asked, ["bag_id"], score, size="n_rows", hot_rows=hot_rows), rest, ["rep", "bag_id"]))
    per = pin(per)
    real = per.where("rep < 0 AND auc IS NOT NULL").select("bag_id", F.col("auc").alias("real"))
    return real, per.where("rep >= 0")


def cross_patient(rows: DataFrame, bags: DataFrame, sizes: DataFrame, score: str, n_patch: int, derangements: int,
                  reps: int, seed: int = 0) -> DataFrame:
    """Real, cross-patient and difference intervals over patients; a derangement moves positives only."""
    real, drawn = _real_and_cross(rows, sizes, score, n_patch, derangements, seed)
    per = drawn.groupBy("bag_id").agg(F.avg("auc").alias("cross"))
    both = real.join(per.where("cross IS NOT NULL"), "bag_id").withColumn("skill", F.col("real") - F.col("cross"))
    long = es.melt(both.join(bags, "bag_id"), ["patient_id"], ["real", "cross", "skill"], "quantity", "value")
    return es.cluster_bootstrap(long, ["quantity"], "value", "patient_id", reps, seed)


def cross_patient_chain(rows: DataFrame, sizes: DataFrame, template_auc: DataFrame, score: str, n_patch: int, derangements: int, seed: int = 0) -> DataFrame:
    """The chain chance, fitted template, cross-patient, full with each step's share, and what backs it.

    ``template_auc`` has (bag_id, auc). Every row also carries the bags scored, the bags with a real value but none under any derangement (they
    are left out), the mean over derangements of their mean over bags, and ``consistent``: whether the mean of the paired
    differences equals the difference of the means over one set of bags. A link without a value gives steps of NULL.
    """
    real, drawn = _real_and_cross(rows, sizes, score, n_patch, derangements, seed)
    per = drawn.where("auc IS NOT NULL").groupBy("bag_id").agg(F.avg("auc").alias("cross"))
    both = real.join(per, "bag_id", "left").withColumn("_skill", F.col("real") - F.col("cross"))
    scored = F.col("cross").isNotNull()
    facts = both.agg(F.count("cross").alias("n_bags"), F.count(F.when(~scored, 1)).alias("n_without"), F.avg(F.when(scored, F.col("real"))).alias("_full"),
                     F.avg("cross").alias("_cross"), F.avg("_skill").alias("_paired"))
    by_draw = drawn.groupBy("rep").agg(F.avg("auc").alias("_m")).agg(F.avg("_m").alias("mean_over_derangements"))
    parts = [df.withColumn("score", F.lit(score)) for df in (facts, by_draw, template_auc.agg(F.avg("auc").alias("_template")))]  # one row each
    known = parts[0].join(parts[1], "score").join(parts[2], "score")
    known = known.withColumn("consistent", F.coalesce(F.abs(F.col("_full") - F.col("_cross") - F.col("_paired")) < 1e-9, F.lit(True)))
    links = (("chance", F.lit(0.5)), ("fitted_template", F.col("_template")), ("cross_patient", F.col("_cross")), ("full", F.col("_full")))
    kept = ["n_bags", "n_without", "mean_over_derangements", "consistent"]
    steps = known.select("score", F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), x.alias("value")) for i, (n, x) in enumerate(links)])).alias("_l")).select("score", "_l.*")
    return es.reference_chain(steps, ["score"], "step", "name", "value").join(known.select("score", *kept), "score")


def cross_patient_axes(rows: DataFrame, bags: DataFrame, sizes: DataFrame, score: str, n_patch: int, derangements: int,
                       reps: int, seed: int = 0) -> DataFrame:
    """``cross_patient`` on all three axes: intervals of real, cross and difference by (axis, quantity). The scores are ranked once."""
    keep = rows.select("bag_id", "pos", "n_slices", "target", score)
    lists, rest = _moved_lists(keep, sizes, n_patch, derangements, seed, HOT_ROWS)
    moved = keep.limit(0).select(F.lit(0).alias("rep"), "bag_id", "pos") if rest is None else rest
    per = rk.axes_of_positives(keep, moved, n_patch, score, lists=lists)
    long = es.melt(per, ["bag_id", "rep"], ["flat", "slice", "within_slice"], "axis", "auc")
    both = long.groupBy("axis", "bag_id").agg(F.max(F.when(F.col("rep") < 0, F.col("auc"))).alias("real"), F.avg(F.when(F.col("rep") >= 0, F.col("auc"))).alias("cross"))
    both = both.where("real IS NOT NULL AND cross IS NOT NULL").withColumn("skill", F.col("real") - F.col("cross"))
    each = es.melt(both.join(bags, "bag_id"), ["axis", "patient_id"], ["real", "cross", "skill"], "quantity", "value")
    return es.cluster_bootstrap(each, ["axis", "quantity"], "value", "patient_id", reps, seed)


def control_seeds(per_bag: DataFrame) -> DataFrame:
    """(condition, arm, seed, mode, auc, n_bags): mean of ``ranking.stratified_axes`` over the bags that have one."""
    return per_bag.groupBy("condition", "arm", "seed", "mode").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_bags"))


def control_arms(seeds: DataFrame) -> DataFrame:
    """(condition, arm, mode, mean, sd, n_seeds): arms over seeds, with the population deviation."""
    return seeds.groupBy("condition", "arm", "mode").agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.count("auc").alias("n_seeds"))


def control_deltas(seeds: DataFrame, first: str, second: str) -> DataFrame:
    """(condition, mode, delta, t, p): arm ``first`` minus ``second`` by Welch over seeds, per condition and pooled (condition NULL)."""
    both = seeds.where(F.col("arm").isin(first, second) & F.col("auc").isNotNull())
    rows = both.select("condition", "mode", "arm", "auc").unionByName(both.select(F.lit(None).cast("string").alias("condition"), "mode", "arm", "auc"))
    out = inf.welch(rows, ["condition", "mode"], "arm", first, "auc")
    return out.select("condition", "mode", (F.col("m1") - F.col("m2")).alias("delta"), "n1", "n2", "t", "p")


def in_region(rows: DataFrame, scorers: Sequence[str], threshold: float, n_patch: int, grid: int, n_radial: int) -> DataFrame:
    """(scorer, region, stratified, bag_id, auc): plain and stratified, restricted and not."""
    binned = sl.with_radial_bin(rows, n_patch, grid, n_radial).withColumn("n_rows", F.col("n_slices") * F.lit(n_patch))
    kept = ["bag_id", "slice", "rbin", "frac", "target", "n_rows"]
    long = sl.long_slots(binned.select(*kept, *scorers), scorers)
    both = F.when(F.col("frac") > threshold, F.array(F.lit("all"), F.lit("inside"))).otherwise(F.array(F.lit("all")))
    long = long.withColumn("region", F.explode(both))
    keys = ["slot", "region", "bag_id"]
    plain = rk.auc(long, keys, size="n_rows").select(*keys, "auc", F.lit(False).alias("stratified"))
    strat = rk.stratified_auc(long, keys, ["slice", "rbin"], size="n_rows").select(*keys, "auc", F.lit(True).alias("stratified"))
    return plain.unionByName(strat)


def holm_family(rows: DataFrame, arms: Sequence[str], references: Sequence[str], seed_key: str = "seed") -> DataFrame:
    """Pooled DeLong of every arm against every reference per seed, Holm-adjusted inside the seed.

    A member that cannot be paired in a seed (one class, or no rows) stays in the output with a NULL p and counts
    toward the family; ``short`` says that the seed's family then lacks a declared member, ``underflow`` that a p-value is below doubles.
    """
    tests = inf.delong_family(rows, [seed_key], [(a, r) for a in arms for r in references])
    declared = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(r).alias("reference")) for a in arms for r in references]))
    whole = rows.select(seed_key).distinct().withColumn("_m", declared).select(seed_key, "_m.arm", "_m.reference")
    every = whole.join(tests, [seed_key, "arm", "reference"], "left").withColumn("test", F.concat_ws("|", "arm", "reference"))
    out = inf.holm(every, [seed_key], "p", "test").drop("test")
    known = F.count_if(F.col("p").isNotNull() & ~F.isnan("p")).over(W.partitionBy(seed_key))  # a declared list of tests
    return (out.withColumn("short", known < len(arms) * len(references))
            .withColumn("underflow", (F.col("p") == 0).cast("int")))


def untrained_bags(rows: DataFrame, slots: Sequence[str], n_patch: int, inits: int, seed: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(model, slot, bag_id, auc) of the score half, per untrained init under the slot frozen on the fit half.

    Bags up to ``hot_rows`` are drawn and ranked by the task that holds them, larger ones and those of unknown size row by row.
    """
    names = [f"r{i}" for i in range(len(slots))]
    base = rows.select("bag_id", "pos", "n_slices", "target").withColumn("part", draws.half(F.col("bag_id")))
    small, large = rk.by_size(base, "n_slices", max(hot_rows // n_patch, 0))
    every = large.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(inits - 1))))
    every = nl.random_slots(every, len(slots), 1.0, F.concat(F.lit(f"{seed}m"), F.col("model").cast("string")))
    shares = bw.untrained(small.where("part = 'fit'"), len(slots), inits, seed).select("model", "bag_id", "slot", "value")
    shares = shares.unionByName(al.bag_affinity(every.where("part = 'fit'"), names, ["model"]).where("finding = 0").select(*shares.columns))
    means = shares.groupBy("model", "slot").agg(F.avg("value").alias("affinity")).withColumn("finding", F.lit(0))
    frozen = {r.model: r.slot for r in al.lesion_slot(means, ["model"]).collect()}  # one row for each declared init
    out = bw.untrained(small.where("part <> 'fit'"), len(slots), inits, seed, frozen).select("model", "slot", "bag_id", "auc")
    if not frozen:
        return out
    slot = F.get(F.array(*[F.lit(frozen.get(m)).cast("int") for m in range(inits)]), F.col("model"))
    sized = every.where("part <> 'fit'").withColumn("n_rows", F.col("n_slices") * F.lit(n_patch)).withColumn("slot", slot)
    score = F.get(F.array(*names), F.col("slot"))
    rest = rk.auc(sized.withColumn("score", score), ["model", "slot", "bag_id"], size="n_rows")
    return out.unionByName(rest.select(*out.columns))


def untrained_floor(rows: DataFrame, bags: DataFrame, slots: Sequence[str], n_patch: int, inits: int, reps: int,
                    seed: int = 0) -> DataFrame:
    """Per untrained init (a key): per-bag AUC of its frozen slot, interval over patients."""
    per = untrained_bags(rows, slots, n_patch, inits, seed)
    return es.cluster_bootstrap(per.join(bags, "bag_id"), ["model"], "auc", "patient_id", reps, seed)


def content_free_members(rows: DataFrame, score: str, n_patch: int, n_draws: int, seed: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(member, draw, auc, denominator, skill): chance, roll permutation, fitted template.

    Each has its own in-plane template as the denominator; the template of the arm is fitted on
    the fit half with the true targets. A draw moves one list of positives a bag, between rows that are ranked once; bags above ``hot_rows``,
    with gaps or with unknown targets are rolled row by row.
    """
    part = rows.withColumn("part", draws.half(F.col("bag_id"))).withColumn("n_rows", nl.length_of(rows, n_patch))
    fit, test = part.where("part = 'fit'"), part.where("part <> 'fit'")
    template = tp.global_template(fit, F.col(score))
    base = tp.tile(test, template).withColumn("template", F.col("template").cast("double"))
    each = F.array(F.struct(F.lit("fitted_template").alias("member"), F.col("template").alias("score"), F.col("template").alias("den")),
                   F.struct(F.lit("chance").alias("member"), F.lit(1.0).alias("score"), F.lit(1.0).alias("den")))
    fixed = base.withColumn("_m", F.explode(each)).select("bag_id", "target", "n_rows", F.lit(0).alias("draw"), "_m.*")
    per = sl.slot_auc(fixed, ["score", "den"], ["member", "draw", "bag_id"], size="n_rows").select("member", "draw", "slot", "auc")
    whole = F.bool_and(F.coalesce((F.col("n_slices") <= max(hot_rows // n_patch, 0)) & F.col("target").isNotNull(), F.lit(False)))
    whole = whole & (F.count(F.lit(1)) == F.max("n_rows")) & (F.max("pos") == F.max("n_rows") - 1)
    apart = pin(test.groupBy("bag_id").agg(whole.alias("_whole")).where("NOT _whole").select("bag_id"))
    some = not apart.isEmpty()
    small = base.join(apart, "bag_id", "left_anti") if some else base
    lists = nl.roll_lists(small, n_patch, seed, n_draws)
    for slot, value in enumerate((score, "template")):
        moved = rk.auc_of_lists(small, lists, value)
        per = per.unionByName(moved.select(F.lit("roll_permutation").alias("member"), F.col("rep").alias("draw"), F.lit(slot).alias("slot"), "auc"))
    if some:
        own, given = (df.join(apart, "bag_id", "left_semi") for df in (base, test))
        rolled = nl.replace_target(own.select("bag_id", "pos", "n_rows", "target", score, "template"), nl.roll_targets(given, n_patch, seed, n_draws))
        rolled = rolled.select("bag_id", "target", "n_rows", F.col("rep").alias("draw"), F.lit("roll_permutation").alias("member"),
                               F.col(score).alias("score"), F.col("template").alias("den"))
        rest = sl.slot_auc(rolled, ["score", "den"], ["member", "draw", "bag_id"], size="n_rows")
        per = per.unionByName(rest.select(*per.columns))
    means = per.groupBy("member", "draw").agg(F.avg(F.when(F.col("slot") == 0, F.col("auc"))).alias("auc"),
                                              F.avg(F.when(F.col("slot") == 1, F.col("auc"))).alias("denominator"))
    return means.withColumn("skill", es.skill(F.col("auc"), F.col("denominator")))


def entropy_matched_members(rows: DataFrame, arms: dict[str, Sequence[str]], probe: DataFrame, normals: Sequence[str], n_patch: int, n_draws: int,
                            seed: int = 0) -> DataFrame:
    """(arm, draw, scale, auc, denominator, skill, computable) of random attention at the entropy of each arm's slots on the score half.

    The scale is matched once per arm and shared by its draws. Numerator and denominator are the first random slot and its own in-plane template, fitted on the
    random attention of the fit half. An arm with one slot is a row that is not computable. Arms are a declared list.
    """
    part = rows.withColumn("part", draws.half(F.col("bag_id")))
    test = part.where("part <> 'fit'")
    goals = None
    for arm, slots in arms.items():
        one = nl.slot_entropy(test, slots).select(F.lit(arm).alias("arm"), (F.col("slot_entropy") if len(slots) > 1 else F.lit(None).cast("double")).alias("slot_entropy"))
        goals = one if goals is None else goals.unionByName(one)
    scales = pin(nl.match_scales(goals, ["arm"], probe, normals))
    named = F.when(F.lit(False), F.lit(None).cast("double"))
    for r in arms:
        named = named.when(F.col("arm") == r, scales.where(F.col("arm") == r).select("scale").scalar())
    base = part.select("bag_id", "pos", "patch", "target", "part", (F.col("n_slices") * F.lit(n_patch)).alias("n_rows"))
    each = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(d).alias("draw")) for a, s in arms.items() if len(s) > 1 for d in range(n_draws)])
    every = base.withColumn("_m", F.explode(each)).select(*base.columns, "_m.*").withColumn("scale", named)
    drawn = nl.random_slots(every, len(normals), F.col("scale"), F.concat(F.lit(f"{seed}"), F.col("arm"), F.col("draw").cast("string")))
    keys = ["arm", "draw"]
    template = drawn.where("part = 'fit'").groupBy(*keys, "patch").agg(F.avg("r0").cast("float").cast("double").alias("den"))
    scored = drawn.where("part <> 'fit'").join(template, [*keys, "patch"])
    per = sl.slot_auc(scored, ["r0", "den"], [*keys, "bag_id"], size="n_rows")
    means = per.groupBy(*keys).agg(*[F.avg(F.when(F.col("slot") == i, F.col("auc"))).alias(n) for i, n in enumerate(("auc", "denominator"))])
    out = scales.select("arm", "scale", "computable").join(means, "arm", "left")
    return out.withColumn("skill", (F.col("auc") - F.col("denominator")) / (1 - F.col("denominator")))


def alignment_report(rows: DataFrame, slots: Sequence[str], size: str) -> DataFrame:
    """One (metric, value) row per number of the alignment protocol."""
    fit, test = rows.where("part = 'fit'"), rows.where("part <> 'fit'")
    frozen = al.assignment(al.affinity(fit, slots))
    parts = [al.apply_assignment(al.affinity(test, slots), frozen).select("mean_assigned_affinity", "chance_affinity", "lift_over_chance"),
             al.purity(test, slots).select("purity", "nmi"),
             al.consistency(test, slots).agg(F.avg("rate").alias("mean_consistency")),
             al.redundancy(test, slots).select("mean_pairwise_cosine"),
             sl.localisation_summary(test, slots, 1, size).select("dice", "iou", "instance_auc", "avg_precision")]
    out = None
    for p in parts:
        one = p.unpivot([], [F.col(c).cast("double").alias(c) for c in p.columns], "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def probe_gate(model, fit: DataFrame, rest: DataFrame, vector: str, n_patch: int, bound: float) -> DataFrame:
    """Score with the fitted probe, fit the probe's own in-plane template, compare on three axes."""
    from ..operators import pooling as pl
    a, b = pl.probe_scores(model, fit, vector), pl.probe_scores(model, rest, vector)
    tiled = tp.tile(b, tp.global_template(a, F.col("score"))).withColumn("template", F.col("template").cast("double"))
    each = F.array(F.struct(F.lit("probe").alias("scorer"), F.col("score").alias("s")),
                   F.struct(F.lit("template").alias("scorer"), F.col("template").alias("s")))
    kept = ["bag_id", "slice", "n_slices", "target"]
    long = tiled.withColumn("_e", F.explode(each)).select(*kept, "_e.scorer", F.col("_e.s").alias("score"))
    ax = rk.axes(long, n_patch, ["scorer", "bag_id"])
    wide = ax.groupBy("scorer").agg(*[F.avg(c).alias(c) for c in AXES], F.count(F.lit(1)).alias("n_bags"))
    den = wide.where("scorer = 'template'").select("flat").scalar()
    out = wide.withColumn("_d", den)
    out = out.withColumn("skill", es.skill(F.col("flat"), F.col("_d"))).drop("_d")
    return out.withColumn("clears", F.col("skill") > bound)
