"""Null models: what a score is worth when it knows nothing of the target."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..session import pin
from .scale import HOT_ROWS, hashed_positions, salted_join


def length_of(df: DataFrame, n_patch: int, rows: str = "n_rows", slices: str = "n_slices") -> Column:
    """Instances of a row's bag: its true count where the table carries one, else whole slices."""
    return F.col(rows) if rows in df.columns else F.col(slices) * F.lit(n_patch)


def roll_targets(df: DataFrame, n_patch: int, seed: int, reps: int = 1) -> DataFrame:
    """(rep, bag_id, pos, target): each bag's target shifted circularly by 1..n-1 positions.

    The shift is a function of (seed, rep, bag), so a row is re-keyed on its own.
    """
    n = length_of(df, n_patch)
    shift = F.lit(1) + draws.draw(seed, F.col("rep"), F.col("bag_id")) % F.greatest(n - 1, F.lit(1))
    return (df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
            .select("rep", "bag_id", ((F.col("pos") + shift) % n).alias("pos"), "target"))


def replace_target(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores under another target, once per replicate; (bag, position) is unique."""
    return scores.drop("target", "slice_pos").join(targets, ["bag_id", "pos"])


def donor_map(bags: DataFrame, seed: int, reps: int = 1) -> DataFrame:
    """(rep, bag_id, n_slices, donor_id, donor_slices): a random derangement; with ``n_rows`` also the true counts of both.

    Two independent shuffled orders pair every bag with the one at its place in the other: a uniform permutation. The bags
    that meet themselves, one a replicate on average, are repaired: several hand their targets round among themselves, a
    single one trades donors with the bag at the next place. Neither makes a new fixed point, so with two bags or more no bag is
    its own donor; a single bag keeps itself.
    """
    sizes = [c for c in ("n_slices", "n_rows") if c in bags.columns]
    of_donor = {"n_slices": "donor_slices", "n_rows": "donor_rows"}
    drawn = bags.select("bag_id", *sizes).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def order(*salt, **names):
        keyed = drawn.withColumn("_h", draws.order_key(seed, F.col("rep"), F.col("bag_id"), *salt))
        return hashed_positions(keyed, ["rep"], "_h", ["bag_id"], name="ix", **names).drop("_h")

    donors = order("donor").select("rep", "ix", F.struct(F.col("bag_id").alias("donor_id"), *[F.col(c).alias(of_donor[c]) for c in sizes]).alias("donor"))
    drawn_pairs = pin(order(total="size").join(donors, ["rep", "ix"]))
    own = F.struct(F.col("bag_id").alias("donor_id"), *[F.col(c).alias(of_donor[c]) for c in sizes])
    fixed = drawn_pairs.where((F.col("bag_id") == F.col("donor.donor_id")) & (F.col("size") > 1))
    fixed = fixed.withColumn("_h", draws.order_key(seed, F.col("rep"), F.col("bag_id")))
    fixed = hashed_positions(fixed.select("rep", "bag_id", "ix", "size", own.alias("self"), "_h"), ["rep"], "_h", ["bag_id"], name="nth", total="n_fixed").drop("_h")
    round_ = (fixed.where("n_fixed > 1").withColumn("nth", (F.col("nth") + 1) % F.col("n_fixed")).select("rep", "bag_id", "nth")
              .join(fixed.select("rep", "nth", F.col("self").alias("repaired")), ["rep", "nth"]).select("rep", "bag_id", "repaired"))
    alone = fixed.where("n_fixed = 1").select("rep", ((F.col("ix") + 1) % F.col("size")).alias("ix"), F.col("bag_id").alias("_fixed"), "self")
    traded = drawn_pairs.select("rep", "ix", "bag_id", "donor").join(alone, ["rep", "ix"])
    trades = traded.select("rep", F.explode(F.array(F.struct(F.col("_fixed").alias("bag_id"), F.col("donor").alias("repaired")),
                                                    F.struct("bag_id", F.col("self").alias("repaired")))).alias("_t")).select("rep", "_t.*")
    out = drawn_pairs.join(round_.unionByName(trades), ["rep", "bag_id"], "left").withColumn("donor", F.coalesce("repaired", "donor"))
    return out.select("rep", "bag_id", *sizes, "donor.donor_id", *[F.col(f"donor.{of_donor[c]}") for c in sizes])


def _between_small(donors: DataFrame, limit: int) -> Column:
    """Both bags of a request are known to be small."""
    return F.coalesce((F.col("n_slices") <= limit) & (F.col("donor_slices") <= limit), F.lit(False))


def shuffle_targets(df: DataFrame, donors: DataFrame, n_patch: int, tiles: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rep, bag_id, pos, target) with the donor's target cropped or tiled to length.

    Between two bags of up to ``hot_rows`` rows and without a gap the donor's targets travel as one array a request, which the task of
    the request lays out. All others are joined row by row.
    """
    limit = max(hot_rows // n_patch, 0)
    cells = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "target")))
    held = df.where(F.col("n_slices") <= limit).groupBy("bag_id").agg(cells.alias("_c")).where(F.element_at("_c", -1)["pos"] == F.size("_c") - 1)
    whole = donors.join(held.select("bag_id", F.size("_c").alias("_own")), "bag_id", "left")
    given = held.select(F.col("bag_id").alias("donor_id"), F.transform("_c", lambda c: c["target"]).alias("_given"))
    ready = F.col("_own").isNotNull() & F.col("_given").isNotNull() & _between_small(donors, limit)
    asked = whole.join(given, "donor_id", "left").withColumn("_ready", ready)
    length = length_of(donors, n_patch, "donor_rows", "donor_slices").cast("int")
    laid = F.transform(F.sequence(F.lit(0), F.col("_own") - 1), lambda p: F.when(
        p % length < F.size("_given"), F.struct(p.cast("bigint").alias("pos"), F.get("_given", p % length).alias("target"))))
    out = asked.where("_ready").select("rep", "bag_id", F.explode(laid).alias("_l")).where("_l IS NOT NULL")
    out = out.select("rep", "bag_id", F.col("_l.pos").cast(df.schema["pos"].dataType).alias("pos"), F.col("_l.target").alias("target"))
    rest = pin(asked.where("NOT _ready").select(*donors.columns))
    return out if rest.isEmpty() else out.unionByName(_shuffled_rows(df, rest, n_patch, tiles))


def _shuffled_rows(df: DataFrame, donors: DataFrame, n_patch: int, tiles: int) -> DataFrame:
    """``shuffle_targets`` row by row.

    A long bag with a short donor asks for the same donor row many times; donor rows are copied
    up to ``tiles`` times and the copies share the requests.
    """
    copies = F.least(F.ceil(F.col("n_slices") / F.col("donor_slices")), F.lit(tiles)).cast("int")
    wanted = donors.withColumn("copies", copies)
    source = salted_join(
        df.select(F.col("bag_id").alias("donor_id"), F.col("n_slices").alias("donor_slices"),
                  F.col("pos").alias("donor_pos"), "target"),
        wanted.select("rep", "donor_id", "donor_slices", "bag_id", "copies"), ["donor_id"], F.col("donor_pos"),
        size="donor_slices")
    source = source.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    length = length_of(donors, n_patch, "donor_rows", "donor_slices")
    asked = salted_join(df.select("bag_id", "n_slices", "pos"),
                        wanted.select("rep", "bag_id", "n_slices", *[c for c in ("donor_slices", "donor_rows") if c in donors.columns], "copies"), ["bag_id"],
                        F.col("pos"), size="n_slices")
    asked = (asked.withColumn("donor_pos", F.col("pos") % length)
             .withColumn("copy", (F.floor(F.col("pos") / length) % F.col("copies")).cast("int")))
    return (asked.join(source.select("rep", "bag_id", "donor_pos", "copy", "target"),
                       ["rep", "bag_id", "donor_pos", "copy"])
            .select("rep", "bag_id", "pos", "target"))


def roll_positives(df: DataFrame, n_patch: int, seed: int, reps: int = 1) -> DataFrame:
    """(rep, bag_id, pos) of the positives of ``roll_targets``, without moving any other row."""
    return roll_targets(df.where(F.col("target") > 0), n_patch, seed, reps).drop("target")


def shuffle_positives(df: DataFrame, donors: DataFrame, n_patch: int) -> DataFrame:
    """(rep, bag_id, pos) of the positives of ``shuffle_targets``: each donor's positives, cropped or tiled to length."""
    given = df.where(F.col("target") > 0).select(F.col("bag_id").alias("donor_id"), F.col("pos").alias("donor_pos"), F.col("n_slices").alias("_size"))
    moved = salted_join(given, donors.withColumn("_size", F.col("donor_slices")), ["donor_id"], F.col("donor_pos"), size="_size")
    length, wide = length_of(donors, n_patch, "donor_rows", "donor_slices"), length_of(donors, n_patch)
    tiles = F.floor((wide - 1 - F.col("donor_pos")) / length)
    copies = F.when(tiles >= 0, F.sequence(F.lit(0).cast("bigint"), tiles))
    return moved.withColumn("_tile", F.explode(copies)).select("rep", "bag_id", (F.col("donor_pos") + F.col("_tile") * length).alias("pos"))


def lists_of_positives(df: DataFrame) -> DataFrame:
    """(bag_id, positives): the sorted positions of every bag's positives. For bags of a bounded size."""
    return df.where(F.col("target") > 0).groupBy("bag_id").agg(F.sort_array(F.collect_set(F.col("pos").cast("int"))).alias("positives"))


def roll_lists(df: DataFrame, n_patch: int, seed: int, reps: int = 1) -> DataFrame:
    """(rep, bag_id, positives) of ``roll_positives``, one row a bag and replicate. For bags of a bounded size."""
    held = df.where(F.col("target") > 0).groupBy("bag_id").agg(F.collect_set(F.col("pos").cast("bigint")).alias("_at"), F.max(length_of(df, n_patch)).alias("_n"))
    held = held.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    shift = F.lit(1) + draws.draw(seed, F.col("rep"), F.col("bag_id")) % F.greatest(F.col("_n") - 1, F.lit(1))
    return held.withColumn("_by", shift).select("rep", "bag_id", F.transform("_at", lambda x: ((x + F.col("_by")) % F.col("_n")).cast("int")).alias("positives"))


def shuffle_lists(df: DataFrame, donors: DataFrame, n_patch: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rep, bag_id, positives) of ``shuffle_positives``, one row a request, and the donors of the requests left to it.

    Lists serve requests between two bags of up to ``hot_rows`` rows, so a replicate moves one row a bag in place of one a positive.
    """
    limit = max(hot_rows // n_patch, 0)
    given = lists_of_positives(df.where(F.col("n_slices") <= limit)).withColumnRenamed("bag_id", "donor_id")
    length, wide = (x.cast("int") for x in (length_of(donors, n_patch, "donor_rows", "donor_slices"), length_of(donors, n_patch)))
    moved = donors.where(_between_small(donors, limit)).join(given, "donor_id")
    tiled = F.flatten(F.transform(F.filter("positives", lambda x: x < wide), lambda x: F.sequence(x, wide - 1, length)))
    return moved.select("rep", "bag_id", tiled.alias("positives")), donors.where(~_between_small(donors, limit))


def every_replicate(per: DataFrame, bags: DataFrame, reps: int) -> DataFrame:
    """``per`` (rep, bag_id, n_pos, auc) with a row for each bag and replicate; a bag without a positive has none to rank."""
    whole = bags.select("bag_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return (whole.join(per, ["rep", "bag_id"], "left").select("rep", "bag_id", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), "auc"))


def random_slots(df: DataFrame, k: int, scale, seed, bias: Sequence | None = None,
                 prefix: str = "r") -> DataFrame:
    """Random attention over ``k`` slots per instance, normalised over slots, as FLOAT.

    Row-local: no shuffle. ``bias`` adds a persistent preference per slot.
    """
    bias = [b if isinstance(b, Column) else F.lit(float(b)) for b in (bias or [0.0] * k)]
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    out = df
    for j in range(k):
        logit = draws.normal(seed, F.col("bag_id"), F.col("pos"), j) * scale
        out = out.withColumn(f"_l{j}", logit + bias[j])
    top = F.greatest(*[F.col(f"_l{j}") for j in range(k)]) if k > 1 else F.col("_l0")
    out = out.withColumn("_top", top)
    for j in range(k):
        out = out.withColumn(f"_e{j}", F.exp(F.col(f"_l{j}") - F.col("_top")))
    total = sum((F.col(f"_e{j}") for j in range(1, k)), F.col("_e0"))
    out = out.withColumn("_sum", total)
    for j in range(k):
        out = out.withColumn(f"{prefix}{j}", (F.col(f"_e{j}") / F.col("_sum")).cast("float")
                             .cast("double"))
    return out.drop("_top", "_sum", *[f"_{c}{j}" for c in "le" for j in range(k)])


def instance_entropy(slots: Sequence[str]):
    """Entropy over the slots of one instance."""
    held = [F.greatest(F.col(s), F.lit(1e-12)) for s in slots]
    total = sum(held[1:], held[0])
    terms = [h / total * F.log(h / total) for h in held]
    return -sum(terms[1:], terms[0])


def slot_entropy(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    return df.agg(F.avg(instance_entropy(slots)).alias("slot_entropy"),
                  F.count(F.lit(1)).alias("n_instances"))


def match_scale(probe: DataFrame, normals: Sequence[str], target: DataFrame, lo: float = 1e-3,
                hi: float = 30.0, rounds: int = 10, points: int = 16) -> DataFrame:
    """Logit scale whose random attention has the entropy in ``target`` (one row).

    Entropy falls as the scale grows, so the bracket is narrowed by a grid of scales per round
    instead of one point at a time; each round is one aggregation of the probe rows over the
    grid, and the bracket stays a one-row table.
    """
    bracket = target.select(F.col("slot_entropy").alias("goal"), F.lit(lo).alias("lo"),
                            F.lit(hi).alias("hi"))
    rows = probe.select(*normals)
    for _ in range(rounds):
        state = bracket.select(F.struct("lo", "hi", "goal")).scalar()
        steps = F.sequence(F.lit(0), F.lit(points))
        tried = rows.withColumn("_s", state).withColumn(
            "scale", F.explode(F.transform(steps, lambda i: F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo"))
                                           * i / F.lit(points))))
        top = F.greatest(*[F.col(c) * F.col("scale") for c in normals])
        expo = [F.exp(F.col(c) * F.col("scale") - top) for c in normals]
        total = sum(expo[1:], expo[0])
        terms = [e / total * F.log(F.greatest(e / total, F.lit(1e-12))) for e in expo]
        ent = -sum(terms[1:], terms[0])
        curve = tried.groupBy("scale").agg(F.avg(ent).alias("entropy"), F.max("_s.goal").alias("goal"))
        above = F.when(F.col("entropy") > F.col("goal"), F.col("scale"))
        below = F.when(F.col("entropy") <= F.col("goal"), F.col("scale"))
        bracket = curve.groupBy("goal").agg(
            F.coalesce(F.max(above), F.min("scale")).alias("lo"),
            F.coalesce(F.min(below), F.max("scale")).alias("hi"))
    return bracket.select(((F.col("lo") + F.col("hi")) / 2).alias("scale"), "goal")


def match_scales(targets: DataFrame, keys: Sequence[str], probe: DataFrame, normals: Sequence[str], lo: float = 1e-3, hi: float = 30.0,
                 rounds: int = 10, points: int = 16) -> DataFrame:
    """(keys, slot_entropy, scale, achieved, computable): ``match_scale`` for any number of keys at once, a bracket row per key.

    ``probe`` is a sample of normals of a fixed, declared size, held as one array; every round each key tries its own grid of scales on it, row by row. One slot
    has no entropy to match: with a single normal, or without a target, the scale is NULL and the key is not computable.
    """
    keys = list(keys)
    held = probe.agg(F.collect_list(F.array(*normals))).scalar()
    able = F.col("slot_entropy").isNotNull() & F.lit(len(normals) > 1)
    now = targets.select(*keys, "slot_entropy", able.alias("computable"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")).withColumn("_p", held)

    def entropy(scale):
        def one(z):
            top = F.array_max(F.transform(z, lambda x: x * scale))
            e = F.transform(z, lambda x: F.exp(x * scale - top))
            total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
            return F.aggregate(e, F.lit(0.0), lambda s, x: s - x / total * F.log(F.greatest(x / total, F.lit(1e-12))))
        return F.aggregate("_p", F.lit(0.0), lambda s, z: s + one(z)) / F.size("_p")
    for _ in range(rounds):
        at = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(points))
        curve = F.transform(at, lambda s: F.struct(s.alias("scale"), entropy(s).alias("h")))
        now = pin(now.withColumn("_c", F.when(F.col("computable"), curve)).select(
            *keys, "slot_entropy", "computable", "_p",
            F.coalesce(F.array_max(F.transform(F.filter("_c", lambda x: x["h"] > F.col("slot_entropy")), lambda x: x["scale"])), F.col("lo")).alias("lo"),
            F.coalesce(F.array_min(F.transform(F.filter("_c", lambda x: x["h"] <= F.col("slot_entropy")), lambda x: x["scale"])), F.col("hi")).alias("hi")))
    scale = F.when(F.col("computable"), (F.col("lo") + F.col("hi")) / 2)
    found = now.withColumn("scale", scale)
    return found.select(*keys, "slot_entropy", "scale", F.when(F.col("computable"), entropy(F.col("scale"))).alias("achieved"), "computable")


def half_precision(value):
    """The value as a 16-bit float would hold it (11-bit mantissa, round half to even)."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - 10)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value / step) * step)


def measured(rows: DataFrame, slots: Sequence[str], keys: Sequence[str], n_patch: int) -> DataFrame:
    """(keys, bag_id, slot, value, auc): lesion share and AUC of every bag and slot, row by row."""
    from . import alignment as al
    from . import slots as sl
    keys = list(keys)
    shares = al.bag_affinity(rows, slots, keys).where("finding = 0").select(*keys, "bag_id", "slot", "value")
    aucs = sl.slot_auc(rows.withColumn("n_rows", F.col("n_slices") * F.lit(n_patch)), slots, [*keys, "bag_id"], size="n_rows")
    return shares.join(aucs.select(*keys, "bag_id", "slot", "auc"), [*keys, "bag_id", "slot"], "left")


def evaluated(per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``protocol`` from (keys, part, bag_id, slot, value, auc), measured before: (keys, slot, auc, n_bags)."""
    from . import alignment as al
    keys = list(keys)
    shares = per.where("part = 'fit'").groupBy(*keys, "slot").agg(F.avg("value").alias("affinity")).withColumn("finding", F.lit(0))
    picked = per.where("part <> 'fit'").join(al.lesion_slot(shares, keys).select(*keys, "slot"), [*keys, "slot"])
    return picked.groupBy(*keys, "slot").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_bags"))


def best_of(per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``best_slot_protocol`` from (keys, part, bag_id, slot, auc), measured before."""
    keys = list(keys)
    means = per.groupBy(*keys, "part", "slot").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_bags"))
    pick = means.where(F.col("part") == "fit").groupBy(*keys).agg(F.max_by("slot", F.struct(F.col("auc"), -F.col("slot"))).alias("slot"))
    return means.where(F.col("part") != "fit").join(pick, [*keys, "slot"]).select(*keys, "slot", "auc", "n_bags")


def protocol(rows: DataFrame, slots: Sequence[str], keys: Sequence[str], n_patch: int) -> DataFrame:
    """The whole evaluation per key: fit the slot on ``part='fit'``, freeze it, score the rest.

    ``rows`` holds every null and replicate under ``keys``, so one pass serves all of them.
    Returns (keys, slot, auc, n_bags).
    """
    from . import alignment as al
    from . import slots as sl
    keys = list(keys)
    fit = rows.where(F.col("part") == "fit")
    frozen = al.lesion_slot(al.affinity(fit, slots, keys), keys)
    size = F.col("n_slices") * F.lit(n_patch)
    test = rows.where(F.col("part") != "fit").withColumn("n_rows", size)
    per = sl.slot_auc(test, slots, [*keys, "bag_id"], size="n_rows")
    picked = per.join(frozen.select(*keys, "slot"), [*keys, "slot"])
    return picked.groupBy(*keys, "slot").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_bags"))


def best_slot_protocol(rows: DataFrame, slots: Sequence[str], keys: Sequence[str],
                       n_patch: int) -> DataFrame:
    """As ``protocol``, the slot chosen by its fit-half AUC: the price of selecting."""
    from . import slots as sl
    keys = list(keys)
    sized = rows.withColumn("n_rows", F.col("n_slices") * F.lit(n_patch))
    per = sl.slot_auc(sized, slots, [*keys, "part", "bag_id"], size="n_rows")
    means = per.groupBy(*keys, "part", "slot").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_bags"))
    pick = means.where(F.col("part") == "fit").groupBy(*keys).agg(
        F.max_by("slot", F.struct(F.col("auc"), -F.col("slot"))).alias("slot"))
    return means.where(F.col("part") != "fit").join(pick, [*keys, "slot"]).select(
        *keys, "slot", "auc", "n_bags")
