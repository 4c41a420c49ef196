"""Building blocks that keep one hot group from landing in one task.

Three ideas are used throughout the library:

* running totals inside a group go through monotone *buckets*: totals per bucket, a prefix over
  the (few) buckets, then an exact window inside one bucket;
* a join of a large table with one row per group is *salted*, so that a hot group is spread;
* sums whose ties matter are taken over integers, so that the order of addition is moot.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20   # a group up to this size is ranked by a single window
PER_OCTAVE = 4096    # buckets between two powers of two
SALTS = 32


def clean(value: Column) -> Column:
    """NaN becomes NULL; Spark would otherwise rank it largest and spread it through sums."""
    value = value.cast("double")
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def exact_total(value: Column, window=None) -> Column:
    """Sum that does not depend on the order of the rows, as a double.

    Each value is cut into three integers (units of 2**-20, 2**-52 and 2**-84) that are summed as BIGINT, so a sum of one value is that value.
    Values up to 2**34 in groups up to 2**9 rows, or smaller values in larger groups, never
    overflow; beyond, the ANSI cast fails rather than giving a wrong sum.
    """
    scaled = value.cast("double") * F.lit(1048576.0)
    high = F.rint(scaled)
    rest = (scaled - high) * F.lit(4294967296.0)
    low = F.rint(rest)
    parts = [F.sum(c.cast("bigint")) for c in (high, low, F.rint((rest - low) * F.lit(4294967296.0)))]
    if window is not None:
        parts = [c.over(window) for c in parts]
    fine = parts[1].cast("double") + parts[2].cast("double") / F.lit(4294967296.0)
    return (parts[0].cast("double") + fine / F.lit(4294967296.0)) / F.lit(1048576.0)


def exact_mean(value: Column) -> Column:
    """Mean of a group of bounded size, whatever the order of its rows and the scale of its values.

    The values are added in sorted order, so equal sets of values have equal means; tiny, huge and infinite ones count as
    they are. Only for groups whose rows are bounded by a parameter, such as the patches of a slice.
    """
    values = F.sort_array(F.collect_list(value.cast("double")))
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.count(value)


def score_bucket(value: Column) -> Column:
    """BIGINT that never decreases as ``value`` grows: exponent and leading mantissa.

    It is a function of the value alone, so two evaluations always agree. Between one half and one the distance to one is
    bucketed instead, so saturated probabilities keep apart; infinities take the outermost buckets.
    """
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(size))
    mantissa = F.floor((size / F.pow(F.lit(2.0), power) - 1) * F.lit(PER_OCTAVE))
    plain = (power + F.when(size < 1, F.lit(1001)).otherwise(F.lit(1061))) * F.lit(PER_OCTAVE) + mantissa
    left = F.lit(1.0) - size
    depth = F.floor(F.log2(left))
    near_one = (F.lit(999) - depth) * F.lit(PER_OCTAVE) + F.floor((F.lit(2.0) - left / F.pow(F.lit(2.0), depth)) * F.lit(PER_OCTAVE - 1))
    code = F.when(size == float("inf"), F.lit(2200 * PER_OCTAVE)).when((size >= 0.5) & (size < 1), near_one).otherwise(plain)
    signed = F.when(value < 0, -code).otherwise(code)
    return F.when(size < 1e-300, F.lit(0)).otherwise(signed).cast("bigint")


def route(value: Column, size: Column | None, hot_rows: int = HOT_ROWS) -> Column:
    """Bucket 0 for a group known to be small, else the value's bucket."""
    if size is None:
        return score_bucket(value)
    small = F.coalesce(size <= hot_rows, F.lit(False))  # a group of unknown size is not known to be small
    return F.when(small, F.lit(0).cast("bigint")).otherwise(score_bucket(value))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A NULL in a grouping column is an error: the joins behind a group would drop its rows."""
    out = {}
    for c in columns:
        bad = F.raise_error(F.lit(f"NULL in {c}")).cast(df.schema[c].dataType)
        out[c] = F.coalesce(F.col(c), bad)
    return df.withColumns(out) if out else df


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt: Column,
                how: str = "inner", salts: int = SALTS, size: str | None = None,
                per_copy: int = 4096) -> DataFrame:
    """Equi-join of many rows per key with few rows per key, hot keys spread over copies.

    ``salt`` must vary inside a key of the large side. With ``size``, a column of both sides that
    grows with the key's rows (such as ``n_slices``), ordinary keys keep a single copy and only
    large ones are copied; without it every row of the small side is copied ``salts`` times. An unknown size means one copy.
    Spark still turns this into a broadcast join on its own when the measured size allows it.
    """
    if size:
        copies = F.coalesce(F.least(F.lit(salts), 1 + F.floor(F.col(size) / F.lit(per_copy))), F.lit(1)).cast("int")
        small = small.withColumnRenamed(size, "_size")
        left = big.withColumn("_salt", F.pmod(salt.cast("bigint"), copies).cast("int"))
        right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.least(
            F.lit(salts), 1 + F.floor(F.col("_size") / F.lit(per_copy))), F.lit(1)).cast("int") - 1)))
        return left.join(right, [*on, "_salt"], how).drop("_salt", "_size")
    copies = F.lit(salts)
    left = big.withColumn("_salt", F.pmod(salt.cast("bigint"), copies).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def positions(df: DataFrame, keys: Sequence[str], bucket: Sequence[str], order: Sequence[str],
              name: str = "pos", total: str | None = None) -> DataFrame:
    """Number the rows of each group from 0, ordered by ``bucket`` and then ``order``.

    The bucket columns lead the order and take few values per group, so the only window over a
    whole group runs on bucket counts.
    """
    keys, bucket, order = list(keys), list(bucket), list(order)
    df = require(df, [*keys, *bucket])
    counts = df.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("_count"))
    before = W.partitionBy(*keys).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start")]
    if total:
        columns.append(F.sum("_count").over(W.partitionBy(*keys)).alias(total))
    starts = counts.select(*keys, *bucket, *columns)
    inside = W.partitionBy(*keys, *bucket).orderBy(*order)
    ranked = df.withColumn("_nth", F.row_number().over(inside))
    return (ranked.join(starts.hint("merge"), [*keys, *bucket])  # ranked is dealt and sorted so; the driver gathers no starts
            .withColumn(name, (F.col("_start") + F.col("_nth") - 1).cast("bigint"))
            .drop("_start", "_nth"))


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows of groups up to ``hot_rows`` and rows of larger ones, by counted size.

    Only the keys of large groups are broadcast, at most one for every ``hot_rows`` rows. A NULL key is an error.
    """
    df = require(df, keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    return df.join(F.broadcast(hot), list(keys), "left_anti"), df.join(F.broadcast(hot), list(keys), "left_semi")


def positions_in_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """``positions`` of groups small enough for one task: one exchange by ``keys``, which later windows that hold them share."""
    whole = W.partitionBy(*keys)
    out = df.withColumn(name, (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"))
    return out.withColumn(total, F.count(F.lit(1)).over(whole)) if total else out


def hashed_positions(df: DataFrame, keys: Sequence[str], hash_column: str,
                     order: Sequence[str] = (), name: str = "ix",
                     total: str | None = None) -> DataFrame:
    """``positions`` in the order of a hex hash column, bucketed by its first three digits."""
    lead = df.withColumn("_lead", F.substring(hash_column, 1, 3))
    return positions(lead, keys, ["_lead"], [hash_column, *order], name, total).drop("_lead")


def prefix_sums(df: DataFrame, order: str, value: Column, name: str, block: int = 4096) -> DataFrame:
    """Add ``name``: the total of ``value`` over all rows with a smaller ``order``, an integer that no two rows share.

    The orders are cut into blocks, blocks into blocks of blocks, as many levels as the range from the smallest to the
    largest needs. A window sees at most ``block`` rows, whatever the table's size; a sparse range costs levels, not rows.
    A NULL order is an error, a NULL value counts as nothing.
    """
    df = require(df, [order])
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    rows = df.withColumn("_at", F.col(order).cast("bigint") - F.lit(low).cast("bigint")).withColumn("_value", F.coalesce(value.cast("bigint"), F.lit(0)))
    return _levels(rows, int(high) - int(low), block).withColumnRenamed("_before", name).drop("_at", "_value")


def _levels(rows: DataFrame, span: int, block: int) -> DataFrame:
    """``rows`` with ``_before``, the sum of ``_value`` over rows with a smaller ``_at``, which goes from 0 to ``span``."""
    grouped = rows.withColumn("_group", F.expr(f"_at div {block}"))  # whole numbers throughout: ids beyond 2**53 keep their order
    inside = W.partitionBy("_group").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    local = grouped.withColumn("_before", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    if span < block:
        return local.drop("_group")
    totals = grouped.groupBy(F.col("_group").alias("_at")).agg(F.sum("_value").alias("_value"))
    above = _levels(totals, span // block, block).select(F.col("_at").alias("_group"), F.col("_before").alias("_base"))
    return local.join(above, "_group").withColumn("_before", F.col("_base") + F.col("_before")).drop("_group", "_base")


def running(hist: DataFrame, keys: Sequence[str], score: str, sums: Sequence[str],
            descending: bool = False, size: str | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``before_<c>`` and ``all_<c>`` to a histogram with one row per (keys, score).

    ``before_<c>`` is the total of ``c`` over the rows of the group ahead of this one.
    """
    keys = list(keys)
    hist = require(hist, [*keys, score])
    bucketed = hist.withColumn("_b", route(F.col(score), F.col(size) if size else None, hot_rows))
    # the join below implies this filter on one side; stated here, both sides read one exchange
    for c in [*keys, "_b"]:
        bucketed = bucketed.where(F.col(c).isNotNull())
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    lead = F.col("_b").desc() if descending else F.col("_b").asc()
    ahead = W.partitionBy(*keys).orderBy(lead).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    step = F.col(score).desc() if descending else F.col(score).asc()
    inside = (W.partitionBy(*keys, "_b").orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    local = bucketed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}")
                                   for c in sums])
    joined = local.join(offsets, [*keys, "_b"])
    for c in sums:
        joined = joined.withColumn(f"before_{c}", F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return joined.drop("_b", *[f"_{k}_{c}" for k in "lo" for c in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per group without gathering a group in one task."""
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, names).drop("_all")
    keys = list(keys)
    hist = (df.withColumn("_v", clean(F.col(value))).where(F.col("_v").isNotNull())
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m")))
    cum = running(hist, keys, "_v", ["_m"])
    cols = []
    for p, name in zip(probs, names):
        at = (F.col("all__m") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        # the k-th smallest value is the largest one with fewer than k + 1 rows ahead of it
        cols += [F.max(F.when(F.col("before__m") <= low, F.col("_v"))).alias(f"_l_{name}"),
                 F.max(F.when(F.col("before__m") <= high, F.col("_v"))).alias(f"_h_{name}"),
                 F.max(at - low).alias(f"_w_{name}")]
    out = cum.groupBy(*keys).agg(*cols)
    return out.select(*keys, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_w_{n}"))
                               .alias(n) for n in names])


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str = "pos",
           how: str = "inner") -> DataFrame:
    """``salted_join`` with a salt hashed from a column that varies inside the key."""
    return salted_join(big, small, on, F.xxhash64(spread), how, salts=8)
