"""Fingerprints, amendment chains, stamps, gates and blinding over tables of artefacts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import attach, positions, running

HEX16 = "^[0-9a-f]{16}$"
RANGE = 1 << 16  # sequence numbers that are numbered together


def canonical_hash(columns: Sequence[str]) -> Column:
    """First 16 hex digits of the SHA-256 of the row as JSON with sorted keys."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(16))


def table_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: exclusive-or of the rows' hashes, with the row count."""
    part = F.conv(F.left(canonical_hash(columns), F.lit(15)), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.bit_xor(part).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def verify_hashes(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """ok / missing / unrecorded / mismatch for each declared item."""
    both = declared.select(key, F.col("hash").alias("_d")).join(
        found.select(key, F.col("hash").alias("_f"), F.lit(True).alias("_there")), key, "left")
    status = (F.when(F.col("_there").isNull(), "missing").when(F.col("_d").isNull(), "unrecorded")
              .when(F.col("_d") == F.col("_f"), "ok").otherwise("mismatch"))
    return both.select(key, status.alias("status"))


def chain_check(chain: DataFrame) -> DataFrame:
    """Each amendment with ``ok``, ``gap``, ``not_hex`` or ``no_kind``.

    The next entry is the one that follows in order of ``seq``, so a removed entry shows as a gap. Entries are numbered within
    ranges of ``seq``, and neighbours meet by number: no window runs over the whole chain.
    """
    rows = chain.withColumn("_all", F.lit(0)).withColumn("_range", F.floor(F.col("seq") / F.lit(RANGE)))
    numbered = positions(rows, ["_all"], ["_range"], ["seq", "before", "after"], "_place")
    nxt = numbered.select((F.col("_place") - 1).alias("_place"), F.col("before").alias("_next"))
    both = numbered.join(nxt, "_place", "left")
    bad_hex = ~F.coalesce(F.col("before").rlike(HEX16) & F.col("after").rlike(HEX16), F.lit(False))
    status = (F.when(bad_hex, "not_hex").when(F.col("kind").isNull(), "no_kind")
              .when(F.col("_next").isNotNull() & (F.col("_next") != F.col("after")), "gap").otherwise("ok"))
    return both.select("seq", status.alias("status"))


def place_stamps(stamps: DataFrame, chain: DataFrame, spread: str) -> DataFrame:
    """Stamps as current / superseded / unknown, with the number of later changes.

    The chain's states are its first ``before`` and every ``after``; a stamp takes the earliest
    place its hash has.
    """
    changed = (F.col("before") != F.col("after")).cast("bigint")
    states = chain.select(F.col("seq").alias("at"), F.col("after").alias("hash"), changed.alias("changed"))
    start = chain.agg(F.min_by("before", "seq").alias("hash"), (F.min("seq") - 1).alias("at"))
    every = states.unionByName(start.withColumn("changed", F.lit(0).cast("bigint")))
    cum = running(every.withColumn("_at", F.col("at").cast("double")).withColumn("_all", F.lit(0)), ["_all"], "_at",
                  ["changed"])
    later = F.col("all_changed") - F.col("before_changed") - F.col("changed")
    place = cum.groupBy("hash").agg(F.min_by(later, "at").alias("n_later"))
    current = chain.agg(F.max_by("after", "seq")).scalar()
    both = attach(stamps, place, ["hash"], spread, how="left").withColumn("_now", current)
    status = (F.when(F.col("hash") == F.col("_now"), "current").when(F.col("n_later").isNull(), "unknown")
              .otherwise("superseded"))
    return both.withColumn("status", status).drop("_now")


def require(df: DataFrame, config: DataFrame, key: str, value: str, spread: str) -> DataFrame:
    """Strict lookup: a key absent from the configuration is an error, there is no default."""
    both = attach(df, config.select(key, value), [key], spread, how="left")
    bad = F.raise_error(F.concat(F.lit("undeclared parameter "), F.col(key).cast("string")))
    return both.withColumn(value, F.when(F.col(value).isNull(), bad.cast(config.schema[value].dataType)).otherwise(F.col(value)))


def blind_code(name: Column, salt: str) -> Column:
    """Pseudonym: salted SHA-256 prefix (a salted hash, not a keyed MAC)."""
    return F.concat(F.lit("ARM-"), F.upper(F.left(F.sha2(F.concat(F.lit(salt), name), 256), F.lit(6))))


def blind_key(names: DataFrame, name: str, salt: str) -> DataFrame:
    """(name, code, n_same_code); a code held by several names must not be used."""
    coded = names.select(name).distinct().withColumn("code", blind_code(F.col(name), salt))
    n = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n_same_code"))
    return coded.join(n, "code").select(name, "code", "n_same_code")


def blind(df: DataFrame, key: DataFrame, arm: str, texts: Sequence[str] = (), inverse: bool = False) -> DataFrame:
    """``df`` with arm names replaced by codes in ``arm`` and inside ``texts`` (tags, specs), or back again with ``inverse``.

    ``key`` has ``name``, ``code`` and optionally ``blind``; a name that is not to be blinded keeps itself. A code that several
    names share, or a name that the key lacks, is an error.
    """
    shown = F.coalesce(F.col("blind"), F.lit(True)) if "blind" in key.columns else F.lit(True)
    used = key.select(F.col("name").alias("_name"), F.when(shown, F.col("code")).otherwise(F.col("name")).alias("_code"))
    shared = used.groupBy("_code").agg(F.count(F.lit(1)).alias("_same"))
    used = used.join(shared, "_code")
    old, new = ("_code", "_name") if inverse else ("_name", "_code")
    both = df.join(used, df[arm] == used[old], "left")
    bad = F.when(F.col(new).isNull(), F.raise_error(F.concat(F.lit("no blinding key for "), F.col(arm))).cast("string")).when(
        F.col("_same") > 1, F.raise_error(F.concat(F.lit("several names share "), F.col("_code"))).cast("string")).otherwise(F.col(new))
    out = both.withColumn(new, bad)
    for c in texts:
        out = out.withColumn(c, F.replace(F.col(c), F.col(old), F.col(new)))
    return out.withColumn(arm, F.col(new)).drop("_name", "_code", "_same")


def gate(declared: DataFrame, found: DataFrame, key: str, current: str, role: str) -> DataFrame:
    """Each declared input as usable, ABSENT or UNTRUSTED, with the first reason that applies.

    ``found`` has ``hash``, ``role`` and ``dirty``.
    """
    both = declared.join(found.withColumn("_there", F.lit(True)), key, "left")
    reason = (F.when(F.col("_there").isNull(), "missing").when(F.col("hash").isNull(), "no stamp")
              .when(F.col("hash") != F.lit(current), "wrong lineage")
              .when(F.col("role").isNull() | (F.col("role") != F.lit(role)), "wrong role")
              .when(F.col("dirty"), "dirty tree"))
    out = both.withColumn("reason", reason)
    kind = (F.when(F.col("reason").isNull(), "usable").when(F.col("reason") == "missing", "ABSENT").otherwise("UNTRUSTED"))
    return out.withColumn("kind", kind).drop("_there")


def gate_groups(gated: DataFrame, group: str) -> DataFrame:
    """A group is void if any member is untrusted, absent if nothing is usable."""
    any_bad = F.max((F.col("kind") == "UNTRUSTED").cast("int")) == 1
    any_ok = F.max((F.col("kind") == "usable").cast("int")) == 1
    return gated.groupBy(group).agg(
        F.when(any_bad, "VOID").when(any_ok, "usable").otherwise("NOT_RUN").alias("state"),
        F.sum((F.col("kind") == "usable").cast("bigint")).alias("n_usable"), F.count(F.lit(1)).alias("n_declared"))


def stored_agreement(ours: DataFrame, stored: DataFrame, on: Sequence[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Recomputed against stored values; a difference beyond ``tol`` or a missing row is an error."""
    both = ours.select(*on, F.col(value).alias("ours")).join(stored.select(*on, F.col(value).alias("stored")), list(on), "left")
    bad = F.raise_error(F.concat(F.lit("stored value differs: "), *[F.col(c).cast("string") for c in on]))
    same = F.coalesce(F.abs(F.col("ours") - F.col("stored")) <= tol, F.lit(False))
    return both.withColumn("agrees", F.when(same, F.lit(True)).otherwise(bad.cast("boolean")))


def diff_tables(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """only_left / only_right / changed / same per key."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full")
    status = (F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right")
              .when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed"))
    return both.select(key, status.alias("status"))


def constant_across(df: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-9) -> DataFrame:
    """A reference line must not move between tags."""
    out = df.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"),
                                (F.max(value) - F.min(value)).alias("_r"))
    bad = F.raise_error(F.lit("reference differs between tags")).cast("double")
    return out.withColumn(value, F.when(F.col("_r") > tol, bad).otherwise(F.col(value))).drop("_r")
