"""Stamped JSON results: writing, strict reading and flattening."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def write_stamped(df: DataFrame, path: str, stamp: dict[str, str]) -> None:
    """Rows with a stamp struct; an existing result is never overwritten silently."""
    s = F.struct(*[F.lit(v).alias(k) for k, v in stamp.items()])
    df.withColumn("stamp", s).write.mode("errorifexists").json(path)


def read_artefacts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file with its name; malformed input fails at once."""
    return (spark.read.schema(schemas.ARTEFACT).option("multiLine", "true").option("mode", "FAILFAST")
            .json(paths).withColumn("file", F.input_file_name()))


def scorer_rows(artefacts: DataFrame) -> DataFrame:
    """(file, stamp, role, tag, scorer, axis, interval) from the nested results."""
    r = artefacts.select("file", "prereg", "analysis_role", F.explode("results").alias("r"))
    s = r.select("file", "prereg", "analysis_role", "r.tag", F.explode("r.scorers").alias("s"))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"s.{a}_auc").alias("ci")) for a in ("flat", "slice", "within_slice")])
    return s.select("*", F.explode(axes).alias("a")).select(
        "file", F.col("prereg.prereg_hash").alias("hash"), "analysis_role", "tag", F.col("s.scorer").alias("scorer"), "a.axis",
        "a.ci.mean", "a.ci.lo", "a.ci.hi", "a.ci.n")


def run_of(path) -> tuple:
    """Arm and seed from a result's path ``.../<arm>_seed<N>...``."""
    arm = F.regexp_extract(path, r"([A-Za-z0-9=.]+)_seed(\d+)", 1)
    return arm, F.regexp_extract(path, r"([A-Za-z0-9=.]+)_seed(\d+)", 2).cast("int")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files below ``path``, one folder ``run=<arm>_seed<N>`` a run, with arm and seed from the folder; malformed input fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    arm, seed = run_of(F.regexp_replace(F.input_file_name(), "/run=", "/"))
    return rows.withColumn("arm", arm).withColumn("seed", seed).drop("run")


def merge_results(rows: DataFrame, role: str, split_hash: str) -> DataFrame:
    """Per-run files as one table; mixed roles or split hashes are errors."""
    kinds = rows.agg(F.count_distinct(role).alias("r"), F.count_distinct(split_hash).alias("h"))
    out = rows.withColumn("_r", kinds.select("r").scalar()).withColumn("_h", kinds.select("h").scalar())
    bad = F.raise_error(F.lit("results of different roles or splits cannot be merged")).cast("boolean")
    return out.where(F.when((F.col("_r") > 1) | (F.col("_h") > 1), bad).otherwise(F.lit(True))).drop("_r", "_h")
