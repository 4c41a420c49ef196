"""Feature cache and score dumps as partitioned parquet."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..operators.scale import attach, prefix_sums
from ..session import pin


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table under its declared schema; filters and columns reach the scan."""
    return spark.read.schema(schema).parquet(path)


def scan_keys(features: DataFrame, keys: DataFrame, spread: str = "slice") -> DataFrame:
    """Rows of the chosen bags."""
    return attach(features, keys.select("bag_id").distinct(), ["bag_id"], spread)


def absent_keys(features: DataFrame, keys: DataFrame) -> DataFrame:
    """Chosen bags the cache does not have; a caller refuses to go on unless this is empty."""
    present = features.select("bag_id").distinct()
    return keys.select("bag_id").distinct().join(present, "bag_id", "left_anti")


def read_bag(features: DataFrame, bag_id) -> DataFrame:
    """One bag; the equality is pushed to the parquet scan."""
    return features.where(F.col("bag_id") == F.lit(bag_id))


def masked_keys(bags: DataFrame) -> DataFrame:
    return bags.where("has_mask").select("bag_id")


def metadata(bags: DataFrame) -> DataFrame:
    """Patient (the bag itself where unknown), label and mask flag."""
    patient = F.coalesce(F.col("patient_id").cast("string"), F.col("bag_id").cast("string"))
    return bags.select("bag_id", patient.alias("patient_id"), "label", "has_mask")


def coverage_report(bags: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bags, slices, instances and masked bags of the cache."""
    return bags.join(sizes, "bag_id", "left").agg(
        F.count(F.lit(1)).alias("n_bags"), F.count("n").alias("n_cached"), F.sum("n").alias("n_instances"),
        F.sum("n_slices").alias("n_slices"), F.sum(F.col("has_mask").cast("bigint")).alias("n_masked"))


def stored_size(files: DataFrame) -> DataFrame:
    """(n_files, n_bytes) of the files behind a scan; a file counts once, however many rows it holds."""
    each = files.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
    return each.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_bytes"))


def bag_offsets(lengths: DataFrame, block: int = 4096) -> DataFrame:
    """Prefix sums of the bag lengths in ``bag_ix`` order: column ``start``. No window sees more than ``block`` bags or blocks."""
    return prefix_sums(lengths, "bag_ix", F.col("length"), "start", block)


def unflatten(flat: DataFrame, lengths: DataFrame, block: int = 4096) -> DataFrame:
    """Cut a flat array into bags by the prefix sums of the bag lengths.

    ``flat`` has ``ix`` (0-based). The range lookup is an equality join on blocks of ``block``
    positions, so a long bag is cut over many blocks.
    """
    spans = bag_offsets(lengths).where("length > 0").withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("length") - 1) / block))))
    rows = flat.withColumn("_block", F.floor(F.col("ix") / block))
    hit = (F.col("ix") >= F.col("start")) & (F.col("ix") < F.col("start") + F.col("length"))
    return (rows.join(spans.select("_block", "bag_ix", "bag_id", "start", "length"), "_block").where(hit)
            .withColumn("pos", F.col("ix") - F.col("start")).drop("_block", "start"))


def flat_index(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The inverse: a global 0-based index in (bag_ix, pos) order."""
    starts = bag_offsets(lengths).select("bag_id", "start")
    return attach(rows, starts, ["bag_id"]).withColumn("ix", F.col("start") + F.col("pos")).drop("start")


def write_scores(scores: DataFrame, path: str, stamp: dict[str, str]) -> None:
    """Partitioned dump plus a one-row provenance sidecar; an existing dump is an error."""
    scores.write.mode("errorifexists").partitionBy("tag", "split").parquet(f"{path}/scores")
    side = scores.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in stamp.items()])
    side.write.mode("errorifexists").json(f"{path}/stamp")


def replace_series(rows: DataFrame, path: str, by: str = "bag_id", buckets: int = 64) -> None:
    """Append or replace whole series: only the partitions present in ``rows`` are rewritten.

    Series are hashed into a fixed number of partitions; untouched series of a rewritten partition
    are carried over, read before and written after the checkpointed merge.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    new = rows.withColumn("_part", part)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.mode("errorifexists").partitionBy("_part").parquet(path)
        return
    touched = new.select("_part").distinct()
    keep = (old.join(F.broadcast(touched), "_part", "left_semi")  # at most ``buckets`` rows
            .join(rows.select(by).distinct(), by, "left_anti"))
    merged = pin(new.unionByName(keep.select(*new.columns)))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_part").parquet(path))


def to_do(wanted: DataFrame, done: DataFrame, gate: str | None = None, by: str = "bag_id") -> DataFrame:
    """Work still to do; with ``gate`` a finished series needs data and a non-null gate value."""
    finished = done.where(F.col(gate).isNotNull()) if gate else done
    return wanted.join(finished.select(by).distinct(), by, "left_anti")


def merge_shards(shards: Sequence[DataFrame], method: str, by: str = "bag_id") -> DataFrame:
    """Union of shards; a series in two shards or mixed methods are errors."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    per = out.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    checked = out.join(per, by).withColumn("_methods", out.agg(F.count_distinct(method)).scalar())
    twice = F.raise_error(F.concat(F.lit("series in two shards: "), F.col(by).cast("string"))).cast("boolean")
    mixed = F.raise_error(F.lit("shards were made with different methods")).cast("boolean")
    ok = F.when(F.col("_n") > 1, twice).when(F.col("_methods") > 1, mixed).otherwise(F.lit(True))
    return checked.where(ok).drop("_n", "_methods")


def shard_of(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Stride sharding of a work list: rank modulo ``shards``. ``order`` is an integer that names one item of the list."""
    return prefix_sums(df, order, F.lit(1), "_ix").withColumn("shard", F.col("_ix") % shards).drop("_ix")


def discover(paths: DataFrame, column: str = "path") -> DataFrame:
    """Class from the directory, id from the stem, host from the address."""
    p = F.col(column)
    return paths.select(
        p.alias("path"), F.nullif(F.regexp_extract(p, r"//[^/]+/([A-Za-z0-9_-]+)/", 1), F.lit("")).alias("severity"),
        F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"[?#.].*$", "").alias("stem"),
        F.regexp_extract(p, r"//([^/]+)", 1).alias("host"))


def hash_splits(df: DataFrame, by: str = "bag_id"):
    return draws.half(F.col(by))
