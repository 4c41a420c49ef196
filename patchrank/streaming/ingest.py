"""Incremental ingest: bags touched by new files are scored again, all others are left alone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking as rk


BUCKETS = 256
TASK_ROWS = 1 << 18  # a batch is scored by tasks of about this many rows


def latest(results: DataFrame) -> DataFrame:
    """The result of the last batch that touched a bag; a bag that batch could not score has none."""
    names = [c for c in results.columns if c not in ("bag_id", "batch")]
    last = results.groupBy("bag_id").agg(F.max_by(F.struct(*names), "batch").alias("_v")).select("bag_id", "_v.*")
    return last.where(F.col("flat").isNotNull())


def spread_over(session: SparkSession, rows: int) -> None:
    """As many shuffle partitions as the rows need; a stream's session has a fixed number of them and is no other query's."""
    now = int(session.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.shuffle.partitions", max(now, -(-rows // TASK_ROWS)))


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: T.StructType, n_patch: int,
           score: str, files_per_batch: int = 64) -> DataFrame:
    """Process everything in ``landing`` that is new, then stop; return the current results.

    A bag may arrive in pieces over several batches, or a piece twice. Each batch first files its rows by bag bucket, then reads the
    buckets it touches, once per (bag, position). Slices, their number and their flags are derived from all rows of the bag, never
    taken from a piece. A touched bag without a result, such as one that has become ragged, leaves a tombstone. A batch
    writes its own folders in overwrite mode, and reads no later ones, so one repeated after a failure replaces its own output.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    store = f"{out.rstrip('/')}-rows"

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        kept = batch.select("bag_id", "pos", "target", score).withColumn("bucket", F.pmod(F.xxhash64("bag_id"), F.lit(BUCKETS)).cast("int"))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        new = session.read.parquet(f"{store}/batch={number}")
        touched = new.select("bag_id").distinct()
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        filed = session.read.option("basePath", store).parquet(store).where(F.col("bucket").isin(buckets) & (F.col("batch") <= number))
        spread_over(session, filed.count())
        rows = filed.join(touched, "bag_id", "left_semi").dropDuplicates(["bag_id", "pos"]).drop("bucket", "batch")
        rows = rows.withColumn("slice", F.floor(F.col("pos") / F.lit(n_patch)))
        scored = touched.join(rk.axes(rows, n_patch, ["bag_id"], score), "bag_id", "left")
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return latest(spark.read.parquet(out))
