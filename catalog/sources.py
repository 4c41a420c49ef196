"""Scans, sinks, resumable work lists and incremental ingest."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchrank.operators.scale import prefix_sums
from patchrank.session import checkpoint_dir
from patchrank.sources import artefacts as ar
from patchrank.sources import cache as ca
from patchrank.sources import registry as sr
from patchrank.streaming import ingest as ig

from . import views as v
from .filters import count
from .registry import query, r6, rs


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_scan_chosen_keys", f"WITH {v.INST} SELECT bag_id, count(*) AS n, (SELECT count(*) FROM supplier WHERE s_acctbal > 0 AND s_suppkey NOT IN (SELECT bag_id FROM inst)) AS n_absent FROM inst WHERE bag_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY bag_id")
def scan_chosen_keys(spark, sf):
    rows = v.instances(spark, sf)
    keys = v.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("bag_id"))
    absent = ca.absent_keys(rows, keys).agg(count()).scalar()
    return ca.scan_keys(rows, keys, "pos").groupBy("bag_id").agg(count().alias("n")).withColumn("n_absent", absent)


@query("a02_read_one_bag", f"WITH {v.INST} SELECT bag_id, pos, slice, patch, target, s0 FROM inst WHERE bag_id = (SELECT min_by(s_suppkey, s_acctbal) FROM supplier)")
def read_one_bag(spark, sf):
    poorest = v.table(spark, sf, "supplier").agg(F.min_by("s_suppkey", "s_acctbal")).first()[0]
    return ca.read_bag(v.instances(spark, sf), poorest).select("bag_id", "pos", "slice", "patch", "target", "s0")


@query("a03_masked_keys", f"WITH {v.SERIES} SELECT bag_id FROM series WHERE has_mask")
def masked_keys(spark, sf):
    return ca.masked_keys(v.series(spark, sf))


@query("a04_flat_dump", f"WITH {v.INST} SELECT bag_id, count(*) AS n, max(pos) AS last_pos, round(sum(s0), 4) AS total FROM inst GROUP BY bag_id")
def flat_dump(spark, sf):
    rows = v.instances(spark, sf).select("bag_id", "pos", "s0")
    lengths = rows.groupBy("bag_id").agg(count().alias("length"))
    lengths = prefix_sums(lengths, "bag_id", F.lit(1), "bag_ix")
    flat = ca.flat_index(rows, lengths).select("ix", "s0")
    out = ca.unflatten(flat, lengths)
    return out.groupBy("bag_id").agg(count().alias("n"), F.max("pos").alias("last_pos"), F.round(F.sum("s0"), 4).alias("total"))


@query("a05_write_scores", f"WITH {v.INST} SELECT 's0' AS tag, CASE WHEN bag_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(sum(s0), 4) AS total, 'abc' AS hash FROM inst GROUP BY 1, 2")
def write_scores(spark, sf):
    path = scratch(spark, "scores")
    rows = v.instances(spark, sf).select("bag_id", "pos", F.col("s0").alias("score"), F.lit("s0").alias("tag"),
                                         F.when(F.col("bag_id") % 2 == 0, "val").otherwise("test").alias("split"))
    ca.write_scores(rows, path, {"hash": "abc"})
    stamp = spark.read.schema("hash STRING").json(f"{path}/stamp").select("hash").scalar()
    back = spark.read.schema("bag_id BIGINT, pos BIGINT, score DOUBLE, tag STRING, split STRING").parquet(f"{path}/scores")
    return back.groupBy("tag", "split").agg(count().alias("n"), F.round(F.sum("score"), 4).alias("total")).withColumn("hash", stamp)


@query("a06_replace_series", f"WITH {v.SERIES} SELECT version, count(*) AS n FROM (SELECT CASE WHEN label = 1 THEN 2 ELSE 1 END AS version FROM series) GROUP BY version")
def replace_series(spark, sf):
    path = scratch(spark, "series")
    rows = v.series(spark, sf).select("bag_id", "label")
    ca.replace_series(rows.withColumn("version", F.lit(1)), path, buckets=8)
    ca.replace_series(rows.where("label = 1").withColumn("version", F.lit(2)), path, buckets=8)
    return spark.read.parquet(path).groupBy("version").agg(count().alias("n"))


@query("a07_resume", f"WITH {v.SERIES} SELECT label, count(*) AS n FROM series WHERE bag_id NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY label")
def resume(spark, sf):
    done = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bag_id"))
    return ca.to_do(v.series(spark, sf), done).groupBy("label").agg(count().alias("n"))


@query("a08_resume_gated", f"WITH {v.SERIES} SELECT label, count(*) AS n FROM series WHERE bag_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY label")
def resume_gated(spark, sf):
    done = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bag_id"), F.when(F.col("l_returnflag") == "R", 1).alias("gate"))
    return ca.to_do(v.series(spark, sf), done, "gate").groupBy("label").agg(count().alias("n"))


@query("a09_cache_report", f"WITH {v.SERIES}, s AS (SELECT l_orderkey AS bag_id, count(*) AS n, count(DISTINCT l_linenumber) AS n_slices FROM lineitem GROUP BY 1) SELECT count(*) AS n_bags, count(n) AS n_cached, sum(n)::BIGINT AS n_instances, sum(n_slices)::BIGINT AS n_slices, sum(CAST(has_mask AS INTEGER))::BIGINT AS n_masked FROM series LEFT JOIN s USING (bag_id)")
def cache_report(spark, sf):
    sizes = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("bag_id")).agg(
        count().alias("n"), F.count_distinct("l_linenumber").alias("n_slices"))
    return ca.coverage_report(v.series(spark, sf), sizes)


@query("a10_bag_metadata", f"WITH {v.SERIES} SELECT bag_id, CAST(coalesce(CASE WHEN label <> 3 THEN patient_id END, bag_id) AS VARCHAR) AS patient_id, label, has_mask FROM series")
def bag_metadata(spark, sf):
    rows = v.series(spark, sf).withColumn("patient_id", F.when(F.col("label") != 3, F.col("patient_id")))
    return ca.metadata(rows)


DISC = "SELECT nullif(regexp_extract(url, '//[^/]+/([A-Za-z0-9_-]+)/', 1), '') AS severity, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#.].*$', '') AS stem, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages"


@query("a12_discover_paths", f"SELECT severity, count(*) AS n, count(DISTINCT stem) AS n_stems, count(DISTINCT host) AS n_hosts FROM ({DISC}) GROUP BY severity")
def discover_paths(spark, sf):
    rows = ca.discover(v.table(spark, sf, "pages"), "url")
    return rows.groupBy("severity").agg(count().alias("n"), F.count_distinct("stem").alias("n_stems"), F.count_distinct("host").alias("n_hosts"))


@query("a14_stamped_artefacts", f"WITH {v.RUNS} SELECT 'cafe' AS hash, 'confirm' AS analysis_role, 't' || seed AS tag, arm AS scorer, axis, round(avg(value) * f, 6) AS mean, count(*) AS n FROM runs, (VALUES ('flat', 1.0::DOUBLE), ('slice', 0.5::DOUBLE), ('within_slice', 0.25::DOUBLE)) x(axis, f) GROUP BY seed, arm, axis, f")
def stamped_artefacts(spark, sf):
    path = scratch(spark, "artefacts")
    m = v.runs(spark, sf).groupBy("seed", "arm").agg(F.avg("value").alias("m"), count().alias("n"))
    def ci(f):
        return F.struct((F.col("m") * f).alias("mean"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "n", F.lit(1).cast("bigint").alias("n_clusters"))
    scorers = m.groupBy("seed").agg(F.collect_list(F.struct(F.col("arm").alias("scorer"), ci(1.0).alias("flat_auc"),
                                    ci(0.5).alias("slice_auc"), ci(0.25).alias("within_slice_auc"))).alias("scorers"))
    doc = scorers.select(F.struct(F.lit("cafe").alias("prereg_hash"), F.lit("c0").alias("git_commit"), F.lit(False).alias("git_dirty")).alias("prereg"),
                         F.lit("confirm").alias("analysis_role"),
                         F.array(F.struct(F.concat(F.lit("t"), F.col("seed").cast("string")).alias("tag"), "scorers")).alias("results"))
    doc.repartition(5).write.mode("errorifexists").option("maxRecordsPerFile", 1).json(path)  # one document per file
    rows = ar.scorer_rows(ar.read_artefacts(spark, path))
    return r6(rows.select("hash", "analysis_role", "tag", "scorer", "axis", "mean", "n"), "mean")


@query("a15_merge_shards", f"WITH {v.SERIES} SELECT label, count(*) AS n FROM series GROUP BY label")
def merge_shards(spark, sf):
    rows = v.series(spark, sf).withColumn("method", F.lit("threshold"))
    shards = [rows.where(F.col("status") == s) for s in ("F", "O", "P")]
    return ca.merge_shards(shards, "method").groupBy("label").agg(count().alias("n"))


@query("a16_merge_results", f"WITH {v.RUNS} SELECT arm, CAST(seed AS INTEGER) AS seed, count(*) AS n, round(avg(value), 6) AS mean FROM runs GROUP BY ALL")
def merge_results(spark, sf):
    """Every run's values are written as a result file of its own folder and read back from there."""
    path = scratch(spark, "runs")
    rows = v.runs(spark, sf).select(F.concat("arm", F.lit("_seed"), F.col("seed").cast("string")).alias("run"), "value", F.lit("confirm").alias("role"), F.lit("h1").alias("split_hash"))
    rows.repartition("run").write.mode("errorifexists").partitionBy("run").json(path)
    out = ar.merge_results(ar.read_runs(spark, path, "value DOUBLE, role STRING, split_hash STRING"), "role", "split_hash")
    return r6(out.groupBy("arm", "seed").agg(count().alias("n"), F.avg("value").alias("mean")), "mean")


@query("a17_stride_shards", f"WITH {v.SERIES}, s AS (SELECT *, (row_number() OVER (ORDER BY bag_id) - 1) % 7 AS shard FROM series) SELECT shard, count(*) AS n, min(bag_id) AS first_bag, max(bag_id) AS last_bag FROM s GROUP BY shard")
def stride_shards(spark, sf):
    rows = ca.shard_of(v.series(spark, sf), "bag_id", 7)
    return rows.groupBy("shard").agg(count().alias("n"), F.min("bag_id").alias("first_bag"), F.max("bag_id").alias("last_bag"))


@query("a18_stamped_write", f"WITH {v.RUNS} SELECT arm, count(*) AS n, 'cafe' AS hash, 'confirm' AS role FROM runs GROUP BY arm")
def stamped_write(spark, sf):
    path = scratch(spark, "stamped")
    per = v.runs(spark, sf).groupBy("arm").agg(count().alias("n"))
    ar.write_stamped(per, path, {"hash": "cafe", "role": "confirm"})
    back = spark.read.schema("arm STRING, n BIGINT, stamp STRUCT<hash: STRING, role: STRING>").option("mode", "FAILFAST").json(path)
    return back.select("arm", "n", "stamp.hash", "stamp.role")


@sr.scorer("slot_0")
def _slot_0(rows):
    return rows.select("bag_id", "pos", F.col("s0").alias("score"))


@sr.scorer("slot_sum")
def _slot_sum(rows):
    return rows.select("bag_id", "pos", (F.col("s0") + F.col("s2")).alias("score"))


@query("a20_registered_scorers", f"WITH {v.INST} SELECT bag_id, 'slot_0' AS scorer, count(*) AS n, round(max(s0), 6) AS top FROM inst GROUP BY bag_id UNION ALL SELECT bag_id, 'slot_sum', count(*), round(max(s0 + s2), 6) FROM inst GROUP BY bag_id")
def registered_scorers(spark, sf):
    rows = sr.score_all(v.instances(spark, sf), ["slot_0", "slot_sum"])
    return r6(rows.groupBy("bag_id", "scorer").agg(count().alias("n"), F.max("score").alias("top")), "top")


@query("a19_incremental_ingest", f"WITH {v.FLAG} SELECT bag_id, n_slices, n_lesion_slices, {rs('flat', 'slice', 'within_slice')} FROM {v.axes('flagged', 'bag_id', 's1')}")
def incremental_ingest(spark, sf):
    """Bags land in four groups of files; each run of the stream takes what is new."""
    landing, out, mark = (scratch(spark, n) for n in ("landing", "axes", "mark"))
    rows = v.flagged(spark, sf).select("bag_id", "pos", "slice", "patch", "n_slices", "target", "slice_pos", "s1")
    group = F.pmod(F.xxhash64("bag_id"), F.lit(4))
    for g in range(4):
        rows.where(group == g).write.mode("append").parquet(landing)
        if g in (1, 3):
            done = ig.ingest(spark, landing, out, mark, rows.schema, v.N_PATCH, "s1", files_per_batch=12)
    return r6(done.select("bag_id", "n_slices", "n_lesion_slices", "flat", "slice", "within_slice"), "flat", "slice", "within_slice")
