"""How the bundled tables are read as scored instances, bags, runs and vectors.

Every view has a Spark form and the same definition as SQL text for the comparison engine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchrank.functions import geometry as geo
from patchrank.operators.ranking import with_slice_flag
from patchrank.operators.scale import HOT_ROWS, positions, positions_in_place, split_hot
from patchrank.session import is_materialised, materialise, reopen

N_PATCH, GRID, N_BINS = 16, 4, 8
SLOTS = ["s0", "s1", "s2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


ORDER = ["l_shipdate", "l_quantity", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def build_instances(spark: SparkSession, sf: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Line items as instances with their slice flag: position = order by ship date, 16 to a slice.

    A supplier's whole slices are one bag; the rows beyond them are a bag of their own, with a ragged slice (bag -1 - supplier). No row is
    left out: operators that need whole slices drop ragged bags themselves and count them. Suppliers of up to ``hot_rows`` items are
    numbered and flagged behind one exchange, larger ones in buckets.
    """
    rows = table(spark, sf, "lineitem").select("l_suppkey", *ORDER)
    small, hot = split_hot(rows, ["l_suppkey"], hot_rows)
    parts = (positions_in_place(small, ["l_suppkey"], ORDER, "pos", total="n_rows"), positions(hot, ["l_suppkey"], ORDER[:2], ORDER[2:], "pos", total="n_rows"))
    placed = [with_slice_flag(_placed(p), ["l_suppkey", "bag_id"]).drop("l_suppkey") for p in parts]
    return placed[0].unionByName(placed[1])


def _placed(numbered: DataFrame) -> DataFrame:
    whole = F.floor(F.col("n_rows") / N_PATCH) * N_PATCH
    tail = F.col("pos") >= whole
    placed = numbered.withColumns({
        "bag_id": F.when(tail, -1 - F.col("l_suppkey")).otherwise(F.col("l_suppkey")), "pos": F.when(tail, F.col("pos") - whole).otherwise(F.col("pos")),
        "n_rows": F.when(tail, F.col("n_rows") - whole).otherwise(whole), "n_slices": F.when(tail, F.lit(1)).otherwise(F.floor(F.col("n_rows") / N_PATCH))})
    lesion = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return placed.select(
        "l_suppkey", "bag_id", "pos", geo.slice_of(F.col("pos"), N_PATCH).alias("slice"),
        geo.patch_of(F.col("pos"), N_PATCH).alias("patch"), "n_slices", "n_rows",
        lesion.cast("int").alias("target"),
        F.when(lesion, F.col("l_tax")).otherwise(F.lit(0.0)).alias("coverage"),
        (F.col("l_quantity") / 50).alias("s0"), (F.col("l_extendedprice") / 100000).alias("s1"),
        (F.col("l_discount") * 10).alias("s2"),
        ((F.col("l_partkey") % 10).cast("double") / 10).alias("frac"))


def flagged(spark, sf) -> DataFrame:
    """The instances with their slice flag, written once per application and re-read."""
    key = ("instances", sf)
    if is_materialised(spark, key):
        return reopen(spark, key)
    return materialise(build_instances(spark, sf), key)


def instances(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).drop("slice_pos")


def bags(spark: SparkSession, sf: str) -> DataFrame:
    """Both bags of every supplier with their patient (nation)."""
    both = F.explode(F.array(F.col("s_suppkey"), -1 - F.col("s_suppkey")))
    return table(spark, sf, "supplier").select(both.alias("bag_id"), F.col("s_nationkey").cast("bigint").alias("patient_id"))


def bag_sizes(spark, sf):
    return instances(spark, sf).groupBy("bag_id").agg(F.max("n_slices").alias("n_slices"), F.max("n_rows").alias("n_rows"))


def with_patient(rows: DataFrame, spark, sf) -> DataFrame:
    """Attach the patient to per-bag results; a bag without one is its own patient."""
    return (rows.join(bags(spark, sf), "bag_id", "left")
            .withColumn("patient_id", F.coalesce(F.col("patient_id"), F.col("bag_id"))))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as series: patient = customer, label = leading digit of the priority."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("bag_id"), F.col("o_custkey").alias("patient_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("label"),
        (F.col("o_orderstatus") == "F").alias("has_mask"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as run results: arm = event type, seed = user modulo 5, one value per event."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("seed"),
        F.col("user_id").alias("bag_id"), "event_id", F.col("value"), "ts", "props")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as bags of vectors."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 20).alias("bag_id"), F.col("vec_id").alias("pos"), "embedding", "label")


INST = """
inst AS MATERIALIZED (
 SELECT CASE WHEN pos < whole THEN bag_id ELSE -1 - bag_id END AS bag_id, CASE WHEN pos < whole THEN pos ELSE pos - whole END AS pos,
        CASE WHEN pos < whole THEN pos // 16 ELSE 0 END AS slice, pos % 16 AS patch, CASE WHEN pos < whole THEN n // 16 ELSE 1 END AS n_slices,
        CASE WHEN pos < whole THEN whole ELSE n - whole END AS n_rows,
        CAST(l_returnflag='R' AND l_linestatus='F' AS INTEGER) AS target,
        CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN l_tax ELSE 0.0::DOUBLE END AS coverage,
        l_quantity/50 AS s0, l_extendedprice/100000 AS s1, l_discount*10 AS s2,
        CAST(l_partkey % 10 AS DOUBLE)/10 AS frac
 FROM (SELECT *, 16 * (n // 16) AS whole FROM (SELECT l_suppkey AS bag_id, *,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_quantity, l_extendedprice,
          l_orderkey, l_partkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)))"""

FLAG = INST + """,
flagged AS MATERIALIZED (
 SELECT *, max(target) OVER (PARTITION BY bag_id, slice) AS slice_pos FROM inst)"""

BAGS = """
bags AS (SELECT unnest([s_suppkey, -1 - s_suppkey]) AS bag_id, CAST(s_nationkey AS BIGINT) AS patient_id FROM supplier)"""

SERIES = """
series AS (SELECT o_orderkey AS bag_id, o_custkey AS patient_id,
   CAST(substr(o_orderpriority,1,1) AS INTEGER) AS label, o_orderstatus='F' AS has_mask,
   o_orderstatus AS status, o_totalprice AS price FROM orders)"""

RUNS = """
runs AS (SELECT event_type AS arm, user_id % 5 AS seed, user_id AS bag_id, event_id, value, ts, props
   FROM events)"""

VECS = """
vecs AS (SELECT vec_id % 20 AS bag_id, vec_id AS pos, embedding, label FROM embeddings)"""


def exact(x: str) -> str:
    """Order-free decimal of a double, by way of its shortest text."""
    return f"CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18))"


def draw(*parts: str) -> str:
    return f"CAST('0x' || left(md5(concat_ws('|', {', '.join(parts)})), 8) AS BIGINT)"


def normal(*parts: str) -> str:
    u = f"(({draw(*parts, chr(39) + 'u' + chr(39))} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    v = f"(({draw(*parts, chr(39) + 'v' + chr(39))} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos(2.0::DOUBLE * pi() * {v}))"


def auc(source: str, keys: str, score: str = "score", target: str = "target",
        where: str = "TRUE") -> str:
    """Grouped AUC from midranks; NULL where a class is missing."""
    part = f"PARTITION BY {keys}" if keys else ""
    part2 = f"PARTITION BY {keys}, _s" if keys else "PARTITION BY _s"
    head = f"{keys}," if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {head} sum(_y)::BIGINT AS n_pos, (count(*) - sum(_y))::BIGINT AS n_neg,
      CASE WHEN sum(_y) > 0 AND sum(_y) < count(*) THEN
       (sum(_mr * _y) - sum(_y) * (sum(_y) + 1))::DOUBLE / (2.0::DOUBLE * sum(_y) * (count(*) - sum(_y))) END AS auc
     FROM (SELECT *, 2 * rank() OVER ({part} ORDER BY _s) + count(*) OVER ({part2}) - 1 AS _mr
       FROM (SELECT *, CAST({score} AS DOUBLE) AS _s, CAST({target} > 0 AS BIGINT) AS _y FROM {source}
             WHERE {where})) {group})"""


def axes(source: str, keys: str = "bag_id", score: str = "score") -> str:
    """Flat, slice and within-slice AUC per bag; ``source`` has slice_pos."""
    slices = (f"(SELECT {keys}, slice, max(slice_pos) AS has, "
              f"CAST(CAST(sum({exact(score)}) AS DOUBLE)/count(*) AS FLOAT) AS sm FROM {source} GROUP BY {keys}, slice)")
    return f"""(SELECT {', '.join('f.' + k.strip() for k in keys.split(','))}, f.auc AS flat, s.auc AS slice,
      w.auc AS within_slice, s.n_pos + s.n_neg AS n_slices, s.n_pos AS n_lesion_slices
     FROM {auc(source, keys, score)} f
     JOIN {auc(slices, keys, 'sm', 'has')} s USING ({keys})
     LEFT JOIN {auc(source, keys, score, where='slice_pos = 1')} w USING ({keys})
     WHERE f.auc IS NOT NULL AND f.n_pos + f.n_neg = 16 * (s.n_pos + s.n_neg))"""


def bootstrap(source: str, keys: str, value: str, cluster: str = "patient_id", reps: int = 10000,
              seed: int = 0) -> str:
    """Cluster bootstrap with the same draws."""
    k = f"{keys}," if keys else ""
    on = " AND ".join(f"d.{c.strip()} = n.{c.strip()}" for c in keys.split(",")) if keys else "TRUE"
    part = f"PARTITION BY {keys}" if keys else ""
    dk = ", ".join(f"d.{c.strip()}" for c in keys.split(",")) + "," if keys else ""
    gk = f"GROUP BY {keys}" if keys else ""
    using = f"JOIN edges USING ({keys})" if keys else "CROSS JOIN edges"
    return f"""(WITH per AS (SELECT {k} CAST({cluster} AS VARCHAR) AS cluster, sum({value}) AS total,
        count(*) AS rows FROM {source} WHERE {value} IS NOT NULL GROUP BY {k} CAST({cluster} AS VARCHAR)),
      num AS (SELECT *, row_number() OVER ({part} ORDER BY md5(cluster), cluster) - 1 AS ix,
        count(*) OVER ({part}) AS size FROM per),
      d AS (SELECT {k} rep, {draw(str(seed), 'rep', 'ix')} % size AS ix FROM num, range({reps}) r(rep)),
      m AS (SELECT {dk} rep, sum(total)/sum(rows) AS m FROM d JOIN num n ON {on} AND d.ix = n.ix
        GROUP BY {dk} rep),
      edges AS (SELECT {k} quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m {gk}),
      pt AS (SELECT {k} sum(total)/sum(rows) AS mean, sum(rows)::BIGINT AS n, count(*) AS n_clusters
        FROM per {gk})
      SELECT * FROM pt {using})"""
