"""Pooling and probes over the embedding bags, voxel jobs over the line items."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.functions import geometry as geo
from patchrank.operators import ingest as ing
from patchrank.operators import pooling as pl
from patchrank.operators import ranking as rk
from patchrank.operators import templates as tp

from . import views as v
from .alignment import SLOTVEC, slot_vectors
from .filters import count
from .registry import query, r6, rs

DIM, HID = 64, 4


def rule(rows: int, shift: int = 0) -> np.ndarray:
    """Deterministic weights: sin((row + 1 + shift) * (dim + 1)) / 8."""
    r, d = np.arange(rows)[:, None] + 1 + shift, np.arange(DIM)[None, :] + 1
    return np.sin(r * d) / 8.0


HEADS = np.array([[1.0, -0.5, 0.25, 0.75], [0.5, 0.5, -1.0, 0.25]])

EL = f"{v.VECS}, el AS MATERIALIZED (SELECT bag_id, pos, label, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM vecs)"


def proj(name: str, rows: int, shift: int = 0) -> str:
    return f"{name} AS MATERIALIZED (SELECT bag_id, pos, r, sum(x * sin((r + 1 + {shift}) * (d + 1)) / 8) AS y FROM el, range({rows}) q(r) GROUP BY ALL)"


def softmax_sql(src: str, keys: str, logit: str = "logit") -> str:
    return f"(SELECT *, exp({logit} - max({logit}) OVER (PARTITION BY {keys}))/sum(exp({logit} - mx)) OVER (PARTITION BY {keys}) AS attention FROM (SELECT *, max({logit}) OVER (PARTITION BY {keys}) AS mx FROM {src}))"


@query("p01_mean_pool", f"WITH {EL} SELECT bag_id, CAST(d AS INTEGER) AS dim, round(avg(x), 6) AS value, round(1.0::DOUBLE/count(*), 6) AS attention FROM el GROUP BY bag_id, d")
def mean_pool(spark, sf):
    return r6(pl.mean_pool(v.vectors(spark, sf), "embedding"), "value", "attention")


@query("p02_max_pool", f"""WITH {EL}, m AS (SELECT bag_id, d, x, pos FROM el QUALIFY row_number() OVER (PARTITION BY bag_id, d ORDER BY x DESC, pos) = 1),
 n AS (SELECT bag_id, pos, count(*) AS n FROM m GROUP BY ALL)
 SELECT n.bag_id, n.pos AS winner, n.n AS n_dims, round(s.total, 5) AS total FROM n JOIN (SELECT bag_id, sum(x) AS total FROM m GROUP BY bag_id) s USING (bag_id) QUALIFY row_number() OVER (PARTITION BY n.bag_id ORDER BY n.n DESC, n.pos) = 1""")
def max_pool(spark, sf):
    pooled = pl.max_pool(v.vectors(spark, sf), "embedding")
    total = pooled.groupBy("bag_id").agg(F.round(F.sum("value"), 5).alias("total"))
    return pl.max_pool_credit(pooled).join(total, "bag_id")


def pooled_sql(att: str, keys: str) -> str:
    return f"SELECT {keys}, CAST(d AS INTEGER) AS dim, round(sum(attention*x), 6) AS value FROM {att} a JOIN el USING (bag_id, pos) GROUP BY {keys}, d"


@query("p03_attention_pool", f"""WITH {EL}, {proj('v', HID)}, l AS (SELECT bag_id, pos, sum(tanh(y) * [1.0, -0.5, 0.25, 0.75][r+1]::DOUBLE) AS logit FROM v GROUP BY ALL)
 {pooled_sql(softmax_sql('l', 'bag_id'), 'bag_id')}""")
def attention_pool(spark, sf):
    out = pl.pooled_attention(v.vectors(spark, sf), "embedding", ["bag_id"], rule(HID), HEADS[:1])
    return r6(out.drop("head"), "value")


@query("p03_gated_attention", f"""WITH {EL}, {proj('v', HID)}, {proj('u', HID, 10)}, l AS (SELECT bag_id, pos, sum(tanh(v.y)/(1+exp(-u.y)) * [1.0, -0.5, 0.25, 0.75][r+1]::DOUBLE) AS logit FROM v JOIN u USING (bag_id, pos, r) GROUP BY ALL)
 SELECT bag_id, pos, round(attention, 6) AS attention FROM {softmax_sql('l', 'bag_id')}""")
def gated_attention(spark, sf):
    rows = pl.attention_logits(v.vectors(spark, sf), "embedding", rule(HID), HEADS[:1], rule(HID, 10))
    return r6(pl.softmax(rows.select("bag_id", "pos", "logit"), ["bag_id"]).drop("logit"), "attention")


@query("p04_multi_head_attention", f"""WITH {EL}, {proj('v', 2 * HID)}, {proj('u', 2 * HID, 10)}, l AS (SELECT bag_id, pos, CAST(r//4 AS INTEGER) AS head, sum(tanh(v.y)/(1+exp(-u.y)) * [1.0, -0.5, 0.25, 0.75, 0.5, 0.5, -1.0, 0.25][r+1]::DOUBLE) AS logit FROM v JOIN u USING (bag_id, pos, r) GROUP BY ALL)
 {pooled_sql(softmax_sql('l', 'bag_id, head'), 'bag_id, head')}""")
def multi_head(spark, sf):
    return r6(pl.pooled_attention(v.vectors(spark, sf), "embedding", ["bag_id"], rule(2 * HID), HEADS, rule(2 * HID, 10)), "value")


@query("p05_critical_instances", f"""WITH {EL}, {proj('c', 2, 20)}, {proj('q', HID, 30)}, cr AS (SELECT bag_id, r AS cls, pos AS critical FROM c QUALIFY row_number() OVER (PARTITION BY bag_id, r ORDER BY y DESC, pos) = 1),
 l AS (SELECT a.bag_id, a.pos, cls, critical, sum(tanh(a.y)*tanh(b.y))/2 AS logit FROM cr JOIN q b ON b.bag_id=cr.bag_id AND b.pos=critical JOIN q a ON a.bag_id=cr.bag_id AND a.r=b.r GROUP BY ALL)
 SELECT bag_id, pos, CAST(cls AS INTEGER) AS cls, critical, round(attention, 6) AS attention FROM {softmax_sql('l', 'bag_id, cls')}""")
def critical_instances(spark, sf):
    out = pl.critical_instances(v.vectors(spark, sf), "embedding", rule(2, 20), rule(HID, 30))
    return r6(out.select("bag_id", "pos", "cls", "critical", "attention"), "attention")


GATE = [float(x) for x in np.sin(np.arange(DIM) + 1.0)]


@query("p06_gated_readout", f"""WITH {SLOTVEC}, g AS (SELECT bag_id, slot, sum(x*sin(d+1)) AS logit FROM sv GROUP BY ALL), w AS {softmax_sql('g', 'bag_id')},
 t AS (SELECT bag_id, slot FROM w QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY attention DESC, slot) = 1)
 SELECT sv.bag_id, CAST(d AS INTEGER) AS dim, round(sum(attention*x), 6) AS value, max(t.slot) AS top_slot FROM sv JOIN w USING (bag_id, slot) JOIN t ON t.bag_id = sv.bag_id GROUP BY sv.bag_id, d""")
def gated_readout(spark, sf):
    return r6(pl.gated_readout(slot_vectors(spark, sf), 4, GATE), "value")


@query("p06_max_readout", f"""WITH {SLOTVEC} SELECT bag_id, CAST(d AS INTEGER) AS dim, round(x, 6) AS value, slot FROM sv QUALIFY row_number() OVER (PARTITION BY bag_id, d ORDER BY x DESC, slot) = 1""")
def max_readout(spark, sf):
    return r6(pl.max_readout(slot_vectors(spark, sf), 4), "value")


@query("p07_pseudo_labels", f"""WITH {v.INST}, n AS (SELECT bag_id, count(*) AS n FROM inst GROUP BY bag_id), r AS (SELECT bag_id, pos, row_number() OVER (PARTITION BY bag_id ORDER BY s1 DESC, pos) AS a, row_number() OVER (PARTITION BY bag_id ORDER BY s1, pos) AS b FROM inst)
 SELECT bag_id, pos, a AS rank, 1 AS pseudo FROM r JOIN n USING (bag_id) WHERE a <= least(8, n//2) UNION ALL SELECT bag_id, pos, b, 0 FROM r JOIN n USING (bag_id) WHERE b <= least(8, n//2)""")
def pseudo_labels(spark, sf):
    return pl.extremes(v.instances(spark, sf), "s1", 8).select("bag_id", "pos", "rank", "pseudo")


@query("p08_class_max", f"WITH {EL}, {proj('c', 2, 20)} SELECT bag_id, CAST(r AS INTEGER) AS cls, round(max(y), 6) AS logit FROM c GROUP BY bag_id, r")
def class_max(spark, sf):
    return r6(pl.class_max(v.vectors(spark, sf), "embedding", rule(2, 20)), "logit")


def probe_rows(spark, sf):
    return v.vectors(spark, sf).select("bag_id", "pos", (F.col("label") < 2).cast("int").alias("target"), "embedding",
                                       draws.half(F.col("bag_id")).alias("part"))


FITSET = f"""pr AS (SELECT bag_id, pos, CAST(label < 2 AS INTEGER) AS target FROM vecs), np AS (SELECT bag_id, sum(target) AS p FROM pr GROUP BY bag_id),
 ng AS (SELECT pr.*, p, row_number() OVER (PARTITION BY bag_id ORDER BY md5(concat_ws('|', '0', bag_id, pos)), pos) - 1 AS ix FROM pr JOIN np USING (bag_id) WHERE target = 0)"""


@query("p09_probe_fit_set", f"WITH {v.VECS}, {FITSET} SELECT bag_id, pos, target FROM pr WHERE target = 1 UNION ALL SELECT bag_id, pos, target FROM ng WHERE ix < p*2")
def probe_fit_set(spark, sf):
    return pl.probe_fit_set(probe_rows(spark, sf).drop("embedding", "part"), 2, 0)


@query("p09_probe_scores")
def probe_scores(spark, sf):
    rows = probe_rows(spark, sf)
    model = pl.fit_probe(pl.probe_fit_set(rows.where("part = 'fit'"), 2, 0), "embedding")
    return r6(pl.probe_scores(model, rows.where("part <> 'fit'"), "embedding").select("bag_id", "pos", "target", "score"), "score")


@query("p10_probe_ceiling")
def probe_ceiling(spark, sf):
    rows = probe_rows(spark, sf)
    model = pl.fit_probe(pl.probe_fit_set(rows.where("part = 'fit'"), 2, 0), "embedding")
    scored = pl.probe_scores(model, rows.where("part <> 'fit'"), "embedding")
    pooled = rk.auc(scored, []).select(F.col("auc").alias("pooled_auc"), "n_pos", "n_neg")
    macro = rk.auc(scored, ["bag_id"]).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_bags"))
    return r6(pooled.withColumn("macro_auc", macro.select("macro_auc").scalar())
              .withColumn("n_bags", macro.select("n_bags").scalar()), "pooled_auc", "macro_auc")


# Voxels: the same line items at 8 x 8 to a slice --------------------------------------------

VOX = f"""{v.INST}, vox AS MATERIALIZED (SELECT bag_id, pos//64 AS slice, pos%64//8 AS y, pos%8 AS x, s1*1500 - 1000 AS hu, target AS finding, frac FROM inst)"""


def voxels(spark, sf):
    rows = v.instances(spark, sf)
    return rows.select("bag_id", geo.slice_of(F.col("pos"), 64).alias("slice"), F.floor((F.col("pos") % 64) / 8).alias("y"),
                       (F.col("pos") % 8).alias("x"), (F.col("s1") * 1500 - 1000).alias("hu"), F.col("target").alias("finding"), "frac")


@query("i01_window_level", f"WITH {VOX}, w AS (SELECT bag_id, (greatest(least(hu, 400.0::DOUBLE), -600.0::DOUBLE) + 600.0::DOUBLE)/1000.0::DOUBLE AS w FROM vox) SELECT bag_id, count(*) AS n, round(avg(w), 6) AS mean, round(min(w), 6) AS lo, round(max(w), 6) AS hi FROM w GROUP BY bag_id")
def window_level(spark, sf):
    rows = voxels(spark, sf).withColumn("w", ing.window_level(F.col("hu"), -600.0, 400.0))
    return r6(rows.groupBy("bag_id").agg(count().alias("n"), F.avg("w").alias("mean"), F.min("w").alias("lo"), F.max("w").alias("hi")), "mean", "lo", "hi")


def cover_sql(agg: str) -> str:
    return f"""(SELECT bag_id, slice, bi*3 + bj AS patch, {agg} AS coverage FROM vox, range(3) a(bi), range(3) b(bj)
      WHERE y >= floor(bi*8/3.0) AND y < ceil((bi+1)*8/3.0) AND x >= floor(bj*8/3.0) AND x < ceil((bj+1)*8/3.0) GROUP BY ALL)"""


@query("i02_patch_coverage", f"WITH {VOX} SELECT bag_id, slice, patch, round(m.coverage, 6) AS coverage, a.coverage AS touched FROM {cover_sql('avg(finding)')} m JOIN {cover_sql('max(CASE WHEN finding > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} a USING (bag_id, slice, patch)")
def patch_coverage(spark, sf):
    vox = voxels(spark, sf)
    m = ing.patch_coverage(vox, "finding", 8, 8, 3)
    a = ing.patch_coverage(vox, "finding", 8, 8, 3, "any").withColumnRenamed("coverage", "touched")
    return r6(m.join(a, ["bag_id", "slice", "patch"]), "coverage")


@query("i03_organ_slices", f"""WITH {VOX}, a AS (SELECT bag_id, slice, avg(CASE WHEN frac > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS area FROM vox GROUP BY ALL),
 r AS (SELECT bag_id, min(CASE WHEN area > 0.42 THEN slice END) AS a, max(CASE WHEN area > 0.42 THEN slice END) AS b, max(slice) AS top FROM a GROUP BY bag_id)
 SELECT bag_id, greatest(coalesce(a - 1, 0), 0) AS first_slice, least(coalesce(b + 1, top), top) AS last_slice, a IS NOT NULL AS found FROM r""")
def organ_slices(spark, sf):
    return ing.organ_slices(voxels(spark, sf), F.col("frac") > 0.5, 0.42, 1)


@query("i04_split_findings", f"WITH {VOX} SELECT CASE WHEN finding <= 0 THEN 0 WHEN hu >= -250 THEN 2 ELSE 1 END AS kind, count(*) AS n, count(DISTINCT bag_id) AS n_bags FROM vox GROUP BY 1")
def split_findings(spark, sf):
    rows = voxels(spark, sf).groupBy(ing.split_finding(F.col("finding"), F.col("hu"), -250).alias("kind"), "bag_id").agg(count().alias("n"))
    return rows.groupBy("kind").agg(F.sum("n").alias("n"), count().alias("n_bags"))


CONT = f"""{v.INST}, ct AS (SELECT bag_id, cut, sum(target)::BIGINT AS n_lesion, avg(CASE WHEN frac > cut THEN 1.0::DOUBLE ELSE 0 END) AS region_frac,
  sum(CASE WHEN frac > cut THEN target ELSE 0 END)/nullif(sum(target), 0) AS contained FROM inst, (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) c(cut) GROUP BY bag_id, cut)"""


@query("i05_containment", f"WITH {CONT} SELECT bag_id, cut, n_lesion, {rs('region_frac', 'contained')} FROM ct")
def containment(spark, sf):
    return r6(ing.containment(v.instances(spark, sf)), "region_frac", "contained")


SUMM = ("aggregate", "mean", "worst", "frac_full", "frac_above_min", "mean_region_frac")


@query("i06_containment_summary", f"""WITH {CONT}, s AS (SELECT cut, sum(contained*n_lesion)/sum(n_lesion) AS aggregate, avg(contained) AS mean, min(contained) AS worst, avg(CASE WHEN contained >= 0.999 THEN 1.0::DOUBLE ELSE 0 END) AS frac_full,
  avg(CASE WHEN contained >= 0.85 THEN 1.0::DOUBLE ELSE 0 END) AS frac_above_min, avg(region_frac) AS mean_region_frac, count(*) AS n_bags FROM ct WHERE contained IS NOT NULL GROUP BY cut)
 SELECT cut, n_bags, aggregate >= 0.85 AS usable, {rs(*SUMM)} FROM s""")
def containment_summary(spark, sf):
    return r6(ing.containment_summary(ing.containment(v.instances(spark, sf)), ["cut"], 0.85), *SUMM)


@query("i07_reader_consensus", """WITH m AS (SELECT DISTINCT l_suppkey AS bag_id, l_linenumber AS finding, l_partkey % 50 AS voxel, l_orderkey % 4 AS reader FROM lineitem),
 n AS (SELECT bag_id, finding, count(DISTINCT reader) AS n_readers FROM m GROUP BY ALL), a AS (SELECT bag_id, finding, voxel, count(*) AS n FROM m GROUP BY ALL),
 c AS (SELECT DISTINCT bag_id, voxel FROM a JOIN n USING (bag_id, finding) WHERE n/n_readers >= 0.5) SELECT bag_id, count(*) AS n_voxels FROM c GROUP BY bag_id""")
def reader_consensus(spark, sf):
    marks = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("bag_id"), F.col("l_linenumber").alias("finding"),
        (F.col("l_partkey") % 50).alias("voxel"), (F.col("l_orderkey") % 4).alias("reader"))
    readers = marks.groupBy("bag_id", "finding").agg(F.count_distinct("reader").alias("n_readers"))
    return ing.consensus(marks, readers).groupBy("bag_id").agg(count().alias("n_voxels"))


@query("a13_dataset_adapters", f"""WITH {VOX}, l AS (SELECT d.dataset, CASE WHEN dataset IN ('kits19','lits') THEN CAST(kind = 2 AS INTEGER) ELSE CAST(kind > 0 AS INTEGER) END AS mask FROM
  (SELECT CASE WHEN finding <= 0 THEN 0 WHEN hu >= -250 THEN 2 ELSE 1 END AS kind FROM vox), (VALUES ('covid_ct_seg'), ('kits19'), ('msd_task06'), ('lits')) d(dataset))
 SELECT dataset, count(*) AS n, sum(mask)::BIGINT AS n_lesion FROM l GROUP BY dataset""")
def dataset_adapters(spark, sf):
    rows = voxels(spark, sf).withColumn("label", ing.split_finding(F.col("finding"), F.col("hu"), -250))
    out = None
    for name in ("covid_ct_seg", "kits19", "msd_task06", "lits"):
        one = ing.lesion_class(rows, "label", name).groupBy("dataset").agg(count().alias("n"), F.sum("mask").alias("n_lesion"))
        out = one if out is None else out.unionByName(one)
    return out
