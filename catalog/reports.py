"""Tag reports and verdicts: arms are the three line-item slots, each with two seeds."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.functions import geometry as geo
from patchrank.operators import bagwise as bw
from patchrank.operators import estimands as es
from patchrank.operators import filters as fl
from patchrank.operators import inference as inf
from patchrank.operators import nulls as nl
from patchrank.operators import pooling as pl
from patchrank.operators import provenance as pv
from patchrank.operators import ranking as rk
from patchrank.operators import slots as sl
from patchrank.operators import templates as tp
from patchrank.operators import verdicts as vd
from patchrank.plans import null_reports as nr
from patchrank.plans import reports as rp
from patchrank.session import checkpoint_dir, is_materialised, materialise, pin, reopen
from patchrank.sources import artefacts as ar

from . import views as v
from .alignment import HALF, H3, LONGH, SLOTVEC, aff_sql, halves
from .estimands import OUTCOME, delong_sql, p_normal, p_t
from .filters import DONOR, SHUF, count
from .nulls import SLOT_ENT, battery_sql, match_sql, r4, random_ctes, rolled
from .ranking import AX, GT, LOC, RADIAL, apply_cte, centre_cte, family_ctes, sized, strat_sql
from .registry import ORACLES, QUERIES, query, r6, rs

ARMS3 = ("s0", "s1", "s2")


def arm_scores():
    """Score of every arm run by tag: seed 1 adds a small deterministic perturbation."""
    noise = F.lit(0.1) * draws.uniform(1, F.col("bag_id"), F.col("pos"))
    return {f"{a}_seed{s}": F.col(a) + noise if s else F.col(a) for a in ARMS3 for s in (0, 1)}


def tag_scores():
    """Arm runs and references, which carry no seed."""
    centre = geo.centre_prior(F.col("slice"), F.col("n_slices"), F.col("patch"), v.GRID).cast("double")
    return arm_scores() | {"centre_prior": centre, "mean": F.lit(1.0), "depth": geo.depth_only(F.col("slice"), F.col("n_slices"))}


def by_tag(per_bag):
    """(tag, arm, seed) in place of the scorer."""
    seed = F.when(F.col("scorer").contains("_seed"), F.substring_index("scorer", "_seed", -1).cast("int"))
    return per_bag.withColumns({"tag": F.col("scorer"), "arm": F.substring_index("scorer", "_seed", 1), "seed": seed}).drop("scorer")


def tag_axes(spark, sf):
    """Axes per (tag, bag) with patient and condition (the patient's region), written once."""
    key = ("tag_axes", sf)
    if is_materialised(spark, key):
        return reopen(spark, key)
    ax = by_tag(bw.axes(v.flagged(spark, sf), v.N_PATCH, tag_scores()))
    return materialise(with_condition(ax, spark, sf), key)


def with_condition(per_bag, spark, sf):
    """Attach the patient and the condition, the patient's region."""
    region = v.table(spark, sf, "nation").join(
        v.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("patient_id"), F.col("r_name").alias("condition"))
    return v.with_patient(per_bag, spark, sf).join(region, "patient_id")


U1 = f"(({v.draw(chr(39) + '1' + chr(39), 'bag_id', 'pos')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
TAGS = f"""{v.FLAG}, {v.BAGS}, {centre_cte('flagged')},
 tagrows AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{a}_seed{s}' AS tag, '{a}' AS arm, {s} AS seed, bag_id, slice, target, slice_pos, {a}{' + 0.1::DOUBLE * ' + U1 if s else ''} AS score FROM flagged" for a in ARMS3 for s in (0, 1))}
  UNION ALL SELECT 'centre_prior', 'centre_prior', NULL, bag_id, slice, target, slice_pos, score FROM centre
  UNION ALL SELECT 'mean', 'mean', NULL, bag_id, slice, target, slice_pos, 1.0::DOUBLE FROM flagged
  UNION ALL SELECT 'depth', 'depth', NULL, bag_id, slice, target, slice_pos, -(abs(slice - (n_slices-1)/2.0::DOUBLE) / greatest((n_slices-1)/2.0::DOUBLE, 1.0)) FROM flagged),
 tg0 AS (SELECT DISTINCT tag, arm, seed FROM tagrows),
 ta AS MATERIALIZED (SELECT x.*, arm, seed, patient_id, r_name AS condition FROM {v.axes('tagrows', 'tag, bag_id')} x JOIN tg0 USING (tag) JOIN bags USING (bag_id) JOIN nation ON n_nationkey = patient_id JOIN region ON r_regionkey = n_regionkey),
 tm AS (SELECT condition, tag, arm, seed, avg(flat) AS flat, avg(slice) AS slice, avg(within_slice) AS within_slice, abs(avg(flat) - avg(within_slice)) AS gap, count(*) AS n_bags FROM ta GROUP BY ALL),
 am AS (SELECT condition, arm, avg(flat) AS flat, avg(slice) AS slice, abs(avg(flat) - avg(within_slice)) AS gap FROM tm WHERE seed IS NOT NULL GROUP BY ALL),
 sa AS (SELECT a.condition, a.arm, (a.flat - c.flat)/(1 - c.flat) AS skill, a.slice FROM am a JOIN tm c ON a.condition = c.condition AND c.tag='centre_prior')"""


def tag_means(spark, sf, keys=("condition",)):
    t = tag_axes(spark, sf)
    m = t.groupBy(*keys, "tag", "arm", "seed").agg(*[F.avg(c).alias(c) for c in AX], F.count(F.lit(1)).alias("n_bags"))
    return m.withColumn("gap", F.abs(F.col("flat") - F.col("within_slice")))


def arm_means(spark, sf):
    """One row per condition and arm: what the arm's seeds have on average."""
    m = tag_means(spark, sf).where(is_arm()).groupBy("condition", "arm").agg(*[F.avg(c).alias(c) for c in AX])
    return m.withColumn("gap", F.abs(F.col("flat") - F.col("within_slice")))


def conditions(spark, sf):
    return v.table(spark, sf, "region").select(F.col("r_name").alias("condition"))


def is_arm():
    return F.col("seed").isNotNull()


def q(name, body, prefix=TAGS):
    return query(name, f"WITH {prefix} {body}")


AXL = "axl AS (UNPIVOT (SELECT tag, arm, seed, bag_id, patient_id, condition, flat, slice, within_slice FROM ta) ON flat, slice, within_slice INTO NAME axis VALUE value)"

# Family, gate, paired ---------------------------------------------------------------------

FAMILY = f"""{v.FLAG}, {v.BAGS}, hv AS (SELECT *, {HALF} AS part FROM flagged), fitr AS (SELECT * FROM hv WHERE part='fit'), testr AS (SELECT * FROM hv WHERE part<>'fit'),
 {family_ctes('fitr', 'target', 'fm')}, {family_ctes('fitr', 's1', 'fs')}, {apply_cte('testr', 'fm', 'am')}, {apply_cte('testr', 'fs', 'asc_')}, {centre_cte('testr')},
 fr AS MATERIALIZED (SELECT 'trained' AS scorer, bag_id, slice, target, slice_pos, s1 AS score FROM testr UNION ALL SELECT 'masks:' || scorer, bag_id, slice, target, slice_pos, score FROM am
  UNION ALL SELECT 'attention:' || scorer, bag_id, slice, target, slice_pos, score FROM asc_ UNION ALL SELECT 'centre_prior', bag_id, slice, target, slice_pos, score FROM centre),
 fax AS MATERIALIZED (SELECT x.*, patient_id FROM {v.axes('fr', 'scorer, bag_id')} x JOIN bags USING (bag_id)), fxl AS (UNPIVOT (SELECT scorer, patient_id, flat, slice, within_slice FROM fax) ON flat, slice, within_slice INTO NAME axis VALUE value)"""


def family_axes(spark, sf):
    rows = v.flagged(spark, sf).withColumn("part", draws.half(F.col("bag_id")))
    return rp.family_axes(rows.where("part = 'fit'"), rows.where("part <> 'fit'"), "s1", v.N_PATCH, v.GRID, v.N_BINS)


@q("j22_family_report", f"""SELECT scorer, axis, n, n_clusters, {rs('mean', 'lo', 'hi')}, CASE WHEN axis='flat' THEN round((mean - d)/(1 - d), 6) END AS skill FROM ci, (SELECT mean AS d FROM ci WHERE scorer='attention:inplane' AND axis='flat')""",
   FAMILY + f", ci AS MATERIALIZED (SELECT * FROM {v.bootstrap('fxl', 'scorer, axis', 'value', reps=10000)})")
def family_report(spark, sf):
    return r6(rp.family_report(family_axes(spark, sf), v.bags(spark, sf), 10000), "mean", "lo", "hi", "skill")


@q("j22_family_paired", f"SELECT scorer, n, n_clusters, {OUTCOME} AS outcome, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('pd', 'scorer', 'delta', reps=10000)}",
   FAMILY + ", pd AS (SELECT m.scorer, m.flat - t.flat AS delta, m.patient_id FROM fax m JOIN fax t ON m.bag_id = t.bag_id AND t.scorer = 'trained' AND m.scorer LIKE 'masks:%')")
def family_paired(spark, sf):
    return r6(rp.family_paired(family_axes(spark, sf), v.bags(spark, sf), 10000), "mean", "lo", "hi")


@q("j23_axis_gate", f"SELECT tag, axis, n, n_clusters, lo <= 0.5 AND hi >= 0.5 AS covers_half, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('axl', 'tag, axis', 'value', reps=10000)}", f"{TAGS}, {AXL}")
def axis_gate(spark, sf):
    return r6(rp.axis_gate(tag_axes(spark, sf), 10000), "mean", "lo", "hi")


@q("j23_covering_share", f"SELECT round(avg(CASE WHEN lo <= 0.5 AND hi >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n_tags FROM {v.bootstrap('axl', 'tag, axis', 'value', reps=10000)} WHERE axis='slice' AND tag LIKE '%seed%'", f"{TAGS}, {AXL}")
def covering_share(spark, sf):
    return r6(rp.covering_share(rp.axis_gate(tag_axes(spark, sf), 10000), F.contains(F.col("tag"), F.lit("seed"))), "share")


DS = "ds AS (SELECT a.arm, a.seed, a.patient_id, c.slice - a.slice AS delta FROM ta a JOIN ta c ON c.tag='centre_prior' AND a.bag_id=c.bag_id WHERE a.seed IS NOT NULL)"


@q("j24_paired_slice_per_seed", f"SELECT arm, seed, n, n_clusters, {OUTCOME} AS outcome, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('ds', 'arm, seed', 'delta', reps=10000)}", f"{TAGS}, {DS}")
def paired_slice(spark, sf):
    return r6(rp.paired_slice(tag_axes(spark, sf), "centre_prior", 10000)[0], "mean", "lo", "hi")


@q("j24_paired_slice_pooled", f"SELECT arm, n, n_clusters, {OUTCOME} AS outcome, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('ds', 'arm', 'delta', reps=10000)}", f"{TAGS}, {DS}")
def paired_slice_pooled(spark, sf):
    return r6(rp.paired_slice(tag_axes(spark, sf), "centre_prior", 10000)[1], "mean", "lo", "hi")


@q("j37_stored_agreement", "SELECT tag, round(avg(slice), 6) AS ours, round(avg(slice), 6) AS stored, TRUE AS agrees, count(slice) AS n_stored FROM ta GROUP BY tag HAVING count(slice) > 0")
def stored_agreement(spark, sf):
    """Stored means are read back from stamped result documents; ours are recomputed from the bags' rows."""
    path = f"{checkpoint_dir(spark)}/agreement-{uuid.uuid4().hex}"
    t = tag_axes(spark, sf).where("slice IS NOT NULL")
    ar.write_stamped(t.groupBy("tag").agg(F.avg("slice").alias("m"), count().alias("n_stored")), path, {"hash": "cafe", "role": "confirm"})
    stored = spark.read.schema("tag STRING, m DOUBLE, n_stored BIGINT, stamp STRUCT<hash: STRING, role: STRING>").option("mode", "FAILFAST").json(path)
    stored = stored.where("stamp.hash = 'cafe' AND stamp.role = 'confirm'")
    ours = t.groupBy("tag", F.pmod(F.xxhash64("bag_id"), F.lit(8)).alias("part")).agg(F.sum("slice").alias("s"), count().alias("n"))
    ours = ours.groupBy("tag").agg((F.sum("s") / F.sum("n")).alias("m"))
    return r6(pv.stored_agreement(ours, stored, ["tag"], "m").join(stored.select("tag", "n_stored"), "tag"), "ours", "stored")


@q("j25_raw_and_in_region", f"SELECT a.bag_id, round(a.auc, 6) AS raw, round(b.auc, 6) AS inside, round(b.auc - a.auc, 6) AS delta FROM {v.auc('flagged', 'bag_id', 's1')} a LEFT JOIN {v.auc('flagged', 'bag_id', 's1', where='frac > 0.3')} b USING (bag_id)", v.FLAG)
def raw_and_in_region(spark, sf):
    rows = sized(spark, sf)
    raw = rk.auc(rows, ["bag_id"], "s1", size="n_rows").select("bag_id", F.col("auc").alias("raw"))
    inside = rk.auc(fl.restrict(rows.drop("frac"), rows, 0.3), ["bag_id"], "s1", size="n_rows").select("bag_id", F.col("auc").alias("inside"))
    return r6(raw.join(inside, "bag_id", "left").withColumn("delta", F.col("inside") - F.col("raw")), "raw", "inside", "delta")


REG = f"""{v.FLAG}, {RADIAL}, {GT}, {centre_cte('flagged')}, rg AS MATERIALIZED (SELECT bag_id, slice, rbin, target, frac, CAST(template AS DOUBLE) AS s_0, score AS s_1 FROM centre JOIN gt USING (patch) JOIN rb USING (patch)),
 rl AS MATERIALIZED (SELECT bag_id, slice, rbin, target, frac, 0 AS slot, s_0 AS score FROM rg UNION ALL SELECT bag_id, slice, rbin, target, frac, 1, s_1 FROM rg),
 rr AS MATERIALIZED (SELECT *, 'all' AS region FROM rl UNION ALL SELECT *, 'inside' FROM rl WHERE frac > 0.3)"""


@q("j19_in_region", f"SELECT slot, region, FALSE AS stratified, count(auc) AS n_bags, round(avg(auc), 6) AS auc FROM {v.auc('rr', 'slot, region, bag_id')} GROUP BY ALL UNION ALL SELECT slot, region, TRUE, count(auc), round(avg(auc), 6) FROM {strat_sql('slot, region, bag_id', 'slice, rbin', 'rr', 'score')} GROUP BY ALL", REG)
def in_region(spark, sf):
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1")))
    scored = tp.centre_prior_rows(tiled, v.GRID).withColumnRenamed("score", "s_1").withColumn("s_0", F.col("template").cast("double"))
    out = rp.in_region(scored, ["s_0", "s_1"], 0.3, v.N_PATCH, v.GRID, 4)
    return r6(out.groupBy("slot", "region", "stratified").agg(F.count("auc").alias("n_bags"), F.avg("auc").alias("auc")), "auc")


HF = f"""{v.FLAG}, {GT}, {centre_cte('flagged')}, hb AS MATERIALIZED (SELECT bag_id % 3 AS seed, target, s0, s1, s2, score AS centre, CAST(template AS DOUBLE) AS tmpl FROM centre JOIN gt USING (patch)),
 hl AS MATERIALIZED ({' UNION ALL '.join(f"SELECT seed, '{a}' AS arm, '{r}' AS reference, target, {a} AS a, {r} AS b FROM hb" for a in ARMS3 for r in ('centre', 'tmpl'))}),
 hd AS MATERIALIZED (SELECT *, {p_normal('z')} AS p, arm || '|' || reference AS test FROM {delong_sql('hl', 'seed, arm, reference', 'a', 'b')}),
 hs AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n_family, p * (count(*) OVER (PARTITION BY seed) - row_number() OVER (PARTITION BY seed ORDER BY p, test) + 1) AS sc FROM hd),
 hh AS (SELECT *, least(1.0::DOUBLE, max(sc) OVER (PARTITION BY seed ORDER BY p, test ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM hs)"""


@q("j26_holm_family", f"SELECT seed, arm, reference, n_pos, n_neg, n_family, {rs('auc_a', 'auc_b', 'delta', 'z')}, round(p_adjusted, 5) AS p_adjusted, p_adjusted <= 0.05 AS reject, n_family < 6 AS short FROM hh", HF)
def holm_family(spark, sf):
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1")))
    scored = tp.centre_prior_rows(tiled, v.GRID).select(
        (F.col("bag_id") % 3).alias("seed"), "target", *ARMS3, F.col("score").alias("centre"), F.col("template").cast("double").alias("tmpl"))
    out = rp.holm_family(scored, ARMS3, ("centre", "tmpl"))
    out = out.select("seed", "arm", "reference", "n_pos", "n_neg", "n_family", "auc_a", "auc_b", "delta", "z",
                     F.round("p_adjusted", 5).alias("p_adjusted"), "reject", "short")
    return r6(out, "auc_a", "auc_b", "delta", "z")


@q("j27_condition_bridge", "SELECT condition, count(*) AS n_tags, sum(CASE WHEN gap < 0.02 THEN 1 ELSE 0 END)::BIGINT AS n_small_gap, round(avg((flat - 0.5)/(1 - 0.5)), 6) AS mean_skill, round(max(gap), 6) AS max_gap FROM tm WHERE seed IS NOT NULL GROUP BY condition")
def condition_bridge(spark, sf):
    m = tag_means(spark, sf).where(is_arm()).withColumn("skill", es.skill(F.col("flat"), F.lit(0.5)))
    out = m.groupBy("condition").agg(count().alias("n_tags"), F.sum((F.col("gap") < 0.02).cast("bigint")).alias("n_small_gap"),
                                     F.avg("skill").alias("mean_skill"), F.max("gap").alias("max_gap"))
    return r6(out, "mean_skill", "max_gap")


@q("j28_constant_reference", "SELECT condition, round(avg(slice), 6) AS slice, CAST((SELECT count(DISTINCT tag) FROM ta b WHERE b.seed IS NOT NULL AND b.condition = ta.condition) AS INTEGER) AS n FROM ta WHERE tag='centre_prior' GROUP BY condition")
def constant_reference(spark, sf):
    t = tag_axes(spark, sf)
    ref = t.where("tag = 'centre_prior'").select("condition", "bag_id", F.col("slice").alias("ref"))
    per = (t.where(is_arm()).join(ref, ["condition", "bag_id"]).groupBy("condition", "tag").agg(F.avg("ref").alias("slice")))
    out = pv.constant_across(per, ["condition"], "slice").withColumn("n", F.col("n").cast("int"))
    return r6(out, "slice")


# Verdicts ---------------------------------------------------------------------------------

@q("j12_h1_axial_gap", """SELECT condition, n_arms, n_over, n_controls, n_failed, CASE WHEN n_failed > 0 THEN 'VOID' WHEN n_over >= n_arms//2 + 1 THEN 'FAIL' ELSE 'PASS' END AS outcome
 FROM (SELECT condition, count(*) FILTER (tag IS NULL) AS n_arms, count(*) FILTER (tag IS NULL AND gap >= 0.02) AS n_over, count(*) FILTER (tag='depth') AS n_controls, count(*) FILTER (tag='depth' AND NOT gap > 0.02) AS n_failed FROM (SELECT condition, NULL AS tag, gap FROM am UNION ALL SELECT condition, tag, gap FROM tm WHERE seed IS NULL) GROUP BY condition)""")
def h1_axial_gap(spark, sf):
    m = tag_means(spark, sf)
    return vd.h1(conditions(spark, sf), arm_means(spark, sf), m.where("tag = 'depth'"), m.where("tag = 'mean'"), 0.02)


@q("j13_h2_slice_prior", "SELECT r_name AS condition, n_arms, n_at_or_above, CASE WHEN n_at_or_above > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM region JOIN (SELECT a.condition, count(*) AS n_arms, sum(CASE WHEN a.slice >= c.slice THEN 1 ELSE 0 END)::BIGINT AS n_at_or_above FROM am a JOIN tm c ON a.condition = c.condition AND c.tag='centre_prior' GROUP BY 1) ON condition = r_name")
def h2_slice_prior(spark, sf):
    m = tag_means(spark, sf)
    return vd.h2(conditions(spark, sf), arm_means(spark, sf), m.where("tag = 'centre_prior'"), "slice")


UNTRAINED = f"""um AS (SELECT f.*, model, {HALF} AS part FROM flagged f, range(30) m(model)), {random_ctes('um', '1.0::DOUBLE', "'0m' || model", ("0.0::DOUBLE",) * 3, 'ur')},
   ul AS MATERIALIZED (SELECT model, bag_id, part, target, slot, CASE slot WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS score FROM ur, range(3) s(slot)),
   ua AS (SELECT model, slot FROM (SELECT model, slot, avg(x) AS x FROM (SELECT model, slot, bag_id, sum(score*target)/sum(score) AS x FROM ul WHERE part='fit' GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY x DESC, slot) = 1),
   uf AS (SELECT model, auc, patient_id FROM {v.auc('ul', 'model, slot, bag_id', where="part <> 'fit'")} JOIN ua USING (model, slot) JOIN bags USING (bag_id))"""


@q("j14_h3_floor", """SELECT r_name AS condition, round(p95, 4) AS p95, n_inits, CASE WHEN p95 IS NULL THEN 'NOT_RUN' WHEN n_inits < 15 THEN 'VOID' WHEN p95 > 0.55 THEN 'PASS' ELSE 'FAIL' END AS outcome
 FROM region LEFT JOIN (SELECT n_regionkey, quantile_cont(x, 0.95) AS p95, count(x) AS n_inits FROM (SELECT n_regionkey, model, avg(auc) AS x FROM uf JOIN nation ON n_nationkey = patient_id GROUP BY ALL) GROUP BY n_regionkey) ON n_regionkey = r_regionkey""",
   f"{v.FLAG}, {v.BAGS}, {UNTRAINED}")
def h3_floor(spark, sf):
    """The 95th percentile over untrained inits of their mean AUC in a condition."""
    per = rp.untrained_bags(v.flagged(spark, sf), v.SLOTS, v.N_PATCH, 30)
    means = pin(with_condition(per, spark, sf).groupBy("condition", "model").agg(F.avg("auc").alias("auc")))
    return r4(vd.h3(conditions(spark, sf), es.distribution(means, ["condition"], "auc"), 0.55, 15), "p95")


CROSS = f"""{v.FLAG}, {v.BAGS}, {DONOR.format(seed=0, reps=100)}, {SHUF}, cm AS (SELECT s.rep, f.bag_id, f.s1, s.target FROM shuf s JOIN flagged f USING (bag_id, pos)),
 cb AS (SELECT r.bag_id, patient_id, r.auc AS "real", c.x AS "cross", r.auc - c.x AS skill FROM {v.auc('flagged', 'bag_id', 's1')} r JOIN (SELECT bag_id, avg(auc) AS x FROM {v.auc('cm', 'rep, bag_id', 's1')} GROUP BY bag_id) c USING (bag_id) JOIN bags USING (bag_id) WHERE r.auc IS NOT NULL AND x IS NOT NULL),
 cl AS (UNPIVOT (SELECT patient_id, "real", "cross", skill FROM cb) ON "real", "cross", skill INTO NAME quantity VALUE value)"""


@q("j15_cross_patient", f"SELECT quantity, n, n_clusters, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('cl', 'quantity', 'value', reps=10000)}", CROSS)
def cross_patient(spark, sf):
    out = rp.cross_patient(v.flagged(spark, sf), v.bags(spark, sf), v.bag_sizes(spark, sf), "s1", v.N_PATCH, 100, 10000)
    return r6(out, "mean", "lo", "hi")


@q("j15_cross_patient_chain", """SELECT 's1' AS score, "from", "to", round(delta, 6) AS delta, round(CASE WHEN total <> 0 THEN delta/total END, 5) AS frac, kind, n_bags, n_without, round(md, 6) AS mean_over_derangements, consistent FROM st""",
   f"""{CROSS}, {GT}, ft AS (SELECT f.bag_id, target, CAST(template AS DOUBLE) AS tmpl FROM flagged f JOIN gt USING (patch)),
   fa AS (SELECT r.bag_id, r.auc AS "real", c.x AS "cross" FROM {v.auc('flagged', 'bag_id', 's1')} r LEFT JOIN (SELECT bag_id, avg(auc) AS x FROM {v.auc('cm', 'rep, bag_id', 's1')} GROUP BY bag_id) c USING (bag_id) WHERE r.auc IS NOT NULL),
   fx AS MATERIALIZED (SELECT avg("real") FILTER ("cross" IS NOT NULL) AS f, avg("cross") AS c, avg("real" - "cross") AS p, count("cross") AS n_bags, count(*) - count("cross") AS n_without FROM fa),
   kn AS MATERIALIZED (SELECT *, (SELECT avg(m) FROM (SELECT avg(auc) AS m FROM {v.auc('cm', 'rep, bag_id', 's1')} GROUP BY rep)) AS md, (SELECT avg(auc) FROM {v.auc('ft', 'bag_id', 'tmpl')}) AS t, abs(f - c - p) < 1e-9 AS consistent FROM fx),
   st AS (SELECT 'chance' AS "from", 'fitted_template' AS "to", t - 0.5 AS delta, f - 0.5 AS total, 'step' AS kind, * EXCLUDE (f, c, p, t) FROM kn
     UNION ALL SELECT 'fitted_template', 'cross_patient', c - t, f - 0.5, 'step', * EXCLUDE (f, c, p, t) FROM kn
     UNION ALL SELECT 'cross_patient', 'full', f - c, f - 0.5, 'step', * EXCLUDE (f, c, p, t) FROM kn
     UNION ALL SELECT 'chance', 'full', f - 0.5, f - 0.5, 'total', * EXCLUDE (f, c, p, t) FROM kn)""")
def cross_patient_chain(spark, sf):
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1"))).withColumn("template", F.col("template").cast("double"))
    template = rk.auc(tiled.withColumn("n_rows", F.col("n_slices") * F.lit(v.N_PATCH)), ["bag_id"], "template", size="n_rows")
    out = rp.cross_patient_chain(rows, v.bag_sizes(spark, sf), template, "s1", v.N_PATCH, 100)
    return r6(out, "delta", "mean_over_derangements").withColumn("frac", F.round("frac", 5))


@q("j15_cross_patient_axes", f"SELECT axis, quantity, n, n_clusters, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('cl3', 'axis, quantity', 'value', reps=10000)}",
   f"""{v.FLAG}, {v.BAGS}, {DONOR.format(seed=0, reps=100)}, {SHUF},
   al AS MATERIALIZED (SELECT -1 AS rep, bag_id, slice, s1, target, slice_pos FROM flagged UNION ALL
     SELECT s.rep, f.bag_id, f.slice, f.s1, s.target, max(s.target) OVER (PARTITION BY s.rep, f.bag_id, f.slice) FROM shuf s JOIN flagged f USING (bag_id, pos)),
   a3 AS (UNPIVOT {v.axes('al', 'rep, bag_id', 's1')} ON flat, slice, within_slice INTO NAME axis VALUE auc),
   b3 AS (SELECT axis, bag_id, max(auc) FILTER (rep < 0) AS "real", avg(auc) FILTER (rep >= 0) AS "cross" FROM a3 GROUP BY axis, bag_id),
   cl3 AS (UNPIVOT (SELECT axis, patient_id, "real", "cross", "real" - "cross" AS skill FROM b3 JOIN bags USING (bag_id) WHERE "real" IS NOT NULL AND "cross" IS NOT NULL) ON "real", "cross", skill INTO NAME quantity VALUE value)""")
def cross_patient_axes(spark, sf):
    out = rp.cross_patient_axes(v.flagged(spark, sf), v.bags(spark, sf), v.bag_sizes(spark, sf), "s1", v.N_PATCH, 100, 10000)
    return r6(out, "mean", "lo", "hi")


SKL = "sk AS (SELECT a.condition, a.arm, a.seed, (a.flat - c.flat)/(1 - c.flat) AS skill, a.slice, a.flat, c.flat AS den FROM tm a JOIN tm c ON a.condition = c.condition AND c.tag='centre_prior' WHERE a.seed IS NOT NULL)"


def arm_skills(spark, sf):
    ref = tag_means(spark, sf).where("tag = 'centre_prior'").select("condition", F.col("flat").alias("den"))
    return arm_means(spark, sf).join(ref, "condition").withColumn("skill", es.skill(F.col("flat"), F.col("den")))


def skills(spark, sf):
    m = tag_means(spark, sf)
    ref = m.where("tag = 'centre_prior'").select("condition", F.col("flat").alias("den"))
    return m.where(is_arm()).join(ref, "condition").withColumn("skill", es.skill(F.col("flat"), F.col("den")))


@q("j15_h4_verdict", "SELECT condition, round(median(skill), 6) AS median, sum(CASE WHEN skill >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS n_over, count(*) AS n_arms, CASE WHEN sum(CASE WHEN skill >= 0.05 THEN 1 ELSE 0 END) > 0 OR median(skill) >= 0.02 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM sa GROUP BY condition", TAGS)
def h4_verdict(spark, sf):
    return r6(vd.h4(conditions(spark, sf), arm_skills(spark, sf), 0.05, 0.02), "median")


@q("j16_h5_skill", "SELECT condition, round(max(m), 6) AS max_mean, sum(CASE WHEN m > 0.04 THEN 1 ELSE 0 END)::BIGINT AS n_over, sum(s)::BIGINT AS n_seeds_over, count(*) AS n_arms, CASE WHEN max(m) > 0.04 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM (SELECT condition, arm, avg(skill) AS m, sum(CASE WHEN skill > 0.04 THEN 1 ELSE 0 END) AS s FROM sk GROUP BY ALL) GROUP BY condition", f"{TAGS}, {SKL}")
def h5_skill(spark, sf):
    return r6(vd.h5(conditions(spark, sf), skills(spark, sf), 0.04), "max_mean")


@q("j16_floored_denominator", "SELECT condition, arm, round(avg(skill), 6) AS published, round(avg((flat - greatest(den, 0.5))/(1 - greatest(den, 0.5))), 6) AS floored, sum(CASE WHEN den < 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_below_floor, (avg(skill) > 0.04) <> (avg((flat - greatest(den, 0.5))/(1 - greatest(den, 0.5))) > 0.04) AS flips FROM sk GROUP BY ALL", f"{TAGS}, {SKL}")
def floored_denominator(spark, sf):
    rows = vd.floored_skills(skills(spark, sf), "flat", "den", 0.5)
    out = rows.groupBy("condition", "arm").agg(F.avg("published").alias("published"), F.avg("floored").alias("floored"),
                                               F.sum(F.col("below_floor").cast("bigint")).alias("n_below_floor"))
    return r6(out.withColumn("flips", (F.col("published") > 0.04) != (F.col("floored") > 0.04)), "published", "floored")


@q("j17_h6_guidance", "SELECT r_name AS condition, round(a.skill - b.skill, 6) AS delta_skill, round(a.slice - b.slice, 6) AS delta_slice, CASE WHEN a.skill - b.skill >= 0.02 THEN 'FAIL' ELSE 'PASS' END AS outcome FROM region JOIN sa a ON a.condition = r_name AND a.arm='s1' JOIN sa b ON b.condition = r_name AND b.arm='s0'", TAGS)
def h6_guidance(spark, sf):
    s = arm_skills(spark, sf)
    return r6(vd.h6(conditions(spark, sf), s.where("arm = 's1'"), s.where("arm = 's0'"), 0.02), "delta_skill", "delta_slice")


CFM = f"""{v.FLAG}, hv AS (SELECT *, {HALF} AS part FROM flagged), gt AS (SELECT patch, CAST(CAST(sum({v.exact('s1')}) AS DOUBLE)/count(*) AS FLOAT) AS template FROM hv WHERE part='fit' GROUP BY patch),
 te AS MATERIALIZED (SELECT h.*, CAST(template AS DOUBLE) AS tmpl FROM hv h JOIN gt USING (patch) WHERE part<>'fit'), {rolled(6, 4, 'te')}, rt AS (SELECT rep, bag_id, s1, tmpl, r.target FROM rolled r JOIN te USING (bag_id, pos)),
 cf AS (SELECT 'fitted_template' AS member, 0 AS draw, avg(auc) AS auc, avg(auc) AS den FROM {v.auc('te', 'bag_id', 'tmpl')} UNION ALL SELECT 'chance', 0, 0.5::DOUBLE, 0.5::DOUBLE
  UNION ALL SELECT 'roll_permutation', a.rep, a.x, b.x FROM (SELECT rep, avg(auc) AS x FROM {v.auc('rt', 'rep, bag_id', 's1')} GROUP BY rep) a JOIN (SELECT rep, avg(auc) AS x FROM {v.auc('rt', 'rep, bag_id', 'tmpl')} GROUP BY rep) b USING (rep)),
 cs AS (SELECT member, avg((auc - den)/(1 - den)) AS mean, median((auc - den)/(1 - den)) AS median, max((auc - den)/(1 - den)) AS hi, min_by((auc - den)/(1 - den), draw) AS first_draw, count(*) AS n_computable FROM cf GROUP BY member)"""


def content_free(spark, sf):
    rows = rp.content_free_members(v.flagged(spark, sf), "s1", v.N_PATCH, 4, 6)
    return es.draw_summary(rows, ["member"], "skill", "draw")


@q("j18_content_free_members", f"SELECT member, n_computable, {rs('mean', 'median', 'hi', 'first_draw')} FROM cs", CFM)
def content_free_members(spark, sf):
    out = content_free(spark, sf).select("member", "n_computable", "mean", "median", "hi", "first_draw")
    return r6(out, "mean", "median", "hi", "first_draw")


def matched_sql() -> str:
    """Entropy of the score half, the bracket search of f05, then random attention at the scale it ends with."""
    chain = match_sql()
    start, stop = chain.index("probe AS MATERIALIZED"), chain.index(" SELECT round((lo+hi)/2, 5)")
    search = chain[start:stop].replace("FROM ent)", "FROM ent2)")
    ent = SLOT_ENT.replace("ent AS (", "ent2 AS (").replace("FROM flagged", "FROM mhv WHERE part <> 'fit'")
    return f"""{v.FLAG}, mhv AS (SELECT *, {HALF} AS part FROM flagged), {ent}, {search},
 mp AS (SELECT h.*, draw, (lo + hi)/2 AS scale FROM mhv h, b10, range(3) d(draw)), {random_ctes('mp', 'scale', "'8all' || draw", ("0.0::DOUBLE",) * 3, 'mr')},
 mt AS (SELECT draw, patch, CAST(CAST(avg(r0) AS FLOAT) AS DOUBLE) AS den FROM mr WHERE part = 'fit' GROUP BY draw, patch),
 ms AS MATERIALIZED (SELECT draw, bag_id, target, r0, den, scale FROM mr JOIN mt USING (draw, patch) WHERE part <> 'fit'),
 mm AS (SELECT draw, a.x AS auc, b.x AS denominator FROM (SELECT draw, avg(auc) AS x FROM {v.auc('ms', 'draw, bag_id', 'r0')} GROUP BY draw) a JOIN (SELECT draw, avg(auc) AS x FROM {v.auc('ms', 'draw, bag_id', 'den')} GROUP BY draw) b USING (draw))"""


def entropy_members(spark, sf):
    """Random attention at the entropy of three slots; an arm with one slot is not computable."""
    probe = spark.range(4096).select(*[draws.normal("probe", F.col("id"), j).alias(f"z{j}") for j in range(3)])
    return rp.entropy_matched_members(v.flagged(spark, sf), {"all": v.SLOTS, "single": v.SLOTS[:1]}, probe, ["z0", "z1", "z2"], v.N_PATCH, 3, 8)


@query("j18_entropy_matched", f"""WITH {matched_sql()} SELECT 'all' AS arm, draw::INTEGER AS draw, TRUE AS computable, round((SELECT (lo + hi)/2 FROM b10), 3) AS scale, round(auc, 4) AS auc, round(denominator, 4) AS denominator, round((auc - denominator)/(1 - denominator), 4) AS skill FROM mm
 UNION ALL SELECT 'single', NULL, FALSE, NULL, NULL, NULL, NULL""")
def entropy_matched(spark, sf):
    out = entropy_members(spark, sf)
    return r4(out.select("arm", "draw", "computable", F.round("scale", 3).alias("scale"), "auc", "denominator", "skill"), "auc", "denominator", "skill")


H7_WORST = "greatest((SELECT max(mean) FROM cs), (SELECT avg((auc - denominator)/(1 - denominator)) FROM mm))"


@q("j18_h7_verdict", f"SELECT 'study' AS condition, round((p.x - 0.5)/0.5, 4) AS probe_skill, round({H7_WORST}, 4) AS worst, 4::BIGINT AS n_members, 4::BIGINT AS n_computed, CASE WHEN (p.x - 0.5)/0.5 > 0.5 AND {H7_WORST} < 0.1 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM p",
   f"{CFM}, {matched_sql().removeprefix(v.FLAG + ', ')}, p AS (SELECT avg(auc) AS x FROM {v.auc('(SELECT *, target + 0.001::DOUBLE * s1 AS sup FROM flagged)', 'bag_id', 'sup')})")
def h7_verdict(spark, sf):
    """Chance, roll permutation, fitted template and entropy-matched random attention as content-free members."""
    matched = entropy_members(spark, sf).where("computable").groupBy("arm").agg(F.avg("skill").alias("skill"))
    members = content_free(spark, sf).select(F.lit("study").alias("condition"), F.col("mean").alias("skill"))
    members = members.unionByName(matched.select(F.lit("study").alias("condition"), "skill"))
    rows = sized(spark, sf).withColumn("sup", F.col("target") + F.lit(0.001) * F.col("s1"))
    probe = rk.auc(rows, ["bag_id"], "sup", size="n_rows").agg(F.avg("auc").alias("x"))
    probe = probe.select(F.lit("study").alias("condition"), es.skill(F.col("x"), F.lit(0.5)).alias("skill"))
    study = probe.select("condition")
    return r4(vd.h7(study, probe, members, 0.5, 0.1), "probe_skill", "worst")


@q("j19_h8_verdict", f"""SELECT r_name AS condition, round(x, 6) AS value, x > 0.5 AS exceeds, CASE WHEN x IS NULL THEN 'NOT_RUN' ELSE 'REPORTED' END AS outcome
 FROM region LEFT JOIN (SELECT n_regionkey, avg(auc) AS x FROM {v.auc('rr', 'slot, region, bag_id')} JOIN bags USING (bag_id) JOIN nation ON n_nationkey = patient_id WHERE slot = 0 AND region = 'inside' GROUP BY 1) ON n_regionkey = r_regionkey""",
   f"{REG}, {v.BAGS}")
def h8_verdict(spark, sf):
    """The template's AUC inside the region."""
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1"))).withColumn("s_0", F.col("template").cast("double"))
    inside = rp.in_region(tiled, ["s_0"], 0.3, v.N_PATCH, v.GRID, 4).where("region = 'inside' AND NOT stratified")
    value = with_condition(inside.select("bag_id", "auc"), spark, sf).groupBy("condition").agg(F.avg("auc").alias("value"))
    return r6(vd.h8(conditions(spark, sf), value, 0.5), "value")


H9B = v.bootstrap("fl9", "condition, tag", "flat", reps=10000)


@q("j20_h9_ordering", f"""SELECT a.tag, a.condition AS cond_a, b.condition AS cond_b, CASE WHEN a.lo IS NULL OR b.lo IS NULL THEN 'VOID' WHEN a.hi < b.lo AND coalesce(sa.skill > sb.skill, TRUE) THEN 'PASS' ELSE 'FAIL' END AS outcome,
 CASE WHEN a.lo IS NULL OR b.lo IS NULL THEN 'undefined' WHEN a.hi < b.lo AND coalesce(sa.skill > sb.skill, TRUE) THEN 'ordered' WHEN b.hi < a.lo THEN 'reversed' WHEN a.hi < b.lo THEN 'skill disagrees' ELSE 'indistinguishable' END AS basis,
 round(a.hi, 6) AS hi_a, round(b.lo, 6) AS lo_b, round(sa.skill, 6) AS skill_a, round(sb.skill, 6) AS skill_b
 FROM b9 a JOIN b9 b ON a.tag = b.tag AND a.condition < b.condition LEFT JOIN sk9 sa ON sa.tag = a.tag AND sa.condition = a.condition LEFT JOIN sk9 sb ON sb.tag = b.tag AND sb.condition = b.condition""",
   f"{TAGS}, fl9 AS (SELECT * FROM ta WHERE seed IS NOT NULL), b9 AS MATERIALIZED (SELECT * FROM {H9B}), sk9 AS (SELECT a.condition, a.tag, (a.flat - c.flat)/(1 - c.flat) AS skill FROM tm a JOIN tm c ON a.condition = c.condition AND c.tag='centre_prior' WHERE a.seed IS NOT NULL)")
def h9_ordering(spark, sf):
    """Every pair of conditions in the order of their names, for every arm run."""
    ci = es.cluster_bootstrap(tag_axes(spark, sf).where(is_arm()), ["condition", "tag"], "flat", "patient_id", 10000)
    ci = ci.join(skills(spark, sf).select("condition", "tag", "skill"), ["condition", "tag"], "left")

    def side(s):
        return ci.select("tag", *[F.col(c).alias(f"{n}_{s}") for c, n in (("condition", "cond"), ("lo", "lo"), ("hi", "hi"), ("skill", "skill"))])
    pairs = side("a").join(side("b"), "tag").where("cond_a < cond_b")  # conditions are a declared list
    return r6(vd.h9(pairs).select("tag", "cond_a", "cond_b", "outcome", "basis", "hi_a", "lo_b", "skill_a", "skill_b"), "hi_a", "lo_b", "skill_a", "skill_b")


D10 = "d10 AS (SELECT r_name AS condition, m.patient_id, m.flat - t.flat AS delta FROM fax m JOIN fax t ON m.bag_id = t.bag_id AND t.scorer = 'trained' AND m.scorer = 'masks:separable' JOIN nation ON n_nationkey = m.patient_id JOIN region ON r_regionkey = n_regionkey)"


def h10_rows(spark, sf):
    """The declared mask-fitted member against the arm, per condition."""
    fax = family_axes(spark, sf)
    arm = fax.where("scorer = 'trained'").select("bag_id", F.col("flat").alias("_arm"))
    d = fax.where("scorer = 'masks:separable'").join(arm, "bag_id").select("bag_id", (F.col("flat") - F.col("_arm")).alias("delta"))
    ci = es.cluster_bootstrap(with_condition(d, spark, sf), ["condition"], "delta", "patient_id", 10000)
    return ci.withColumn("interval", es.interval_outcome(F.col("lo"), F.col("hi")))


@q("j21_h10_outcomes", f"""SELECT r_name AS condition, n_scored, oracle_wins, indistinguishable, trained_wins, CASE WHEN n_scored IS NULL THEN 'NOT_RUN' WHEN trained_wins >= n_scored//2 + 1 THEN 'FAIL' ELSE 'PASS' END AS outcome
 FROM region LEFT JOIN (SELECT condition, count(o) AS n_scored, sum(CASE WHEN o='oracle_wins' THEN 1 ELSE 0 END)::BIGINT AS oracle_wins, sum(CASE WHEN o='indistinguishable' THEN 1 ELSE 0 END)::BIGINT AS indistinguishable, sum(CASE WHEN o='trained_wins' THEN 1 ELSE 0 END)::BIGINT AS trained_wins
  FROM (SELECT condition, {OUTCOME} AS o FROM {v.bootstrap('d10', 'condition', 'delta', reps=10000)}) GROUP BY condition) ON condition = r_name""", f"{FAMILY}, {D10}")
def h10_outcomes(spark, sf):
    return vd.h10(conditions(spark, sf), h10_rows(spark, sf))


VERDICTS = {"H1": "j12_h1_axial_gap", "H2": "j13_h2_slice_prior", "H3": "j14_h3_floor", "H4": "j15_h4_verdict", "H5": "j16_h5_skill", "H6": "j17_h6_guidance",
            "H7": "j18_h7_verdict", "H8": "j19_h8_verdict", "H9": "j20_h9_ordering", "H10": "j21_h10_outcomes"}
_ALL = " UNION ALL ".join(f"SELECT '{h}' AS h, {'NULL' if h in ('H7', 'H9') else 'condition'} AS condition, outcome FROM ({ORACLES[n]})" for h, n in VERDICTS.items())
_WORST = "CASE WHEN bool_or(outcome = 'VOID') THEN 'VOID' WHEN bool_or(outcome = 'FAIL') THEN 'FAIL' WHEN bool_or(outcome = 'PASS') THEN 'PASS' ELSE 'NOT_RUN' END"


@query("j29_verdict_matrix", f"""WITH every AS MATERIALIZED ({_ALL}), one AS (SELECT h, condition, {_WORST} AS o FROM every WHERE condition IS NULL GROUP BY ALL UNION ALL SELECT h, condition, outcome FROM every WHERE condition IS NOT NULL)
 SELECT r_name AS condition, {', '.join(f"coalesce(max(o) FILTER (h = '{h}'), 'NOT_RUN') AS {chr(34)}{h}{chr(34)}" for h in VERDICTS)} FROM region LEFT JOIN one ON condition = r_name OR condition IS NULL GROUP BY r_name""")
def verdict_matrix(spark, sf):
    """All ten hypotheses. H7 and H9 are outcomes of the study: they stand in every row, H9 as the worst of its declared pairs."""
    where = conditions(spark, sf)
    out = None
    for h, name in VERDICTS.items():
        one = QUERIES[name](spark, sf)
        if h in ("H7", "H9"):
            one = where.withColumn("outcome", one.agg(vd.worst("outcome")).scalar())
        one = one.select("condition", F.lit(h).alias("hypothesis"), "outcome")
        out = one if out is None else out.unionByName(one)
    return vd.verdict_matrix(out, list(VERDICTS))


@q("j36_beside_the_gate", f"SELECT tag, round(avg(flat), 6) AS auc, round((avg(flat) - d)/(1 - d), 6) AS skill FROM ta, (SELECT avg(flat) AS d FROM ta WHERE tag='centre_prior') WHERE tag IN ('depth', 'mean') GROUP BY tag, d")
def beside_the_gate(spark, sf):
    t = tag_axes(spark, sf)
    den = t.where("tag = 'centre_prior'").agg(F.avg("flat")).scalar()
    out = t.where(F.col("tag").isin("depth", "mean")).groupBy("tag").agg(F.avg("flat").alias("auc")).withColumn("_d", den)
    return r6(out.select("tag", "auc", es.skill(F.col("auc"), F.col("_d")).alias("skill")), "auc", "skill")


@q("j30_untrained_floor", f"SELECT model::INTEGER AS model, n, n_clusters, {', '.join(f'round({c}, 4) AS {c}' for c in ('mean', 'lo', 'hi'))} FROM {v.bootstrap('uf', 'model', 'auc', reps=10000)}",
   f"{v.FLAG}, {v.BAGS}, {UNTRAINED}")
def untrained_floor(spark, sf):
    out = rp.untrained_floor(v.flagged(spark, sf), v.bags(spark, sf), v.SLOTS, v.N_PATCH, 30, 10000)
    return r4(out, "mean", "lo", "hi")


@q("j31_control_tables", "SELECT condition, arm, round(avg(flat), 6) AS flat, round(avg(slice), 6) AS slice, round(avg(within_slice), 6) AS within_slice, count(*) AS n FROM ta WHERE seed IS NOT NULL GROUP BY GROUPING SETS ((condition, arm), (condition), (arm))")
def control_tables(spark, sf):
    t = tag_axes(spark, sf).where(is_arm())
    c, a = F.col("condition"), F.col("arm")
    out = t.groupingSets([(c, a), (c,), (a,)], c, a).agg(*[F.avg(x).alias(x) for x in AX], count().alias("n"))
    return r6(out, *AX)


CONTROL = f"""{v.FLAG}, {v.BAGS}, {RADIAL},
 cr AS MATERIALIZED (SELECT x.*, rbin FROM ({' UNION ALL '.join(f"SELECT '{a}' AS arm, {s} AS seed, bag_id, slice, patch, target, slice_pos, {a}{' + 0.1::DOUBLE * ' + U1 if s else ''} AS score FROM flagged" for a in ARMS3 for s in (0, 1))}) x JOIN rb USING (patch)),
 cm AS (SELECT arm, seed, bag_id, 'raw' AS mode, auc, n_pos * n_neg AS w FROM {v.auc('cr', 'arm, seed, bag_id')}
  UNION ALL SELECT arm, seed, bag_id, 'slice', auc, n_pos * n_neg FROM {v.auc('cr', 'arm, seed, bag_id', where='slice_pos = 1')}
  UNION ALL SELECT arm, seed, bag_id, 'radial', auc, n_pos * n_neg FROM {v.auc('cr', 'arm, seed, bag_id, rbin')}
  UNION ALL SELECT arm, seed, bag_id, 'joint', auc, n_pos * n_neg FROM {v.auc('cr', 'arm, seed, bag_id, slice, rbin')}),
 cb AS MATERIALIZED (SELECT arm, seed, bag_id, mode, sum(auc * w)/nullif(sum(w), 0) AS auc, sum(w)::BIGINT AS n_pairs FROM cm GROUP BY ALL),
 cs AS MATERIALIZED (SELECT r_name AS condition, arm, seed, mode, avg(auc) AS auc, count(auc) AS n_bags FROM cb JOIN bags USING (bag_id) JOIN nation ON n_nationkey = patient_id JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)"""


def control_bags(spark, sf):
    """Every bag under four stratifications, written once."""
    key = ("control_bags", sf)
    if is_materialised(spark, key):
        return reopen(spark, key)
    rows = sl.with_radial_bin(v.flagged(spark, sf), v.N_PATCH, v.GRID, 4)
    per = by_tag(bw.stratified_axes(rows, v.N_PATCH, arm_scores())).drop("tag")
    return materialise(with_condition(per, spark, sf), key)


@query("j31_stratified_pairs", f"WITH {CONTROL} SELECT arm, seed, mode, sum(n_pairs)::BIGINT AS n_pairs, count(auc) AS n_bags, round(avg(auc), 6) AS auc FROM cb GROUP BY ALL")
def stratified_pairs(spark, sf):
    out = control_bags(spark, sf).groupBy("arm", "seed", "mode").agg(F.sum("n_pairs").alias("n_pairs"), F.count("auc").alias("n_bags"), F.avg("auc").alias("auc"))
    return r6(out, "auc")


@query("j31_stratified_seeds", f"WITH {CONTROL} SELECT condition, arm, seed, mode, n_bags, round(auc, 6) AS auc FROM cs")
def stratified_seeds(spark, sf):
    return r6(rp.control_seeds(control_bags(spark, sf)), "auc")


@query("j31_stratified_arms", f"WITH {CONTROL} SELECT condition, arm, mode, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS sd, count(auc) AS n_seeds FROM cs GROUP BY ALL")
def stratified_arms(spark, sf):
    return r6(rp.control_arms(rp.control_seeds(control_bags(spark, sf))), "mean", "sd")


@query("j31_stratified_deltas", f"""WITH {CONTROL}, dr AS (SELECT condition, mode, arm, auc FROM cs WHERE arm IN ('s1', 's0') AND auc IS NOT NULL UNION ALL SELECT NULL, mode, arm, auc FROM cs WHERE arm IN ('s1', 's0') AND auc IS NOT NULL),
 ds AS (SELECT condition, mode, avg(auc) FILTER (arm='s1') AS m1, avg(auc) FILTER (arm='s0') AS m2, var_samp(auc) FILTER (arm='s1') AS v1, var_samp(auc) FILTER (arm='s0') AS v2, count(*) FILTER (arm='s1') AS n1, count(*) FILTER (arm='s0') AS n2 FROM dr GROUP BY ALL),
 dt AS (SELECT *, (m1-m2)/sqrt(v1/n1+v2/n2) AS t, (v1/n1+v2/n2)**2/((v1/n1)**2/(n1-1)+(v2/n2)**2/(n2-1)) AS df FROM ds), dp AS (SELECT *, {p_t('t', 'df')} AS p FROM dt)
 SELECT condition, mode, n1, n2, round(m1 - m2, 6) AS delta, round(t, 4) AS t, round(p, 3) AS p FROM dp""")
def stratified_deltas(spark, sf):
    out = rp.control_deltas(rp.control_seeds(control_bags(spark, sf)), "s1", "s0")
    return r6(out, "delta").withColumns({"t": F.round("t", 4), "p": F.round("p", 3)})


@query("j32_null_report", battery_sql().replace("SELECT \"null\", round(avg(auc), 4) AS mean, round(stddev_pop(auc), 4) AS std, round(min(auc), 4) AS lo, round(max(auc), 4) AS hi, count(*) AS n_reps FROM allr GROUP BY \"null\"", "SELECT \"null\", round(avg(auc), 4) AS mean, round(avg(auc) - 0.5, 4) AS above_half, round((SELECT auc FROM main WHERE \"null\"='reference') - avg(auc), 4) AS below_reference FROM allr GROUP BY \"null\""))
def null_report(spark, sf):
    b = nr.null_battery(v.flagged(spark, sf), v.bag_sizes(spark, sf), v.SLOTS, v.N_PATCH, 2, 2)
    ref = b.where(F.col("null") == "reference").select("mean").scalar()
    out = b.withColumn("_r", ref)
    return r4(out.select("null", "mean", (F.col("mean") - 0.5).alias("above_half"), (F.col("_r") - F.col("mean")).alias("below_reference")), "mean", "above_half", "below_reference")


@query("j33_alignment_report")
def alignment_report(spark, sf):
    return r6(rp.alignment_report(halves(spark, sf), v.SLOTS, "n_rows"), "value")


@query("j34_probe_gate")
def probe_gate(spark, sf):
    rows = v.flagged(spark, sf).withColumn("x", F.array("s0", "s1", "s2", "coverage")).withColumn("part", draws.half(F.col("bag_id")))
    fit, rest = rows.where("part = 'fit'"), rows.where("part <> 'fit'")
    kept = ["bag_id", "pos", "slice", "patch", "n_slices", "target", "x"]
    model = pl.fit_probe(pl.probe_fit_set(fit.select(*kept), 2, 0), "x")
    return r6(rp.probe_gate(model, fit.select(*kept), rest.select(*kept), "x", v.N_PATCH, 0.1), *AX, "skill")


@q("j35_independent_recomputation", f"""SELECT a.bag_id, a.n_pos, a.n_neg, round(a.auc, 6) AS auc, round(p.won, 1) AS won
 FROM {v.auc('flagged', 'bag_id', 's1')} a LEFT JOIN (SELECT p.bag_id, sum(CASE WHEN p.s1 > q.s1 THEN 1.0::DOUBLE WHEN p.s1 = q.s1 THEN 0.5 ELSE 0.0 END) AS won
  FROM flagged p JOIN flagged q ON p.bag_id = q.bag_id AND p.target = 1 AND q.target = 0 GROUP BY p.bag_id) p USING (bag_id)""", v.FLAG)
def independent_recomputation(spark, sf):
    """AUC from the bucketed histograms, and the won pairs from the ranking in place: the SQL counts the pairs one by one."""
    rows = sized(spark, sf)
    a = rk.auc(rows, ["bag_id"], "s1", hot_rows=0, size="n_rows").select("bag_id", "n_pos", "n_neg", "auc")
    b = rk.auc(rows, ["bag_id"], "s1", size="n_rows").select("bag_id", F.when(F.col("n_pos") * F.col("n_neg") > 0, F.round(F.col("conc2") / 2, 1)).alias("won"))
    return r6(a.join(b, "bag_id"), "auc")
