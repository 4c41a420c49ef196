"""Per-bag ranking metrics and position-only references over the line-item instances."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.functions import geometry as geo
from patchrank.operators import estimands as es
from patchrank.operators import ranking as rk
from patchrank.operators import slots as sl
from patchrank.operators import templates as tp
from patchrank.plans import atlas as at

from . import views as v
from .registry import query, r6, rs

AX = ("flat", "slice", "within_slice")

CENTRE = """(CAST(-sqrt(z*z + ip*ip) AS FLOAT))"""


def centre_cte(source: str, name: str = "centre") -> str:
    """Rows of ``source`` scored by the centre prior."""
    y = "(-1.0::DOUBLE + CAST(patch // 4 AS DOUBLE) * (2.0::DOUBLE / 3.0::DOUBLE))"
    x = "(-1.0::DOUBLE + CAST(patch % 4 AS DOUBLE) * (2.0::DOUBLE / 3.0::DOUBLE))"
    z = "(-1.0::DOUBLE + CAST(slice AS DOUBLE) * (2.0::DOUBLE / CAST(greatest(n_slices - 1, 1) AS DOUBLE)))"
    return f"""{name} AS (SELECT * EXCLUDE (z, ip), CAST(CAST(-sqrt(z*z + ip*ip) AS FLOAT) AS DOUBLE) AS score
      FROM (SELECT *, {z} AS z, sqrt({y}*{y} + {x}*{x}) AS ip FROM {source}))"""


def family_ctes(fit: str, value: str, name: str = "fam", bins: int = 8) -> str:
    """Template family fitted on the rows of ``fit``."""
    return f"""{name}_cells AS (SELECT least(slice * {bins} // n_slices, {bins - 1}) AS bin, patch,
        sum({v.exact(value)}) AS total, count(*) AS cells FROM {fit} GROUP BY 1, 2),
     {name}_grid AS (SELECT b.bin, p.patch, total, cells
        FROM range({bins}) b(bin) CROSS JOIN range(16) p(patch)
        LEFT JOIN {name}_cells c ON c.bin = b.bin AND c.patch = p.patch),
     {name} AS (SELECT bin, patch, cells IS NOT NULL AS observed,
        coalesce(CAST(sum(total) OVER (PARTITION BY patch) AS DOUBLE) / sum(cells) OVER (PARTITION BY patch), g) AS inplane,
        coalesce(CAST(sum(total) OVER (PARTITION BY bin) AS DOUBLE) / sum(cells) OVER (PARTITION BY bin), g) AS axial,
        coalesce(CAST(total AS DOUBLE) / cells, g) AS joint
       FROM {name}_grid, (SELECT CAST(sum(total) AS DOUBLE) / sum(cells) AS g FROM {name}_cells))"""


def apply_cte(rows: str, fam: str = "fam", name: str = "scored", bins: int = 8) -> str:
    return f"""{name}_wide AS (SELECT i.*, f.inplane, f.axial, f.joint, f.axial * f.inplane AS separable
        FROM {rows} i JOIN {fam} f ON f.bin = least(i.slice * {bins} // i.n_slices, {bins - 1}) AND f.patch = i.patch),
     {name} AS MATERIALIZED (SELECT * EXCLUDE (inplane, axial, joint, separable, raw),
        CAST(CAST(raw AS FLOAT) AS DOUBLE) AS score FROM (
         {' UNION ALL '.join(f"SELECT *, '{m}' AS scorer, {m} AS raw FROM {name}_wide" for m in tp.MEMBERS)}))"""


HALF = "CASE WHEN CAST('0x' || right(sha256(CAST(bag_id AS VARCHAR)), 1) AS INTEGER) % 2 = 0 THEN 'fit' ELSE 'score' END"

ATLAS_CTES = f"""{v.FLAG}, {v.BAGS},
 halves AS (SELECT *, {HALF} AS part FROM flagged),
 fitrows AS (SELECT * FROM halves WHERE part = 'fit'),
 rest AS (SELECT * FROM halves WHERE part = 'score'),
 {family_ctes('fitrows', 'target')}, {apply_cte('rest')}, {centre_cte('rest')},
 allrows AS (SELECT scorer, bag_id, slice, target, slice_pos, score FROM scored
   UNION ALL SELECT 'centre_prior', bag_id, slice, target, slice_pos, score FROM centre),
 ax AS MATERIALIZED (SELECT * FROM {v.axes('allrows', 'scorer, bag_id')}),
 axl AS (UNPIVOT ax ON flat, slice, within_slice INTO NAME axis VALUE value)"""


@query("e11_confound_atlas", f"""WITH {ATLAS_CTES}
 SELECT scorer, axis, n, n_clusters, {rs('mean', 'lo', 'hi')}
 FROM {v.bootstrap('(SELECT axl.*, patient_id FROM axl JOIN bags USING (bag_id))', 'scorer, axis', 'value')}""")
def confound_atlas(spark, sf):
    rows = v.flagged(spark, sf)
    out = at.confound_atlas(rows, v.bags(spark, sf), v.N_PATCH, v.GRID, v.N_BINS, reps=10000)
    return r6(out, "mean", "lo", "hi")


@query("e11_atlas_coverage", f"""WITH {v.INST}, c AS (SELECT bag_id, {HALF} AS half, max(target) AS hi, min(target) AS lo, count(*) AS n FROM inst GROUP BY bag_id)
 SELECT half, count(*) AS n_cases, count(*) FILTER (n % 16 = 0 AND hi = 1 AND lo = 0) AS n_kept, count(*) FILTER (n % 16 = 0 AND hi = 0) AS n_no_lesion,
  count(*) FILTER (n % 16 = 0 AND lo = 1) AS n_no_background, count(*) FILTER (n % 16 <> 0) AS n_ragged FROM c GROUP BY half""")
def atlas_coverage(spark, sf):
    return at.atlas_coverage(v.instances(spark, sf), v.N_PATCH)


@query("e11_atlas_axes", f"WITH {ATLAS_CTES} SELECT scorer, bag_id, n_slices, n_lesion_slices, "
       f"{rs(*AX)} FROM ax")
def atlas_axes(spark, sf):
    out = at.atlas_axes(v.flagged(spark, sf), v.N_PATCH, v.GRID, v.N_BINS)
    return r6(out, *AX)


def sized(spark, sf):
    return v.flagged(spark, sf)


LONG = f"""{v.FLAG}, long AS MATERIALIZED (SELECT bag_id, pos, slice, patch, n_slices, target, slice_pos, 0 AS slot, s0 AS score FROM flagged
  UNION ALL SELECT bag_id, pos, slice, patch, n_slices, target, slice_pos, 1, s1 FROM flagged
  UNION ALL SELECT bag_id, pos, slice, patch, n_slices, target, slice_pos, 2, s2 FROM flagged)"""
LONGMAX = LONG + """, longmax AS MATERIALIZED (SELECT bag_id, target, slot, score FROM long
  UNION ALL SELECT bag_id, target, -1, greatest(s0, s1, s2) FROM flagged)"""
AP = """(SELECT bag_id{k}, sum(p * cp / cn)::DOUBLE / sum(p) AS avg_precision, sum(p)::DOUBLE / sum(n) AS prevalence,
   sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n
  FROM (SELECT *, sum(p) OVER w::DOUBLE AS cp, sum(n) OVER w::DOUBLE AS cn
    FROM (SELECT bag_id{k}, {s} AS sc, sum(target) AS p, count(*) AS n FROM {src} GROUP BY ALL)
    WINDOW w AS (PARTITION BY bag_id{k} ORDER BY sc DESC)) GROUP BY ALL)"""
AP1 = AP.format(k="", s="s1", src="flagged")


@query("d01_auc_per_bag", f"WITH {v.FLAG} SELECT bag_id, n_pos, n_neg, {rs('auc')} FROM {v.auc('flagged', 'bag_id', 's0')}")
def auc_per_bag(spark, sf):
    return r6(rk.auc(sized(spark, sf), ["bag_id"], "s0", size="n_rows").drop("conc2"), "auc")


@query("d01_auc_pooled", f"WITH {v.FLAG} SELECT n_pos, n_neg, {rs('auc')} FROM {v.auc('flagged', '', 's1')}")
def auc_pooled(spark, sf):
    return r6(rk.auc(v.flagged(spark, sf), [], "s1").drop("conc2"), "auc")


@query("d02_axes", f"WITH {v.FLAG} SELECT bag_id, n_slices, n_lesion_slices, {rs(*AX)} FROM {v.axes('flagged', 'bag_id', 's1')}")
def axes(spark, sf):
    return r6(rk.axes(v.flagged(spark, sf), v.N_PATCH, ["bag_id"], "s1"), *AX)


HOSTILE = f"""{v.FLAG}, hostile AS (SELECT bag_id, CASE WHEN pos % 11 <> 0 THEN target END AS target, CASE pos % 6 WHEN 0 THEN 'infinity'::DOUBLE WHEN 1 THEN '-infinity'::DOUBLE
  WHEN 2 THEN s1 * 1e-20::DOUBLE WHEN 3 THEN 1.0::DOUBLE - s1 * 1e-9::DOUBLE WHEN 4 THEN s1 * 1e200::DOUBLE ELSE s1 END AS score FROM flagged)"""


@query("d01_hostile_scores", f"WITH {HOSTILE} SELECT bag_id, n_pos, n_neg, {rs('auc')} FROM {v.auc('hostile', 'bag_id', where='target IS NOT NULL')}")
def hostile_scores(spark, sf):
    """Infinite, tiny, huge and saturated scores, unlabelled rows, and bags of unknown size."""
    pick = F.col("pos") % 6
    inf = F.lit(float("inf"))
    score = (F.when(pick == 0, inf).when(pick == 1, -inf).when(pick == 2, F.col("s1") * F.lit(1e-20)).when(pick == 3, F.lit(1.0) - F.col("s1") * F.lit(1e-9))
             .when(pick == 4, F.col("s1") * F.lit(1e200)).otherwise(F.col("s1")))
    rows = v.flagged(spark, sf).withColumns({"score": score, "target": F.when(F.col("pos") % 11 != 0, F.col("target")),
                                             "n_rows": F.when(F.col("bag_id") % 3 != 0, F.col("n_rows"))})
    return r6(rk.auc(rows, ["bag_id"], size="n_rows").drop("conc2"), "auc")


@query("d02_tiny_scores", f"WITH {v.FLAG} SELECT bag_id, n_slices, n_lesion_slices, {rs(*AX)} FROM {v.axes('flagged', 'bag_id', 's1')}")
def tiny_scores(spark, sf):
    """Scores in units of 2**-70 have the axes of the same scores in units of one, which the SQL computes."""
    rows = v.flagged(spark, sf).withColumn("s1", F.col("s1") * F.lit(2.0 ** -70))
    return r6(rk.axes(rows, v.N_PATCH, ["bag_id"], "s1"), *AX)


REPORT = f"""bagrep AS (SELECT bag_id, max(CASE WHEN slot=1 THEN auc END) AS fr, max(CASE WHEN slot=-1 THEN auc END) AS ov,
   max(CASE WHEN slot>=0 THEN auc END) AS orc FROM {v.auc('longmax', 'bag_id, slot')} WHERE auc IS NOT NULL GROUP BY bag_id)"""


@query("d03_slot_report", f"""WITH {LONGMAX}, {REPORT}, ap AS {AP1},
 res AS (SELECT avg(fr) AS auc_frozen_slot, stddev_pop(fr)/sqrt(count(*)) AS auc_sem, avg(ov) AS auc_max_over_slots,
   avg(orc) AS auc_oracle_slot, avg(avg_precision) AS avg_precision, avg(prevalence) AS prevalence,
   avg(avg_precision)/greatest(avg(prevalence), 1e-12) AS ap_lift, count(*) AS n_bags FROM bagrep JOIN ap USING (bag_id))
 SELECT {rs('auc_frozen_slot', 'auc_sem', 'auc_max_over_slots', 'auc_oracle_slot', 'avg_precision', 'prevalence', 'ap_lift')}, n_bags FROM res""")
def slot_report(spark, sf):
    out = sl.slot_report(sized(spark, sf), v.SLOTS, 1, size="n_rows")
    return r6(out, *[c for c in out.columns if c != "n_bags"])


@query("d04_auc_per_slot", f"""WITH {LONG}, x AS (SELECT slot, avg(auc) AS mean_auc, count(auc) AS n_bags FROM {v.auc('long', 'bag_id, slot')} GROUP BY slot)
 SELECT slot, {rs('mean_auc')}, n_bags FROM x""")
def auc_per_slot(spark, sf):
    per = sl.slot_auc(sized(spark, sf), v.SLOTS, size="n_rows")
    return r6(per.groupBy("slot").agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_bags")), "mean_auc")


@query("d05_instance_auc", f"WITH {LONGMAX} SELECT bag_id, slot, {rs('auc')} FROM {v.auc('longmax', 'bag_id, slot')}")
def instance_auc(spark, sf):
    return r6(sl.slot_auc(sized(spark, sf), v.SLOTS, with_max=True, size="n_rows").select("bag_id", "slot", "auc"), "auc")


@query("d06_average_precision", f"WITH {v.FLAG} SELECT bag_id, n_pos, n, {rs('avg_precision', 'prevalence')} FROM {AP1}")
def average_precision(spark, sf):
    return r6(rk.average_precision(sized(spark, sf), ["bag_id"], "s1", size="n_rows"), "avg_precision", "prevalence")


RADIAL = """cellr AS (SELECT patch, sqrt((patch//4 - 1.5::DOUBLE)*(patch//4 - 1.5::DOUBLE) + (patch%4 - 1.5::DOUBLE)*(patch%4 - 1.5::DOUBLE)) AS radius FROM range(16) p(patch)),
 edges AS (SELECT unnest(quantile_cont(radius, [0.25, 0.5, 0.75])) AS e FROM cellr),
 rb AS (SELECT patch, radius, (SELECT count(*) FROM edges WHERE e <= radius) AS rbin, (SELECT count(*) FROM edges WHERE e < radius) AS rbin_right FROM cellr)"""


def strat_sql(keys: str, strata: str, src: str, score: str) -> str:
    k = f"{keys}, {strata}" if strata else keys
    return f"""(SELECT {keys}, sum(auc * n_pos * n_neg) / nullif(sum(n_pos * n_neg), 0) AS auc, sum(n_pos * n_neg)::BIGINT AS n_pairs,
      sum(CASE WHEN n_pos * n_neg > 0 THEN 1 ELSE 0 END)::BIGINT AS n_strata_used, count(*) AS n_strata_total
      FROM {v.auc(src, k, score)} GROUP BY {keys})"""


@query("d07_stratified_auc", f"""WITH {v.FLAG}, {RADIAL}, rows AS (SELECT f.*, rbin FROM flagged f JOIN rb USING (patch))
 SELECT bag_id, n_pairs, n_strata_used, n_strata_total, {rs('auc')} FROM {strat_sql('bag_id', 'slice, rbin', 'rows', 's1')}""")
def stratified(spark, sf):
    rows = sl.with_radial_bin(sized(spark, sf), v.N_PATCH, v.GRID, 4)
    return r6(rk.stratified_auc(rows, ["bag_id"], ["slice", "rbin"], "s1", size="n_rows"), "auc")


STRATA = {"raw": "", "slice": "slice", "radial": "rbin", "joint": "slice, rbin"}


@query("d08_strata_compared", f"""WITH {v.FLAG}, {RADIAL}, rows AS (SELECT f.*, rbin FROM flagged f JOIN rb USING (patch))
 {' UNION ALL '.join(f"SELECT '{n}' AS strata, count(auc) AS n_bags, round(avg(auc), 6) AS auc, sum(n_pairs)::BIGINT AS n_pairs FROM {strat_sql('bag_id', s, 'rows', 's1')}" for n, s in STRATA.items())}""")
def strata_compared(spark, sf):
    rows = sl.with_radial_bin(sized(spark, sf), v.N_PATCH, v.GRID, 4)
    out = None
    for name, cols in STRATA.items():
        per = rk.stratified_auc(rows, ["bag_id"], [c.strip() for c in cols.split(",") if c], "s1", size="n_rows")
        one = per.agg(F.count("auc").alias("n_bags"), F.avg("auc").alias("auc"), F.sum("n_pairs").alias("n_pairs"))
        one = one.withColumn("strata", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return r6(out, "auc")


@query("d08_radial_bins", f"WITH {v.FLAG}, {RADIAL} SELECT patch, {rs('radius')}, rbin, rbin_right, n FROM rb JOIN (SELECT patch, count(*) AS n FROM flagged GROUP BY patch) USING (patch)")
def radial_bins(spark, sf):
    left = sl.radial_table(spark, v.N_PATCH, v.GRID, 4)
    right = sl.radial_table(spark, v.N_PATCH, v.GRID, 4, "right").select("patch", F.col("rbin").alias("rbin_right"))
    n = v.flagged(spark, sf).groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    return r6(left.join(right, "patch").join(n, "patch"), "radius")


DICE = f"""{LONG}, norm AS (SELECT *, CASE WHEN hi > lo THEN (score - lo)/(hi - lo) ELSE 0 END AS h
   FROM (SELECT *, min(score) OVER (PARTITION BY bag_id, slot) AS lo, max(score) OVER (PARTITION BY bag_id, slot) AS hi FROM long)),
 dice AS (SELECT bag_id, slot, threshold, sum(target)::BIGINT AS n_pos,
   coalesce(2.0 * sum(CASE WHEN h > threshold AND target > 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN h > threshold THEN 1 ELSE 0 END) + sum(target), 0), 0) AS dice,
   coalesce(sum(CASE WHEN h > threshold AND target > 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN h > threshold OR target > 0 THEN 1 ELSE 0 END), 0), 0) AS iou
   FROM norm, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) t(threshold) GROUP BY bag_id, slot, threshold)"""
BEST = """best AS (SELECT bag_id, n_pos, CASE WHEN dice > 0 THEN slot ELSE -1 END AS slot, CASE WHEN dice > 0 THEN threshold END AS threshold,
   dice, CASE WHEN dice > 0 THEN iou ELSE 0 END AS iou FROM dice QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY dice DESC, slot, threshold) = 1)"""
POINT = """pt AS (SELECT bag_id, slot, target AS hit FROM long QUALIFY row_number() OVER (PARTITION BY bag_id, slot ORDER BY score DESC, pos) = 1)"""


@query("d09_dice_iou", f"WITH {DICE} SELECT bag_id, slot, threshold, n_pos, {rs('dice', 'iou')} FROM dice")
def dice_iou(spark, sf):
    return r6(sl.dice_iou(v.flagged(spark, sf), v.SLOTS, sl.THRESHOLDS), "dice", "iou")


@query("d10_best_slot_dice", f"WITH {DICE}, {BEST} SELECT bag_id, n_pos, slot, threshold, {rs('dice', 'iou')} FROM best")
def best_slot_dice(spark, sf):
    return r6(sl.best_dice(v.flagged(spark, sf), v.SLOTS), "dice", "iou")


@query("d11_pointing_game", f"WITH {LONG}, {POINT} SELECT * FROM pt")
def pointing_game(spark, sf):
    return sl.pointing(v.flagged(spark, sf), v.SLOTS)


LOC = ("dice", "dice_std", "iou", "pointing_game", "instance_auc", "instance_auc_std", "avg_precision", "prevalence", "ap_lift")
LOC_SQL = f"""{DICE}, {BEST}, {POINT}, ap AS {AP1},
 loc AS (SELECT avg(dice) AS dice, stddev_pop(dice) AS dice_std, avg(iou) AS iou, avg(hit) AS pointing_game, avg(auc) AS instance_auc,
   stddev_pop(auc) AS instance_auc_std, avg(CASE WHEN auc IS NOT NULL THEN avg_precision END) AS avg_precision,
   avg(CASE WHEN auc IS NOT NULL THEN prevalence END) AS prevalence,
   avg(CASE WHEN auc IS NOT NULL THEN avg_precision END)/avg(CASE WHEN auc IS NOT NULL THEN prevalence END) AS ap_lift, count(*) AS n_bags
  FROM best b JOIN pt ON pt.bag_id = b.bag_id AND pt.slot = CASE WHEN b.slot < 0 THEN 2 ELSE b.slot END
  LEFT JOIN {v.auc('flagged', 'bag_id', 's1')} a ON a.bag_id = b.bag_id LEFT JOIN ap ON ap.bag_id = b.bag_id WHERE b.n_pos > 0)"""


@query("d12_localisation_summary", f"WITH {LOC_SQL} SELECT {rs(*LOC)}, n_bags FROM loc")
def localisation_summary(spark, sf):
    return r6(sl.localisation_summary(sized(spark, sf), v.SLOTS, 1, size="n_rows"), *LOC)


@query("d13_axis_means", f"""WITH {v.FLAG}, ax AS {v.axes('flagged', 'bag_id', 's1')},
 l AS (SELECT 'flat' AS axis, flat AS x FROM ax UNION ALL SELECT 'slice', slice FROM ax UNION ALL SELECT 'within_slice', within_slice FROM ax)
 SELECT axis, count(x) AS n, round(avg(x), 6) AS mean FROM l GROUP BY axis""")
def axis_means(spark, sf):
    ax = rk.axes(v.flagged(spark, sf), v.N_PATCH, ["bag_id"], "s1")
    long = es.melt(ax, ["bag_id"], AX, "axis", "x")
    return r6(long.groupBy("axis").agg(F.count("x").alias("n"), F.avg("x").alias("mean")), "mean")


@query("d14_geometry_auc", f"""WITH {v.FLAG}, geo AS (SELECT *, -(abs(slice - (n_slices-1)/2.0::DOUBLE) / greatest((n_slices-1)/2.0::DOUBLE, 1.0)) AS z,
  -(sqrt((patch//4 - 1.5::DOUBLE)*(patch//4 - 1.5::DOUBLE) + (patch%4 - 1.5::DOUBLE)*(patch%4 - 1.5::DOUBLE))/1.5::DOUBLE) AS r FROM flagged)
 SELECT bag_id, round(a.auc, 6) AS auc_depth, round(b.auc, 6) AS auc_radius FROM {v.auc('geo', 'bag_id', 'z')} a JOIN {v.auc('geo', 'bag_id', 'r')} b USING (bag_id)""")
def geometry_auc(spark, sf):
    rows = sized(spark, sf).select("bag_id", "pos", "target", "n_rows",
                                   geo.depth_only(F.col("slice"), F.col("n_slices")).alias("z"),
                                   geo.radius_only(F.col("patch"), v.GRID).alias("r"))
    per = sl.slot_auc(rows, ["z", "r"], size="n_rows")
    out = per.groupBy("bag_id").agg(F.max(F.when(F.col("slot") == 0, F.col("auc"))).alias("auc_depth"),
                                    F.max(F.when(F.col("slot") == 1, F.col("auc"))).alias("auc_radius"))
    return r6(out, "auc_depth", "auc_radius")


@query("d15_radial_profile", f"""WITH {LONG}, {RADIAL}, per AS (SELECT bag_id, slot, rbin, avg(score) AS m, avg(target) AS d FROM long JOIN rb USING (patch) GROUP BY ALL)
 SELECT slot, rbin, round(avg(m), 6) AS mean_score, round(avg(d), 6) AS density, count(*) AS n_bags FROM per GROUP BY slot, rbin""")
def radial_profile(spark, sf):
    return r6(sl.radial_profile(v.flagged(spark, sf), v.SLOTS, v.N_PATCH, v.GRID, 4), "mean_score", "density")


@query("d16_concentration", f"""WITH {LONG}, p AS (SELECT bag_id, slot, score/greatest(sum(score) OVER w, 1e-12) AS p, count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY bag_id, slot))
 SELECT bag_id, slot, round(-sum(p * ln(greatest(p, 1e-12)))/ln(max(n)), 6) AS entropy FROM p GROUP BY bag_id, slot""")
def concentration(spark, sf):
    return r6(sl.concentration(v.flagged(spark, sf), v.SLOTS), "entropy")


# Position-only references -----------------------------------------------------------------

@query("e01_centre_prior", f"""WITH {v.FLAG}, {centre_cte('flagged')} SELECT bag_id, n_pos, round(auc, 6) AS auc FROM {v.auc('centre', 'bag_id')}""")
def centre_prior(spark, sf):
    rows = tp.centre_prior_rows(sized(spark, sf), v.GRID)
    return r6(rk.auc(rows, ["bag_id"], size="n_rows").select("bag_id", "n_pos", "auc"), "auc")


GT = f"gt AS (SELECT patch, CAST(CAST(sum({v.exact('s1')}) AS DOUBLE)/count(*) AS FLOAT) AS template, count(*) AS n_slices_fit FROM flagged GROUP BY patch)"


@query("e02_global_template", f"WITH {v.FLAG}, {GT} SELECT patch, round(CAST(template AS DOUBLE), 6) AS template, n_slices_fit FROM gt")
def global_template(spark, sf):
    return r6(tp.global_template(v.flagged(spark, sf), F.col("s1")), "template")


@query("e03_tiled_template", f"""WITH {v.FLAG}, {GT}, t AS (SELECT f.*, template FROM flagged f JOIN gt USING (patch))
 SELECT bag_id, n_lesion_slices, {rs(*AX)} FROM {v.axes('t', 'bag_id', 'template')}""")
def tiled_template(spark, sf):
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1")))
    return r6(rk.axes(tiled, v.N_PATCH, ["bag_id"], "template").drop("n_slices"), *AX)


FAM = ("inplane", "axial", "joint")


@query("e04_family_fit_scores", f"WITH {v.FLAG}, {family_ctes('flagged', 's1')} SELECT bin, patch, observed, {rs(*FAM)} FROM fam")
def family_fit_scores(spark, sf):
    cells = tp.fit_cells(v.flagged(spark, sf), F.col("s1"), v.N_BINS)
    return r6(tp.fill(cells, v.N_BINS, v.N_PATCH), *FAM)


@query("e04_family_fit_masks", f"WITH {v.FLAG}, {family_ctes('flagged', 'target')} SELECT bin, patch, observed, {rs(*FAM)} FROM fam")
def family_fit_masks(spark, sf):
    cells = tp.fit_cells(v.flagged(spark, sf), F.col("target"), v.N_BINS)
    return r6(tp.fill(cells, v.N_BINS, v.N_PATCH), *FAM)


@query("e05_unobserved_cells", f"""WITH {v.FLAG}, {family_ctes('flagged', 's1', bins=1024)} SELECT count(*) AS n_cells, sum(CASE WHEN observed THEN 0 ELSE 1 END)::BIGINT AS n_unobserved,
 round(avg(joint), 6) AS mean_joint, round(max(CASE WHEN NOT observed THEN joint END), 6) AS grand FROM fam""")
def unobserved_cells(spark, sf):
    fam = tp.fill(tp.fit_cells(v.flagged(spark, sf), F.col("s1"), 1024), 1024, v.N_PATCH)
    hidden = ~F.col("observed")
    out = fam.agg(F.count(F.lit(1)).alias("n_cells"), F.sum(hidden.cast("bigint")).alias("n_unobserved"),
                  F.avg("joint").alias("mean_joint"), F.max(F.when(hidden, F.col("joint"))).alias("grand"))
    return r6(out, "mean_joint", "grand")


@query("e06_family_scores", f"""WITH {v.FLAG}, {family_ctes('flagged', 's1')}, {apply_cte('flagged')}
 SELECT scorer, bag_id, round(auc, 6) AS auc FROM {v.auc('scored', 'scorer, bag_id')}""")
def family_scores(spark, sf):
    rows = sized(spark, sf)
    fam = tp.fill(tp.fit_cells(rows, F.col("s1"), v.N_BINS), v.N_BINS, v.N_PATCH)
    scored = tp.apply_family(rows, fam, v.N_BINS)
    return r6(rk.auc(scored, ["scorer", "bag_id"], size="n_rows").select("scorer", "bag_id", "auc"), "auc")


STATIC = f"""st AS (SELECT f.*, static, s1/greatest(static, 1e-12) AS residual FROM flagged f JOIN
  (SELECT bag_id, patch, CAST(sum({v.exact('s1')}) AS DOUBLE)/count(*) AS static FROM flagged GROUP BY bag_id, patch) USING (bag_id, patch))"""


@query("e07_bag_static_template", f"""WITH {v.FLAG}, {STATIC} SELECT bag_id, round(a.auc, 6) AS auc_static, round(b.auc, 6) AS auc_residual
 FROM {v.auc('st', 'bag_id', 'static')} a JOIN {v.auc('st', 'bag_id', 'residual')} b USING (bag_id)""")
def bag_static_template(spark, sf):
    rows = tp.bag_static(sized(spark, sf), "s1").select("bag_id", "pos", "target", "n_rows", "static", "residual")
    per = sl.slot_auc(rows, ["static", "residual"], size="n_rows")
    out = per.groupBy("bag_id").agg(F.max(F.when(F.col("slot") == 0, F.col("auc"))).alias("auc_static"),
                                    F.max(F.when(F.col("slot") == 1, F.col("auc"))).alias("auc_residual"))
    return r6(out, "auc_static", "auc_residual")


@query("e08_template_mass", f"""WITH {v.FLAG}, {GT}, r AS (SELECT *, row_number() OVER (ORDER BY template DESC, patch) AS k FROM gt)
 SELECT round(sum(CASE WHEN k <= 4 THEN CAST(template AS DOUBLE) END)/sum(CAST(template AS DOUBLE)), 6) AS top_share, round(CAST(min(template) AS DOUBLE), 6) AS lo,
 round(CAST(max(template) AS DOUBLE), 6) AS hi, count(*) AS n_cells FROM r""")
def template_mass(spark, sf):
    return r6(tp.top_mass(tp.global_template(v.flagged(spark, sf), F.col("s1")), 4), "top_share", "lo", "hi")


ZED = "(-1.0::DOUBLE + CAST(slice AS DOUBLE) * (2.0::DOUBLE / CAST(greatest(n_slices - 1, 1) AS DOUBLE)))"


@query("e09_centre_gaussian", f"""WITH {v.FLAG}, e AS (SELECT *, exp(-0.5*({ZED}/0.25)*({ZED}/0.25)) AS e FROM flagged),
 a AS (SELECT *, e/sum(e) OVER (PARTITION BY bag_id) AS att FROM e)
 SELECT bag_id, round(sum(att), 6) AS total, round(max(att), 6) AS peak, round(sum(att*target), 6) AS mass_on_target FROM a GROUP BY bag_id""")
def centre_gaussian(spark, sf):
    rows = tp.centre_gaussian(v.flagged(spark, sf), 0.25)
    out = rows.groupBy("bag_id").agg(F.sum("attention").alias("total"), F.max("attention").alias("peak"),
                                     F.sum(F.col("attention") * F.col("target")).alias("mass_on_target"))
    return r6(out, "total", "peak", "mass_on_target")


@query("e10_hash_halves", f"WITH {v.FLAG} SELECT {HALF} AS part, count(DISTINCT bag_id) AS n_bags, count(*) AS n_rows FROM flagged GROUP BY 1")
def hash_halves(spark, sf):
    rows = v.flagged(spark, sf).groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(draws.half(F.col("bag_id")).alias("part")).agg(
        F.count(F.lit(1)).alias("n_bags"), F.sum("n").alias("n_rows"))
