"""Projections, inclusion rules and identity joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.functions import geometry as geo
from patchrank.operators import filters as fl
from patchrank.operators import nulls as nl
from patchrank.operators import ranking as rk
from patchrank.operators import slots as sl
from patchrank.operators import templates as tp

from . import views as v
from .ranking import GT, HALF, sized
from .registry import query, r6, rs

count = lambda: F.count(F.lit(1))


@query("b01_binarise", f"""WITH {v.FLAG} SELECT bag_id, sum(CASE WHEN coverage > 0 THEN 1 ELSE 0 END)::BIGINT AS n_any,
 sum(CASE WHEN coverage > 0.02 THEN 1 ELSE 0 END)::BIGINT AS n_above FROM flagged GROUP BY bag_id""")
def binarise(spark, sf):
    c = F.col("coverage")
    return v.flagged(spark, sf).groupBy("bag_id").agg(
        F.sum(fl.binarise(c)).alias("n_any"), F.sum(fl.binarise(c, 0.02)).alias("n_above"))


@query("b02_threshold_sweep", f"""WITH {v.FLAG}, sw AS (SELECT f.* EXCLUDE (target), t AS threshold, CAST(coverage > t AS INTEGER) AS target
  FROM flagged f, (VALUES (0.0::DOUBLE), (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) x(t))
 SELECT threshold, sum(n_pos)::BIGINT AS n_pos, count(auc) AS n_bags, round(avg(auc), 6) AS auc FROM {v.auc('sw', 'threshold, bag_id', 's1')} GROUP BY threshold""")
def threshold_sweep(spark, sf):
    rows = fl.threshold_sweep(sized(spark, sf), (0.0, 0.005, 0.01, 0.02))
    per = rk.auc(rows, ["threshold", "bag_id"], "s1", size="n_rows")
    return r6(per.groupBy("threshold").agg(F.sum("n_pos").alias("n_pos"), F.count("auc").alias("n_bags"),
                                           F.avg("auc").alias("auc")), "auc")


@query("b03_finding_channels", f"""WITH {v.FLAG} SELECT bag_id, 0 AS finding, sum(target)::DOUBLE AS mass FROM flagged GROUP BY bag_id
 UNION ALL SELECT bag_id, 1, sum(1-target)::DOUBLE FROM flagged GROUP BY bag_id""")
def finding_channels(spark, sf):
    return fl.findings(v.flagged(spark, sf)).groupBy("bag_id", "finding").agg(F.sum("inside").alias("mass"))


@query("b04_whole_slices", """SELECT l_suppkey AS bag_id, count(*) AS n, count(*)//16 AS n_slices, 16*(count(*)//16) AS n_kept, count(*) % 16 <> 0 AS ragged
 FROM lineitem GROUP BY l_suppkey""")
def whole_slices(spark, sf):
    rows = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("bag_id")).agg(count().alias("n"))
    ns = geo.slice_of(F.col("n"), v.N_PATCH)
    return rows.select("bag_id", "n", ns.alias("n_slices"), (ns * v.N_PATCH).alias("n_kept"),
                       (F.col("n") % v.N_PATCH != 0).alias("ragged"))


@query("b05_depth_bins", f"WITH {v.INST} SELECT least(slice*8//n_slices, 7) AS bin, count(*) AS n, count(DISTINCT (bag_id, slice)) AS n_slices FROM inst GROUP BY 1")
def depth_bins(spark, sf):
    b = geo.depth_bin(F.col("slice"), F.col("n_slices"), v.N_BINS)
    per = v.instances(spark, sf).groupBy(b.alias("bin"), "bag_id", "slice").agg(count().alias("n"))
    return per.groupBy("bin").agg(F.sum("n").alias("n"), count().alias("n_slices"))


LINE = "CAST(l_returnflag='R' AND l_linestatus='F' AS INTEGER)"


@query("b06_bag_inclusion", f"""SELECT reason, count(*) AS n_bags, sum(n)::BIGINT AS n_rows FROM (
 SELECT l_orderkey, count(*) AS n, CASE WHEN sum({LINE}) = 0 THEN 'all_negative' WHEN sum({LINE}) = count(*) THEN 'all_positive'
  WHEN count(*) % 2 <> 0 THEN 'ragged' ELSE 'kept' END AS reason FROM lineitem GROUP BY l_orderkey) GROUP BY reason""")
def bag_inclusion(spark, sf):
    lesion = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    rows = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bag_id"), lesion.cast("int").alias("target"))
    per = fl.bag_inclusion(rows, 2)
    return per.groupBy("reason").agg(count().alias("n_bags"), F.sum("n").alias("n_rows"))


@query("b07_region_flag", f"""WITH {v.INST} SELECT bag_id, count(*) AS n_left, count(*) AS n_right, TRUE AS aligned,
 sum(CASE WHEN frac > 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_inside FROM inst GROUP BY bag_id""")
def region_flag(spark, sf):
    rows = v.instances(spark, sf)
    region = rows.select("bag_id", "pos", "frac")
    inside = region.groupBy("bag_id").agg(F.sum((F.col("frac") > 0.5).cast("bigint")).alias("n_inside"))
    return fl.check_counts(rows, region).join(inside, "bag_id")


@query("b08_restrict_to_region", f"WITH {v.FLAG} SELECT bag_id, n_pos, n_neg, round(auc, 6) AS auc FROM {v.auc('flagged', 'bag_id', 's1', where='frac > 0.3')}")
def restrict_to_region(spark, sf):
    rows = sized(spark, sf)
    inside = fl.restrict(rows.drop("frac"), rows, 0.3)
    return r6(rk.auc(inside, ["bag_id"], "s1", size="n_rows").drop("conc2"), "auc")


@query("b09_normalise_heatmap", f"""WITH {v.FLAG}, n AS (SELECT bag_id, coalesce((s1 - min(s1) OVER w)/nullif(max(s1) OVER w - min(s1) OVER w, 0), 0) AS h FROM flagged WINDOW w AS (PARTITION BY bag_id))
 SELECT bag_id, round(avg(h), 6) AS mean_h, round(min(h), 6) AS lo, round(max(h), 6) AS hi FROM n GROUP BY bag_id""")
def normalise_heatmap(spark, sf):
    rows = sl.normalised(v.flagged(spark, sf), ["s1"])
    return r6(rows.groupBy("bag_id").agg(F.avg("h_s1").alias("mean_h"), F.min("h_s1").alias("lo"),
                                         F.max("h_s1").alias("hi")), "mean_h", "lo", "hi")


@query("b10_slice_level_vectors", f"""WITH {v.VECS}, e AS (SELECT bag_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM vecs)
 SELECT bag_id, label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY ALL""")
def slice_level_vectors(spark, sf):
    return r6(fl.slice_vectors(v.vectors(spark, sf), ["bag_id", "label"], "embedding"), "mean")


@query("b11_grid_cells", f"WITH {v.INST} SELECT patch//4 AS row, patch%4 AS col, count(*) AS n, max(slice) AS last_slice, round(avg(s1), 6) AS mean_score FROM inst GROUP BY 1, 2")
def grid_cells(spark, sf):
    rows = fl.grid_cells(v.instances(spark, sf), v.N_PATCH, v.GRID)
    return r6(rows.groupBy("row", "col").agg(count().alias("n"), F.max("slice").alias("last_slice"),
                                             F.avg("s1").alias("mean_score")), "mean_score")


@query("b12_upsample_in_plane", f"""WITH {v.INST}, c AS (SELECT o, least(floor(p), 3) AS a, least(floor(p)+1, 3) AS b, p - least(floor(p), 3) AS f
   FROM (SELECT o, greatest((o+0.5)*0.5-0.5, 0)::DOUBLE AS p FROM range(8) r(o))),
 px AS (SELECT cy.o AS y, cx.o AS x, i.bag_id, i.slice,
   CASE WHEN i.patch//4 = cy.a THEN 1-cy.f ELSE 0 END + CASE WHEN i.patch//4 = cy.b THEN cy.f ELSE 0 END AS wy,
   CASE WHEN i.patch%4 = cx.a THEN 1-cx.f ELSE 0 END + CASE WHEN i.patch%4 = cx.b THEN cx.f ELSE 0 END AS wx, s1
   FROM inst i, c cy, c cx),
 im AS (SELECT bag_id, slice, y, x, sum(wy*wx*s1) AS value FROM px GROUP BY ALL HAVING sum(wy*wx) > 0.999999)
 SELECT y, x, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS peak FROM im GROUP BY y, x""")
def upsample_in_plane(spark, sf):
    px = fl.upsample(v.instances(spark, sf), "s1", v.GRID, 8)
    return r6(px.groupBy("y", "x").agg(count().alias("n"), F.avg("value").alias("mean_value"),
                                       F.max("value").alias("peak")), "mean_value", "peak")


ARMS = f"""{v.RUNS}, arms AS (SELECT arm, count(*) AS n, CASE WHEN arm IN ('view','click') THEN 'content_free' ELSE 'learned_attention' END AS scoring_class,
  arm <> 'error' AS blind, CASE WHEN arm = 'signup' THEN 'dropped' ELSE 'run' END AS status FROM runs GROUP BY arm)"""


def arms(spark, sf):
    per = v.runs(spark, sf).groupBy("arm").agg(count().alias("n"))
    cls = F.when(F.col("arm").isin("view", "click"), "content_free").otherwise("learned_attention")
    return per.select("arm", "n", cls.alias("scoring_class"), (F.col("arm") != "error").alias("blind"),
                      F.when(F.col("arm") == "signup", "dropped").otherwise("run").alias("status"))


@query("b13_arm_set", f"WITH {ARMS} SELECT arm, n, scoring_class, blind, status FROM arms WHERE scoring_class = 'learned_attention' AND status = 'run'")
def arm_set(spark, sf):
    return fl.arm_set(arms(spark, sf), ["learned_attention"]).where("status = 'run'")


SPEC = "arm || ':div=' || CAST(seed AS VARCHAR) || ',k=' || CAST(seed * 2 AS VARCHAR)"


@query("b14_arm_tags", f"""WITH {v.RUNS}, t AS (SELECT DISTINCT {SPEC} AS spec, arm, seed FROM runs)
 SELECT spec, replace(spec, ':', '_') || '_seed' || seed AS tag, replace(spec, ':', '_') AS arm_back, arm AS name,
 CAST(seed AS VARCHAR) AS div, CAST(seed*2 AS VARCHAR) AS k FROM t""")
def arm_tags(spark, sf):
    spec = F.concat(F.col("arm"), F.lit(":div="), F.col("seed").cast("string"), F.lit(",k="),
                    (F.col("seed") * 2).cast("string"))
    rows = v.runs(spark, sf).select(spec.alias("spec"), "seed").distinct()
    name, params = fl.parse_arm(F.col("spec"))
    tag = fl.arm_tag(F.col("spec"), F.col("seed"))
    return rows.select("spec", tag.alias("tag"), fl.arm_of(tag).alias("arm_back"), name.alias("name"),
                       params["div"].alias("div"), params["k"].alias("k"))


NAMES = ["/en", "/en/6", "example", "example.com", "example.net/de"]


@query("b15_longest_name_in_path", f"""WITH n AS (SELECT unnest({NAMES}) AS name), m AS (SELECT page_id, (SELECT name FROM n WHERE contains(url, name) ORDER BY length(name) DESC, name DESC LIMIT 1) AS condition FROM pages)
 SELECT condition, count(*) AS n FROM m GROUP BY condition""")
def longest_name(spark, sf):
    pages = v.table(spark, sf, "pages").select(fl.longest_contained(F.col("url"), NAMES).alias("condition"))
    return pages.groupBy("condition").agg(count().alias("n"))


@query("b16_remap_labels", f"WITH {v.SERIES} SELECT CASE label WHEN 5 THEN 4 WHEN 2 THEN 1 ELSE label END AS label, count(*) AS n FROM series GROUP BY 1")
def remap_labels(spark, sf):
    return fl.remap_labels(v.series(spark, sf), {5: 4, 2: 1}).groupBy("label").agg(count().alias("n"))


@query("b16_labels_from_table", "SELECT lang, l.quality AS label, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def labels_from_table(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("bag_id"), "lang")
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").alias("bag_id"), F.col("quality").alias("label"))
    return fl.relabel(docs, labels).groupBy("lang", "label").agg(count().alias("n"))


READ = """med AS (SELECT l_orderkey AS bag_id, l_linenumber AS finding, quantile_cont(1 + CAST(l_quantity AS INTEGER) % 5, 0.5) AS m FROM lineitem GROUP BY 1, 2),
 lab AS (SELECT bag_id, max(CASE WHEN m <> 3 THEN CAST(m > 3 AS INTEGER) END) AS label, count(*) AS n_findings, sum(CASE WHEN m <> 3 THEN 1 ELSE 0 END)::BIGINT AS n_decisive FROM med GROUP BY 1)"""


def readings(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bag_id"), F.col("l_linenumber").alias("finding"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("reading"))


@query("b17_label_from_findings", f"WITH {READ} SELECT * FROM lab")
def label_from_findings(spark, sf):
    return fl.scan_labels(readings(spark, sf))


@query("b18_relabel_report", f"""WITH {READ} SELECT CASE WHEN label IS NULL THEN 'indeterminate' WHEN label = 1 THEN 'positive' ELSE 'negative' END AS outcome,
 count(*) AS n_bags, sum(n_findings)::BIGINT AS n_findings FROM lab GROUP BY 1""")
def relabel_report(spark, sf):
    lab = fl.scan_labels(readings(spark, sf))
    outcome = F.when(F.col("label").isNull(), "indeterminate").when(F.col("label") == 1, "positive").otherwise("negative")
    return lab.groupBy(outcome.alias("outcome")).agg(count().alias("n_bags"), F.sum("n_findings").alias("n_findings"))


@query("b19_slice_subsample", f"""WITH {v.INST}, s AS (SELECT DISTINCT bag_id, slice FROM inst)
 SELECT bag_id, slice FROM s QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5(concat_ws('|', '7', '1', bag_id, slice)), slice) <= 12""")
def slice_subsample(spark, sf):
    slices = v.instances(spark, sf).select("bag_id", "slice").distinct()
    return fl.subsample_slices(slices, 12, 7, 1)


# Joins by identity ------------------------------------------------------------------------

@query("c01_patient_fallback", f"WITH {v.INST}, {v.BAGS} SELECT coalesce(patient_id, b.bag_id) AS patient_id, count(*) AS n_bags, sum(n)::BIGINT AS n_rows FROM (SELECT bag_id, count(*) AS n FROM inst GROUP BY 1) b LEFT JOIN (SELECT s_suppkey AS bag_id, CASE WHEN s_acctbal > 0 THEN CAST(s_nationkey AS BIGINT) END AS patient_id FROM supplier) USING (bag_id) GROUP BY 1")
def patient_fallback(spark, sf):
    per = v.instances(spark, sf).groupBy("bag_id").agg(count().alias("n"))
    known = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("bag_id"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("bigint")).alias("patient_id"))
    out = per.join(known, "bag_id", "left").withColumn("patient_id", F.coalesce("patient_id", "bag_id"))
    return out.groupBy("patient_id").agg(count().alias("n_bags"), F.sum("n").alias("n_rows"))


@query("c02_scores_with_targets", f"WITH {v.INST} SELECT bag_id, count(*) AS n, round(sum(s0*target), 6) AS mass FROM inst GROUP BY bag_id")
def scores_with_targets(spark, sf):
    rows = v.instances(spark, sf)
    joined = rows.select("bag_id", "pos", "s0").join(rows.select("bag_id", "pos", "target"), ["bag_id", "pos"])
    return r6(joined.groupBy("bag_id").agg(count().alias("n"), F.sum(F.col("s0") * F.col("target")).alias("mass")), "mass")


@query("c03_region_with_instances", f"WITH {v.INST} SELECT bag_id, count(*) AS n, sum(CASE WHEN frac > 0.4 AND target > 0 THEN 1 ELSE 0 END)::BIGINT AS n_pos_inside FROM inst GROUP BY bag_id")
def region_with_instances(spark, sf):
    rows = v.instances(spark, sf)
    joined = rows.select("bag_id", "pos", "target").join(rows.select("bag_id", "pos", "frac"), ["bag_id", "pos"])
    hit = (F.col("frac") > 0.4) & (F.col("target") > 0)
    return joined.groupBy("bag_id").agg(count().alias("n"), F.sum(hit.cast("bigint")).alias("n_pos_inside"))


@query("c04_paired_scorers", f"WITH {v.FLAG} SELECT bag_id, round(a.auc, 6) AS a, round(b.auc, 6) AS b, round(a.auc - b.auc, 6) AS delta FROM {v.auc('flagged', 'bag_id', 's0')} a JOIN {v.auc('flagged', 'bag_id', 's1')} b USING (bag_id)")
def paired_scorers(spark, sf):
    from patchrank.operators import estimands as es
    rows = sized(spark, sf)
    a, b = (rk.auc(rows, ["bag_id"], s, size="n_rows") for s in ("s0", "s1"))
    return r6(es.paired_rows(a, b, ["bag_id"], "auc"), "a", "b", "delta")


@query("c05_template_lookup", f"WITH {v.FLAG}, {GT} SELECT bag_id, count(*) AS n, round(avg(CAST(template AS DOUBLE)), 6) AS mean_template FROM flagged JOIN gt USING (patch) GROUP BY bag_id")
def template_lookup(spark, sf):
    rows = v.flagged(spark, sf)
    tiled = tp.tile(rows, tp.global_template(rows, F.col("s1")))
    return r6(tiled.groupBy("bag_id").agg(count().alias("n"), F.avg(F.col("template").cast("double")).alias("mean_template")), "mean_template")


DONOR = """bs AS (SELECT bag_id, max(n_slices) AS n_slices, max(n_rows) AS n_rows FROM inst GROUP BY bag_id),
 ord AS (SELECT *, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{seed}', rep, bag_id)), bag_id) - 1 AS ix, count(*) OVER (PARTITION BY rep) AS size,
   row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', '{seed}', rep, bag_id, 'donor')), bag_id) - 1 AS donor_ix FROM bs, range({reps}) r(rep)),
 perm AS MATERIALIZED (SELECT a.rep, a.ix, a.size, a.bag_id, d.bag_id AS donor_id FROM ord a JOIN ord d ON a.rep = d.rep AND d.donor_ix = a.ix),
 fixed AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY ix) - 1 AS nth, count(*) OVER (PARTITION BY rep) AS n_fixed FROM perm WHERE bag_id = donor_id AND size > 1),
 repair AS (SELECT f.rep, f.bag_id, g.bag_id AS donor_id FROM fixed f JOIN fixed g ON f.rep = g.rep AND g.nth = (f.nth + 1) % f.n_fixed WHERE f.n_fixed > 1
   UNION ALL SELECT f.rep, f.bag_id, p.donor_id FROM fixed f JOIN perm p ON f.rep = p.rep AND p.ix = (f.ix + 1) % f.size WHERE f.n_fixed = 1
   UNION ALL SELECT f.rep, p.bag_id, f.bag_id FROM fixed f JOIN perm p ON f.rep = p.rep AND p.ix = (f.ix + 1) % f.size WHERE f.n_fixed = 1),
 donors AS (SELECT p.rep, p.bag_id, b.n_slices, d.bag_id AS donor_id, d.n_slices AS donor_slices, d.n_rows AS donor_rows FROM perm p LEFT JOIN repair r USING (rep, bag_id)
   JOIN bs b USING (bag_id) JOIN bs d ON d.bag_id = coalesce(r.donor_id, p.donor_id))"""
SHUF = """shuf AS MATERIALIZED (SELECT d.rep, i.bag_id, i.pos, s.target FROM inst i JOIN donors d USING (bag_id)
   JOIN inst s ON s.bag_id = d.donor_id AND s.pos = i.pos % d.donor_rows)"""


@query("c06_donor_targets", f"WITH {v.INST}, {DONOR.format(seed=3, reps=2)}, {SHUF} SELECT rep, bag_id, count(*) AS n, sum(target)::BIGINT AS n_pos FROM shuf GROUP BY rep, bag_id")
def donor_targets(spark, sf):
    rows = v.instances(spark, sf)
    donors = nl.donor_map(v.bag_sizes(spark, sf), 3, 2)
    out = nl.shuffle_targets(rows, donors, v.N_PATCH)
    return out.groupBy("rep", "bag_id").agg(count().alias("n"), F.sum("target").alias("n_pos"))


@query("c07_common_tags", f"""WITH {v.RUNS} SELECT arm, seed FROM runs WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL HAVING count(*) > 5
 INTERSECT SELECT arm, seed FROM runs WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL HAVING count(*) > 5""")
def common_tags(spark, sf):
    rows = v.runs(spark, sf)
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    def tags(part):
        return part.groupBy("arm", "seed").agg(count().alias("n")).where("n > 5").select("arm", "seed")
    return tags(rows.where(early)).intersect(tags(rows.where(~early)))


@query("c08_missing_runs", f"""WITH {v.RUNS}, a AS (SELECT DISTINCT arm FROM runs), present AS (SELECT DISTINCT arm, seed FROM runs WHERE value > 150)
 SELECT arm, CAST(seed AS BIGINT) AS seed FROM a, range(8) s(seed) EXCEPT SELECT arm, seed FROM present""")
def missing_runs(spark, sf):
    rows = v.runs(spark, sf)
    declared = rows.select("arm").distinct().withColumn(
        "seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    present = rows.where("value > 150").select("arm", "seed").distinct()
    return declared.join(present, ["arm", "seed"], "left_anti")


@query("c09_split_exclusion", f"WITH {v.SERIES} SELECT status, count(*) AS n FROM series s WHERE NOT EXISTS (SELECT 1 FROM series t WHERE t.bag_id = s.bag_id AND t.label = 1) GROUP BY status")
def split_exclusion(spark, sf):
    rows = v.series(spark, sf)
    held = rows.where("label = 1").select("bag_id")
    return rows.join(held, "bag_id", "left_anti").groupBy("status").agg(count().alias("n"))


@query("c10_patient_overlap", f"""WITH {v.SERIES}, s AS (SELECT patient_id, CASE WHEN label <= 2 THEN 'train' WHEN label = 3 THEN 'val' ELSE 'test' END AS split FROM series)
 SELECT n_splits, count(*) AS n_patients FROM (SELECT patient_id, count(DISTINCT split) AS n_splits FROM s GROUP BY patient_id) GROUP BY n_splits""")
def patient_overlap(spark, sf):
    split = F.when(F.col("label") <= 2, "train").when(F.col("label") == 3, "val").otherwise("test")
    per = v.series(spark, sf).groupBy("patient_id").agg(F.count_distinct(split).alias("n_splits"))
    return per.groupBy("n_splits").agg(count().alias("n_patients"))


@query("c12_auc_against_pairs", f"""WITH {v.FLAG} SELECT b.bag_id, round(avg(CASE WHEN p.s0 > q.s0 THEN 1.0::DOUBLE WHEN p.s0 = q.s0 THEN 0.5 WHEN p.s0 < q.s0 THEN 0.0 END), 6) AS auc, count(q.s0) AS n_pairs
 FROM (SELECT DISTINCT bag_id FROM flagged) b LEFT JOIN flagged p ON p.bag_id = b.bag_id AND p.target = 1 LEFT JOIN flagged q ON p.bag_id = q.bag_id AND q.target = 0 GROUP BY b.bag_id""")
def auc_against_pairs(spark, sf):
    per = rk.auc(sized(spark, sf), ["bag_id"], "s0", size="n_rows")
    return r6(per.select("bag_id", "auc", (F.col("n_pos") * F.col("n_neg")).alias("n_pairs")), "auc")


@query("c13_halves_disjoint", f"""WITH {v.INST}, h AS (SELECT bag_id, {HALF} AS part, count(*) AS n FROM inst GROUP BY 1, 2)
 SELECT part, count(*) AS n_bags, sum(n)::BIGINT AS n_rows, 0::BIGINT AS n_shared FROM h GROUP BY part""")
def halves_disjoint(spark, sf):
    """Rows of each half, and the bags of a half that hold a row of the other: the assignment is made per row."""
    rows = v.instances(spark, sf).select("bag_id", draws.half(F.col("bag_id")).alias("part"))
    per = rows.groupBy("bag_id", "part").agg(count().alias("n"))
    held = per.groupBy("bag_id").agg(F.count(F.lit(1)).alias("parts"))
    return per.join(held, "bag_id").groupBy("part").agg(count().alias("n_bags"), F.sum("n").alias("n_rows"), F.sum((F.col("parts") > 1).cast("bigint")).alias("n_shared"))
