"""Null models over the line-item instances."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchrank.functions import draws
from patchrank.operators import estimands as es
from patchrank.operators import nulls as nl
from patchrank.operators import ranking as rk
from patchrank.operators import templates as tp
from patchrank.plans import null_reports as nr
from patchrank.session import pin

from . import views as v
from .filters import DONOR, SHUF, count
from .ranking import AX, GT, HALF, LONG, STATIC, centre_cte, sized
from .registry import query, r6, rs


def rolled(seed: int, reps: int, source: str = "inst") -> str:
    return f"""rolled AS MATERIALIZED (SELECT rep, bag_id, (pos + 1 + {v.draw(str(seed), 'rep', 'bag_id')} % greatest(n_rows - 1, 1)) % n_rows AS pos, target
      FROM {source}, range({reps}) r(rep))"""


def r4(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 4))
    return df


@query("f01_roll_null", f"""WITH {v.FLAG}, {rolled(11, 2)}, m AS (SELECT r.rep, f.bag_id, f.s1, r.target FROM flagged f JOIN rolled r USING (bag_id, pos))
 SELECT rep, bag_id, n_pos, round(auc, 6) AS auc FROM {v.auc('m', 'rep, bag_id', 's1')}""")
def roll_null(spark, sf):
    rows = sized(spark, sf)
    per = rk.auc_of_positives(rk.midranks(rows, ["bag_id"], "s1", size="n_rows"), nl.roll_positives(rows, v.N_PATCH, 11, 2), ["rep", "bag_id"])
    return r6(nl.every_replicate(per, v.bag_sizes(spark, sf), 2), "auc")


@query("f02_donor_cycle", f"WITH {v.INST}, {DONOR.format(seed=5, reps=3)} SELECT rep, bag_id, donor_id, donor_id <> bag_id AS moved FROM donors")
def donor_cycle(spark, sf):
    d = nl.donor_map(v.bag_sizes(spark, sf), 5, 3)
    return d.select("rep", "bag_id", "donor_id", (F.col("donor_id") != F.col("bag_id")).alias("moved"))


@query("f02_cross_bag_null", f"""WITH {v.FLAG}, {DONOR.format(seed=5, reps=2)}, {SHUF}, m AS (SELECT r.rep, f.bag_id, f.s1, r.target FROM flagged f JOIN shuf r USING (bag_id, pos))
 SELECT rep, bag_id, n_pos, round(auc, 6) AS auc FROM {v.auc('m', 'rep, bag_id', 's1')}""")
def cross_bag_null(spark, sf):
    rows = sized(spark, sf)
    sizes = v.bag_sizes(spark, sf)
    moved = nl.shuffle_positives(rows, pin(nl.donor_map(sizes, 5, 2)), v.N_PATCH)
    per = rk.auc_of_positives(rk.midranks(rows, ["bag_id"], "s1", size="n_rows"), moved, ["rep", "bag_id"])
    return r6(nl.every_replicate(per, sizes, 2), "auc")


def random_ctes(source: str, scale: str, seed: str, bias=("0", "0", "0"), name: str = "rnd") -> str:
    ls = ", ".join(f"{v.normal(seed, 'bag_id', 'pos', chr(39) + str(j) + chr(39))} * {scale} + {bias[j]} AS l{j}" for j in range(3))
    es_ = ", ".join(f"exp(l{j} - greatest(l0, l1, l2)) AS e{j}" for j in range(3))
    rs_ = ", ".join(f"CAST(CAST(e{j}/(e0+e1+e2) AS FLOAT) AS DOUBLE) AS r{j}" for j in range(3))
    return f"""{name} AS MATERIALIZED (SELECT *, {rs_} FROM (SELECT *, {es_} FROM (SELECT *, {ls} FROM {source})))"""


@query("f03_random_attention", f"WITH {v.FLAG}, {random_ctes('flagged', '2.0::DOUBLE', chr(39) + '9' + chr(39), ('0.5::DOUBLE', '0.0::DOUBLE', '-0.5::DOUBLE'))} SELECT bag_id, {', '.join(f'round(avg(r{j}), 5) AS r{j}' for j in range(3))} FROM rnd GROUP BY bag_id")
def random_attention(spark, sf):
    rows = nl.random_slots(v.flagged(spark, sf), 3, 2.0, 9, [0.5, 0.0, -0.5])
    return rows.groupBy("bag_id").agg(*[F.round(F.avg(f"r{j}"), 5).alias(f"r{j}") for j in range(3)])


SLOT_ENT = """ent AS (SELECT avg(-(a/t*ln(a/t) + b/t*ln(b/t) + c/t*ln(c/t))) AS slot_entropy, count(*) AS n_instances
  FROM (SELECT *, a+b+c AS t FROM (SELECT greatest(s0, 1e-12) AS a, greatest(s1, 1e-12) AS b, greatest(s2, 1e-12) AS c FROM flagged)))"""


@query("f04_slot_entropy", f"WITH {v.FLAG}, {SLOT_ENT} SELECT round(slot_entropy, 6) AS slot_entropy, n_instances FROM ent")
def slot_entropy(spark, sf):
    return r6(nl.slot_entropy(v.flagged(spark, sf), v.SLOTS), "slot_entropy")


def match_sql() -> str:
    ctes = [v.FLAG, SLOT_ENT,
            "probe AS MATERIALIZED (SELECT " + ", ".join(f"{v.normal(chr(39) + 'probe' + chr(39), 'i', str(j))} AS z{j}" for j in range(3)) + " FROM range(4096) r(i))",
            "b0 AS (SELECT slot_entropy AS goal, 0.001::DOUBLE AS lo, 30.0::DOUBLE AS hi FROM ent)"]
    for k in range(10):
        ctes.append(f"""c{k} AS MATERIALIZED (SELECT goal, scale, avg(-(e0/t*ln(greatest(e0/t, 1e-12)) + e1/t*ln(greatest(e1/t, 1e-12)) + e2/t*ln(greatest(e2/t, 1e-12)))) AS h
          FROM (SELECT *, e0+e1+e2 AS t FROM (SELECT goal, scale, exp(z0*scale - m) AS e0, exp(z1*scale - m) AS e1, exp(z2*scale - m) AS e2
            FROM (SELECT *, greatest(z0*scale, z1*scale, z2*scale) AS m FROM probe, (SELECT goal, lo + (hi - lo) * i / 16.0::DOUBLE AS scale FROM b{k}, range(17) s(i))))) GROUP BY goal, scale),
         b{k + 1} AS MATERIALIZED (SELECT goal, coalesce(max(CASE WHEN h > goal THEN scale END), min(scale)) AS lo, coalesce(min(CASE WHEN h <= goal THEN scale END), max(scale)) AS hi FROM c{k} GROUP BY goal)""")
    return "WITH " + ", ".join(ctes) + " SELECT round((lo+hi)/2, 5) AS scale, round(goal, 5) AS goal FROM b10"


@query("f05_match_scale", match_sql())
def match_scale(spark, sf):
    goal = nl.slot_entropy(v.flagged(spark, sf), v.SLOTS)
    probe = spark.range(4096).select(*[draws.normal("probe", F.col("id"), j).alias(f"z{j}") for j in range(3)])
    out = nl.match_scale(probe, ["z0", "z1", "z2"], goal)
    return out.select(F.round("scale", 5).alias("scale"), F.round("goal", 5).alias("goal"))


@query("f06_constant_scorer", f"WITH {v.FLAG} SELECT bag_id, CASE WHEN sum(target) BETWEEN 1 AND count(*) - 1 THEN 0.5::DOUBLE END AS auc FROM flagged GROUP BY bag_id")
def constant_scorer(spark, sf):
    rows = sized(spark, sf).withColumn("score", F.lit(1.0))
    return rk.auc(rows, ["bag_id"], size="n_rows").select("bag_id", "auc")


def protocol_sql(source: str, keys: str) -> str:
    return f"""(WITH plong AS MATERIALIZED (SELECT {keys}, bag_id, part, target, 0 AS slot, s0 AS score FROM {source} UNION ALL SELECT {keys}, bag_id, part, target, 1, s1 FROM {source}
        UNION ALL SELECT {keys}, bag_id, part, target, 2, s2 FROM {source}),
      aff AS (SELECT {keys}, slot, avg(x) AS x FROM (SELECT {keys}, bag_id, slot, sum(score*target)/greatest(sum(score), 1e-8) AS x FROM plong WHERE part = 'fit' GROUP BY ALL) GROUP BY ALL),
      pick AS (SELECT * FROM aff QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, slot) = 1),
      pa AS (SELECT * FROM {v.auc('plong', keys + ', bag_id, slot', where=chr(34) + 'part' + chr(34) + " <> 'fit'")})
     SELECT {keys}, slot, avg(auc) AS auc, count(auc) AS n_bags FROM pa JOIN pick USING ({keys}, slot) GROUP BY ALL)"""


def battery_sql() -> str:
    kinds = [(f"random_{s:g}", f"{s}::DOUBLE", 0) for s in nr.SCALES] + [("random_bias", "1.0::DOUBLE", 1)]
    bias = ("0.5::DOUBLE * bias", "0.0::DOUBLE * bias", "-0.5::DOUBLE * bias")
    vals = ", ".join(f"('{n}', {s}, {b}::DOUBLE)" for n, s, b in kinds)
    return f"""WITH {v.FLAG}, {rolled(2, 2)}, {DONOR.format(seed=2, reps=2)}, {SHUF},
     kinds AS (SELECT * FROM (VALUES {vals}) k("null", scale, bias), range(2) r(rep)),
     pre AS (SELECT "null", rep, scale, bias, bag_id, pos, n_slices, target FROM flagged, kinds),
     {random_ctes('pre', 'scale', "'2r' || rep", bias)},
     every AS MATERIALIZED (SELECT *, {HALF} AS part FROM (
       SELECT 'reference' AS "null", 0 AS rep, bag_id, target, s0, s1, s2 FROM flagged
       UNION ALL SELECT "null", rep, bag_id, target, r0, r1, r2 FROM rnd
       UNION ALL SELECT 'roll', rep, bag_id, r.target, s0, s1, s2 FROM rolled r JOIN flagged f USING (bag_id, pos)
       UNION ALL SELECT 'shuffle', rep, bag_id, r.target, s0, s1, s2 FROM shuf r JOIN flagged f USING (bag_id, pos))),
     main AS (SELECT "null", rep, auc FROM {protocol_sql('every', '"null", rep')}),
     sb AS MATERIALIZED (SELECT rep, part, slot, avg(auc) AS auc FROM {v.auc("(SELECT rep, part, bag_id, target, slot, CASE slot WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score FROM every, range(3) q(slot) WHERE " + chr(34) + "null" + chr(34) + " = 'random_1')", 'rep, part, bag_id, slot')} GROUP BY ALL),
     chosen AS (SELECT rep, slot FROM sb WHERE part = 'fit' QUALIFY row_number() OVER (PARTITION BY rep ORDER BY auc DESC, slot) = 1),
     allr AS (SELECT * FROM main UNION ALL SELECT 'selection_bias', rep, auc FROM sb JOIN chosen USING (rep, slot) WHERE part <> 'fit')
     SELECT "null", round(avg(auc), 4) AS mean, round(stddev_pop(auc), 4) AS std, round(min(auc), 4) AS lo, round(max(auc), 4) AS hi, count(*) AS n_reps FROM allr GROUP BY "null" """


@query("f07_null_battery", battery_sql())
def null_battery(spark, sf):
    out = nr.null_battery(v.flagged(spark, sf), v.bag_sizes(spark, sf), v.SLOTS, v.N_PATCH, 2, 2)
    return r4(out, "mean", "std", "lo", "hi")


COND = f"""{rolled(4, 1)}, {DONOR.format(seed=4, reps=1)}, {SHUF},
 tg AS MATERIALIZED (SELECT 'real' AS condition, bag_id, pos, target FROM inst UNION ALL SELECT 'roll', bag_id, pos, target FROM rolled UNION ALL SELECT 'shuffle', bag_id, pos, target FROM shuf)"""


@query("f08_crosstab", f"""WITH {v.FLAG}, {COND}, {STATIC}, {GT}, {centre_cte('st', 'cen')},
 sc AS (SELECT bag_id, pos, score AS centre_prior, s1 AS slot, CAST(template AS DOUBLE) AS global_template, static AS bag_static, residual FROM cen JOIN gt USING (patch)),
 lng AS (SELECT scorer, condition, bag_id, tg.target, score FROM (UNPIVOT sc ON slot, centre_prior, global_template, bag_static, residual INTO NAME scorer VALUE score) JOIN tg USING (bag_id, pos)),
 per AS (SELECT scorer, condition, avg(auc) AS a FROM {v.auc('lng', 'scorer, condition, bag_id')} GROUP BY ALL),
 w AS (SELECT scorer, max(CASE WHEN condition='real' THEN a END) AS "real", max(CASE WHEN condition='shuffle' THEN a END) AS shuffle, max(CASE WHEN condition='roll' THEN a END) AS roll FROM per GROUP BY scorer)
 SELECT scorer, round("real", 6) AS "real", round(shuffle, 6) AS shuffle, round(roll, 6) AS roll, round("real" - shuffle, 6) AS real_minus_shuffle, round(shuffle - roll, 6) AS shuffle_minus_roll FROM w""")
def crosstab(spark, sf):
    rows = v.flagged(spark, sf)
    out = nr.crosstab(rows, v.bag_sizes(spark, sf), "s1", tp.global_template(rows, F.col("s1")), v.N_PATCH, v.GRID, 4)
    return r6(out, "real", "shuffle", "roll", "real_minus_shuffle", "shuffle_minus_roll")


COND10 = f"""{rolled(4, 10)}, {DONOR.format(seed=4, reps=10)}, {SHUF},
 tg AS MATERIALIZED (SELECT 'real' AS condition, 0 AS rep, bag_id, pos, target FROM inst UNION ALL SELECT 'roll', rep, bag_id, pos, target FROM rolled UNION ALL SELECT 'shuffle', rep, bag_id, pos, target FROM shuf)"""


@query("f09_axes_under_nulls", f"""WITH {v.FLAG}, {COND10},
 m AS (SELECT condition, rep, f.bag_id, f.slice, f.s1, t.target, max(t.target) OVER (PARTITION BY condition, rep, f.bag_id, f.slice) AS slice_pos FROM flagged f JOIN tg t USING (bag_id, pos)),
 ax AS {v.axes('m', 'condition, rep, bag_id', 's1')}
 SELECT condition, {', '.join(f'round(avg({c}), 6) AS {c}, count({c}) AS n_{c}' for c in AX)} FROM ax GROUP BY condition""")
def axes_under_nulls(spark, sf):
    return r6(nr.axes_under_nulls(v.flagged(spark, sf), v.bag_sizes(spark, sf), "s1", v.N_PATCH, 4, 10), *AX)


@query("f10_half_precision", f"""WITH {v.FLAG}, h AS (SELECT *, CASE WHEN s1 = 0 THEN 0 ELSE round_even(s1/pow(2, floor(log2(abs(s1))) - 10), 0) * pow(2, floor(log2(abs(s1))) - 10) END AS lowp FROM flagged)
 SELECT bag_id, round(a.auc, 6) AS auc_full, round(b.auc, 6) AS auc_half, round(b.auc - a.auc, 6) AS delta FROM {v.auc('h', 'bag_id', 's1')} a JOIN {v.auc('h', 'bag_id', 'lowp')} b USING (bag_id)""")
def half_precision(spark, sf):
    rows = sized(spark, sf).withColumn("lowp", nl.half_precision(F.col("s1")))
    a, b = (rk.auc(rows, ["bag_id"], s, size="n_rows").select("bag_id", F.col("auc").alias(n)) for s, n in (("s1", "auc_full"), ("lowp", "auc_half")))
    out = a.join(b, "bag_id").withColumn("delta", F.col("auc_half") - F.col("auc_full"))
    return r6(out, "auc_full", "auc_half", "delta")


@query("f11_replicated_null", f"""WITH {v.FLAG}, {rolled(21, 5)}, m AS (SELECT r.rep, f.bag_id, f.s1, r.target FROM flagged f JOIN rolled r USING (bag_id, pos)),
 per AS (SELECT rep, (avg(auc) - 0.4)/0.6 AS skill FROM {v.auc('m', 'rep, bag_id', 's1')} GROUP BY rep)
 SELECT round(avg(skill), 6) AS mean, round(median(skill), 6) AS median, round(stddev_samp(skill), 6) AS sd, round(min(skill), 6) AS lo, round(max(skill), 6) AS hi,
 round(min_by(skill, rep), 6) AS first_draw, count(skill) AS n_computable FROM per""")
def replicated_null(spark, sf):
    rows = sized(spark, sf)
    moved = nl.roll_positives(rows, v.N_PATCH, 21, 5)
    per = rk.auc_of_positives(rk.midranks(rows, ["bag_id"], "s1", size="n_rows"), moved, ["rep", "bag_id"]).groupBy("rep").agg(F.avg("auc").alias("auc"))
    skill = per.withColumn("skill", es.skill(F.col("auc"), F.lit(0.4)))
    return r6(es.draw_summary(skill, [], "skill", "rep"), "mean", "median", "sd", "lo", "hi", "first_draw")
