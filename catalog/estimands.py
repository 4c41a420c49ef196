"""Skills, intervals and tests over per-bag results, runs and predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchrank.operators import estimands as es
from patchrank.operators import inference as inf
from patchrank.operators import ranking as rk
from patchrank.operators import templates as tp

from . import views as v
from .filters import count
from .ranking import AX, centre_cte, sized
from .registry import query, r6, rs


def p_normal(z: str) -> str:
    """Two-sided normal tail by Simpson's rule."""
    n = 400
    return f"""(SELECT CASE WHEN abs({z}) > 8 THEN 0 ELSE greatest(0, 1 - 2 * abs({z}) / {n}.0::DOUBLE / 3 * sum(exp(-0.5 * (abs({z}) * i / {n}.0::DOUBLE) ** 2) / sqrt(2 * pi())
      * CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) END FROM range({n + 1}) si(i))"""


def p_t(t: str, df: str) -> str:
    """Two-sided t tail by Simpson's rule on the angle."""
    n = 2000
    e = f"atan2(abs({t}), sqrt({df}))"
    h = f"((pi()/2 - {e}) / {n}.0::DOUBLE)"
    return f"""(SELECT least(1, 2 * {h} / 3 * sum(exp(lgamma(({df}+1)/2) - lgamma({df}/2) - 0.5*ln(pi()) + ({df}-1)*ln(greatest(cos({e} + i*{h}), 1e-300)))
      * CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) FROM range({n + 1}) si(i))"""


def bag_auc(spark, sf, score="s1"):
    return rk.auc(sized(spark, sf), ["bag_id"], score, size="n_rows")


BAGAUC = f"ba AS MATERIALIZED (SELECT a.*, patient_id FROM {v.auc('flagged', 'bag_id', 's1')} a JOIN bags USING (bag_id))"


@query("g01_cluster_bootstrap", f"WITH {v.FLAG}, {v.BAGS}, {BAGAUC} SELECT n, n_clusters, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('ba', '', 'auc', reps=10000)}")
def cluster_bootstrap(spark, sf):
    rows = v.with_patient(bag_auc(spark, sf), spark, sf)
    return r6(es.cluster_bootstrap(rows, [], "auc", "patient_id", 10000), "mean", "lo", "hi")


@query("g01_bootstrap_by_arm", f"WITH {v.RUNS} SELECT arm, n, n_clusters, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('runs', 'arm', 'value', 'bag_id', 10000, 3)}")
def bootstrap_by_arm(spark, sf):
    return r6(es.cluster_bootstrap(v.runs(spark, sf), ["arm"], "value", "bag_id", 10000, 3), "mean", "lo", "hi")


PREDS = """preds AS (SELECT doc_id, quality AS y, toxic AS y2, n_chars/(n_chars + 1500.0::DOUBLE) AS score, 1500.0::DOUBLE/(n_chars + 1500.0::DOUBLE) AS score2 FROM documents JOIN labels USING (doc_id))"""


def predictions(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars") + F.lit(1500.0)
    return docs.join(v.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"),
        (F.col("n_chars") / n).alias("score"), (F.lit(1500.0) / n).alias("score2"))


@query("g02_bag_bootstrap", f"""WITH {PREDS}, num AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS ix, count(*) OVER () AS size FROM preds),
 d AS (SELECT rep, {v.draw("'0'", 'rep', 'ix')} % size AS ix FROM num, range(2000) r(rep)),
 s AS (SELECT rep, y, score FROM d JOIN num USING (ix)), a AS (SELECT * FROM {v.auc('s', 'rep', 'score', 'y')} WHERE auc IS NOT NULL)
 SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS n_boot FROM a""")
def bag_bootstrap(spark, sf):
    return r6(inf.bag_bootstrap(predictions(spark, sf), "doc_id", "y", "score", "auc", 2000), "mean", "lo", "hi")


SKILL = f"""{v.FLAG}, {centre_cte('flagged')}, sk AS (SELECT a.bag_id, a.auc AS auc, c.auc AS prior FROM {v.auc('flagged', 'bag_id', 's1')} a JOIN {v.auc('centre', 'bag_id')} c USING (bag_id) WHERE a.auc IS NOT NULL)"""


def with_prior(spark, sf):
    rows = sized(spark, sf)
    a = rk.auc(rows, ["bag_id"], "s1", size="n_rows").select("bag_id", "auc")
    c = rk.auc(tp.centre_prior_rows(rows, v.GRID), ["bag_id"], size="n_rows").select("bag_id", F.col("auc").alias("prior"))
    return a.join(c, "bag_id").where("auc IS NOT NULL")


@query("g03_prior_normalised_skill", f"WITH {SKILL} SELECT bag_id, round(auc, 6) AS auc, round(prior, 6) AS prior, CASE WHEN prior < 1 THEN round((auc - prior)/(1 - prior), 6) END AS skill FROM sk")
def prior_normalised_skill(spark, sf):
    return r6(with_prior(spark, sf).withColumn("skill", F.when(F.col("prior") < 1, es.skill(F.col("auc"), F.col("prior")))), "auc", "prior", "skill")


@query("g04_patient_specific_skill", f"WITH {SKILL} SELECT count(*) AS n, round(avg(auc - prior), 6) AS skill, round(min(auc - prior), 6) AS lo, round(max(auc - prior), 6) AS hi FROM sk")
def patient_specific_skill(spark, sf):
    d = with_prior(spark, sf).withColumn("d", es.patient_specific(F.col("auc"), F.col("prior")))
    return r6(d.agg(count().alias("n"), F.avg("d").alias("skill"), F.min("d").alias("lo"), F.max("d").alias("hi")), "skill", "lo", "hi")


@query("g05_reference_chain", f"""WITH {v.RUNS}, l AS (SELECT seed, arm, avg(value) AS value FROM runs GROUP BY ALL),
 o AS (SELECT *, lag(arm) OVER w AS f, lag(value) OVER w AS pv, first(arm) OVER w2 AS fa, last(arm) OVER w2 AS la, last(value) OVER w2 - first(value) OVER w2 AS total FROM l
   WINDOW w AS (PARTITION BY seed ORDER BY arm), w2 AS (PARTITION BY seed ORDER BY arm ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT seed, f AS "from", arm AS "to", round(value - pv, 6) AS delta, round((value - pv)/total, 5) AS frac, 'step' AS kind FROM o WHERE f IS NOT NULL
 UNION ALL SELECT DISTINCT seed, fa, la, round(total, 6), 1.0::DOUBLE, 'total' FROM o""")
def reference_chain(spark, sf):
    links = v.runs(spark, sf).groupBy("seed", "arm").agg(F.avg("value").alias("value"))
    out = es.reference_chain(links, ["seed"], "arm", "arm", "value")
    return r6(out, "delta").withColumn("frac", F.round("frac", 5))


OUTCOME = "CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo > 0 THEN 'oracle_wins' WHEN hi < 0 THEN 'trained_wins' ELSE 'indistinguishable' END"


@query("g06_interval_outcomes", f"""WITH {v.RUNS}, d AS (SELECT arm, bag_id, value - 60 AS value FROM runs) SELECT arm, {OUTCOME} AS outcome, {rs('lo', 'hi')} FROM {v.bootstrap('d', 'arm', 'value', 'bag_id', 10000, 1)}""")
def interval_outcomes(spark, sf):
    rows = v.runs(spark, sf).withColumn("value", F.col("value") - 60)
    ci = es.cluster_bootstrap(rows, ["arm"], "value", "bag_id", 10000, 1)
    return r6(ci.select("arm", es.interval_outcome(F.col("lo"), F.col("hi")).alias("outcome"), "lo", "hi"), "lo", "hi")


@query("g07_paired_bootstrap", f"WITH {SKILL}, {v.BAGS}, d AS (SELECT auc - prior AS delta, patient_id FROM sk JOIN bags USING (bag_id)) SELECT n, n_clusters, {rs('mean', 'lo', 'hi')} FROM {v.bootstrap('d', '', 'delta', reps=10000)}")
def paired_bootstrap(spark, sf):
    d = with_prior(spark, sf).withColumn("delta", F.col("auc") - F.col("prior"))
    return r6(es.cluster_bootstrap(v.with_patient(d, spark, sf), [], "delta", "patient_id", 10000), "mean", "lo", "hi")


BATTERY = """dd AS (SELECT {k} a, b, a - b AS d FROM {src} WHERE a - b IS NOT NULL),
 rkd AS (SELECT *, avg(rn) OVER (PARTITION BY {k} abs(d)) AS mid, count(*) OVER (PARTITION BY {k} abs(d)) AS m FROM (SELECT *, row_number() OVER (PARTITION BY {k} 1 ORDER BY abs(d)) AS rn FROM dd WHERE d <> 0)),
 base AS (SELECT {k} avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_diff, stddev_samp(d)/sqrt(count(*)) AS sem_diff, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS frac_better, count(*) AS n FROM dd GROUP BY ALL),
 wil AS (SELECT {k} sum(CASE WHEN d > 0 THEN mid ELSE 0 END) AS w_plus, count(*) AS n_used, sum(m*m - 1) AS ties FROM rkd GROUP BY ALL),
 bat AS (SELECT *, mean_diff/sem_diff AS t, (w_plus - n_used*(n_used+1)/4.0::DOUBLE)/sqrt(n_used*(n_used+1)*(2*n_used+1)/24.0::DOUBLE - ties/48.0::DOUBLE) AS z FROM base {j})"""
BAT = ("mean_a", "mean_b", "mean_diff", "sem_diff", "frac_better", "w_plus", "t", "z", "t_p", "wilcoxon_p")


@query("g08_paired_tests", f"""WITH {SKILL}, ab AS (SELECT auc AS a, prior AS b FROM sk), {BATTERY.format(k='', src='ab', j=', wil')},
 fin AS (SELECT *, {p_t('t', '(n-1.0::DOUBLE)')} AS t_p, {p_normal('z')} AS wilcoxon_p FROM bat)
 SELECT n, n_used::BIGINT AS n_used, {rs(*BAT)} FROM fin""")
def paired_tests(spark, sf):
    rows = with_prior(spark, sf).select(F.col("auc").alias("a"), F.col("prior").alias("b"))
    return r6(inf.paired_battery(rows, []), *BAT)


def delong_sql(source: str, keys: str, a: str, b: str, y: str = "target") -> str:
    k, part = (f"{keys},", f"PARTITION BY {keys}") if keys else ("", "PARTITION BY 1")
    def comp(s):
        return (f"CASE WHEN {y} = 1 THEN (2*sum(1-{y}) OVER ({part} ORDER BY {s}) - sum(1-{y}) OVER ({part}, {s}))/(2.0::DOUBLE*sum(1-{y}) OVER ({part})) "
                f"ELSE (2*sum({y}) OVER ({part}) - 2*sum({y}) OVER ({part} ORDER BY {s}) + sum({y}) OVER ({part}, {s}))/(2.0::DOUBLE*sum({y}) OVER ({part})) END")
    return f"""(SELECT *, auc_a - auc_b AS delta, CASE WHEN vv > 1e-18 THEN (auc_a - auc_b)/sqrt(vv) WHEN vv IS NOT NULL THEN 0 END AS z FROM
      (SELECT {k} max(ma) FILTER (y=1) AS auc_a, max(mb) FILTER (y=1) AS auc_b, max(n) FILTER (y=1) AS n_pos, max(n) FILTER (y=0) AS n_neg, sum(v) AS vv FROM
       (SELECT {k} {y} AS y, count(*) AS n, avg(va) AS ma, avg(vb) AS mb, (var_samp(va) + var_samp(vb) - 2*covar_samp(va, vb))/count(*) AS v
        FROM (SELECT *, {comp(a)} AS va, {comp(b)} AS vb FROM {source}) GROUP BY {k} {y}) GROUP BY {keys or '()'}))"""


DEL = ("auc_a", "auc_b", "delta", "z", "p")


@query("g09_delong_pooled", f"WITH {v.FLAG}, d AS (SELECT *, {p_normal('z')} AS p FROM {delong_sql('flagged', '', 's0', 's1')}) SELECT n_pos, n_neg, {rs(*DEL)} FROM d")
def delong_pooled(spark, sf):
    return r6(inf.delong(v.flagged(spark, sf), [], "s0", "s1"), *DEL)


@query("g09_delong_per_bag", f"WITH {v.FLAG}, d AS (SELECT *, CASE WHEN z IS NOT NULL THEN {p_normal('z')} END AS p FROM {delong_sql('flagged', 'bag_id', 's1', 's2')}) SELECT bag_id, n_pos, n_neg, {rs(*DEL)} FROM d")
def delong_per_bag(spark, sf):
    return r6(inf.delong(v.flagged(spark, sf), ["bag_id"], "s1", "s2"), *DEL)


PV = """pv AS (SELECT seed, arm, CASE WHEN arm = 'error' AND seed = 2 THEN NULL ELSE least(1.0, abs(avg(value) - 50)/20)::DOUBLE END AS p FROM runs GROUP BY seed, arm)"""


@query("g10_holm", f"""WITH {v.RUNS}, {PV}, s AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n_family, p * (count(*) OVER (PARTITION BY seed) - row_number() OVER (PARTITION BY seed ORDER BY p NULLS LAST, arm) + 1) AS sc FROM pv),
 h AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, max(sc) OVER (PARTITION BY seed ORDER BY p NULLS LAST, arm ROWS UNBOUNDED PRECEDING)) END AS p_adjusted FROM s)
 SELECT seed, arm, n_family, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted, coalesce(p_adjusted <= 0.05, FALSE) AS reject,
  sum(CASE WHEN p_adjusted <= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY seed)::BIGINT AS n_reject FROM h""")
def holm(spark, sf):
    per = v.runs(spark, sf).groupBy("seed", "arm").agg(F.avg("value").alias("m"))
    p = F.when((F.col("arm") == "error") & (F.col("seed") == 2), F.lit(float("nan"))).otherwise(
        F.least(F.lit(1.0), F.abs(F.col("m") - 50) / 20))
    out = inf.holm(per.select("seed", "arm", p.alias("p")), ["seed"], "p", "arm")
    return r6(out.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "p", "p_adjusted")


@query("g11_welch_t", f"""WITH {v.RUNS}, s AS (SELECT seed, avg(value) FILTER (arm='click') AS m1, avg(value) FILTER (arm<>'click') AS m2, var_samp(value) FILTER (arm='click') AS v1, var_samp(value) FILTER (arm<>'click') AS v2,
   count(value) FILTER (arm='click') AS n1, count(value) FILTER (arm<>'click') AS n2 FROM runs GROUP BY seed),
 t AS (SELECT *, (m1-m2)/sqrt(v1/n1+v2/n2) AS t, (v1/n1+v2/n2)**2/((v1/n1)**2/(n1-1)+(v2/n2)**2/(n2-1)) AS df FROM s), p AS (SELECT *, {p_t('t', 'df')} AS p FROM t)
 SELECT seed, n1, n2, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p FROM p""")
def welch_t(spark, sf):
    out = inf.welch(v.runs(spark, sf), ["seed"], "arm", "click", "value")
    return r6(out.select("seed", "n1", "n2", "t", F.round("df", 4).alias("df"), "p"), "t", "p")


@query("g11_mann_whitney", f"""WITH {v.RUNS}, r AS (SELECT seed, value, CAST(arm='click' AS INTEGER) AS c FROM runs), a AS (SELECT * FROM {v.auc('r', 'seed', 'value', 'c')}),
 ti AS (SELECT seed, sum(m*m*m - m)::DOUBLE AS t FROM (SELECT seed, value, count(*)::HUGEINT AS m FROM r GROUP BY ALL) GROUP BY seed),
 z AS (SELECT seed, n_pos, n_neg, auc*n_pos*n_neg AS u, sign(auc*n_pos*n_neg - n_pos*n_neg/2.0::DOUBLE) * greatest(abs(auc*n_pos*n_neg - n_pos*n_neg/2.0::DOUBLE) - 0.5, 0) /
   sqrt(n_pos*n_neg/12.0::DOUBLE*((n_pos+n_neg+1) - t/((n_pos+n_neg)*(n_pos+n_neg-1.0::DOUBLE)))) AS z FROM a JOIN ti USING (seed)), p AS (SELECT *, {p_normal('z')} AS p FROM z)
 SELECT seed, n_pos, n_neg, round(u, 2) AS u, round(z, 6) AS z, round(p, 6) AS p FROM p""")
def mann_whitney(spark, sf):
    rows = v.runs(spark, sf).withColumn("c", (F.col("arm") == "click").cast("int"))
    out = inf.mann_whitney(rows, ["seed"], "c", "value")
    return r6(out.withColumn("u", F.round("u", 2)), "z", "p")


@query("g11_binomial", f"""WITH {v.RUNS}, k AS (SELECT arm, sum(CASE WHEN value > 45 THEN 1 ELSE 0 END)::BIGINT AS k, count(*) AS n FROM runs GROUP BY arm)
 SELECT arm, k, n, round((SELECT least(1, 2*sum(exp(lgamma(n+1) - lgamma(i+1) - lgamma(n-i+1) + n*ln(0.5)))) FROM range(5000) r(i) WHERE i <= least(k, n-k)), 6) AS p FROM k""")
def binomial(spark, sf):
    from patchrank.functions import tails
    per = v.runs(spark, sf).groupBy("arm").agg(F.sum((F.col("value") > 45).cast("bigint")).alias("k"), count().alias("n"))
    return r6(per.withColumn("p", tails.binomial_p("k", "n", F.lit(0.5))), "p")


@query("g11_spearman", f"""WITH {v.FLAG}, r AS (SELECT bag_id, avg(rx) OVER (PARTITION BY bag_id, s0) AS rx, avg(ry) OVER (PARTITION BY bag_id, s2) AS ry FROM
  (SELECT *, row_number() OVER (PARTITION BY bag_id ORDER BY s0) AS rx, row_number() OVER (PARTITION BY bag_id ORDER BY s2) AS ry FROM flagged))
 SELECT bag_id, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY bag_id""")
def spearman(spark, sf):
    return r6(inf.spearman(v.flagged(spark, sf), ["bag_id"], "s0", "s2"), "rho")


@query("g12_seed_summary", f"""WITH {v.RUNS}, m AS (SELECT arm, seed, avg(value) AS mean_value, max(value) AS peak FROM runs GROUP BY ALL), l AS (UNPIVOT m ON mean_value, peak INTO NAME metric VALUE x)
 SELECT arm, metric, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) AS n, array_to_string(list(round(x, 4) ORDER BY seed), ',') AS vals FROM l GROUP BY arm, metric""")
def seed_summary(spark, sf):
    m = v.runs(spark, sf).groupBy("arm", "seed").agg(F.avg("value").alias("mean_value"), F.max("value").alias("peak"))
    long = es.melt(m, ["arm", "seed"], ["mean_value", "peak"], "metric", "x")
    out = es.seed_summary(long, ["arm", "metric"], "x", "seed")
    text = F.array_join(F.transform("values", lambda x: F.round(x, 4).cast("string")), ",")
    return r6(out.withColumn("vals", text).drop("values"), "mean", "std")


@query("g13_best_arm", f"""WITH {v.RUNS}, m AS (SELECT arm, seed, avg(value) AS x FROM runs GROUP BY ALL), p AS (SELECT arm, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM m GROUP BY arm),
 b AS (SELECT * FROM p WHERE arm IN ('click', 'view', 'error') ORDER BY m DESC, arm DESC LIMIT 1),
 s AS (SELECT b.arm AS best, p.arm AS other, b.m - p.m AS delta, (b.m - p.m)/sqrt(b.v/b.n + p.v/p.n) AS t, (b.v/b.n + p.v/p.n)**2/((b.v/b.n)**2/(b.n-1) + (p.v/p.n)**2/(p.n-1)) AS df FROM p, b WHERE p.arm <> b.arm),
 q AS (SELECT *, {p_t('t', 'df')} AS p FROM s)
 SELECT best, other, {rs('delta', 't', 'p')}, delta > 0 AND p < 0.05 AS wins, delta < 0 AND p < 0.05 AS loses FROM q""")
def best_arm(spark, sf):
    m = v.runs(spark, sf).groupBy("arm", "seed").agg(F.avg("value").alias("x"))
    return r6(inf.best_against_others(m, "arm", "x", ["click", "view", "error"]).drop("df"), "delta", "t", "p")


@query("g14_floor_distribution", f"""WITH {v.RUNS}, m AS (SELECT arm, bag_id, avg(value) AS x FROM runs GROUP BY ALL)
 SELECT arm, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.95), 6) AS p95, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM m GROUP BY arm""")
def floor_distribution(spark, sf):
    m = v.runs(spark, sf).groupBy("arm", "bag_id").agg(F.avg("value").alias("x"))
    return r6(es.distribution(m, ["arm"], "x"), "mean", "median", "p5", "p95", "lo", "hi")


@query("g15_power_note", f"""WITH {v.RUNS}, e AS (SELECT * FROM runs WHERE ts < TIMESTAMP '2024-01-10'), l AS (SELECT * FROM runs WHERE ts >= TIMESTAMP '2024-01-10'),
 j AS (SELECT a.arm, a.lo AS lo_a, a.hi AS hi_a, a.mean AS mean_a, b.lo AS lo_b, b.hi AS hi_b, b.mean AS mean_b FROM {v.bootstrap('e', 'arm', 'value', 'bag_id', 10000)} a JOIN {v.bootstrap('l', 'arm', 'value', 'bag_id', 10000)} b USING (arm))
 SELECT arm, round(mean_b - mean_a, 6) AS observed, round((mean_b - lo_b) + (hi_a - mean_a), 6) AS required, round((mean_b - lo_b) + (hi_a - mean_a) - (mean_b - mean_a), 6) AS shortfall, hi_a < lo_b AS orders FROM j""")
def power_note(spark, sf):
    rows = v.runs(spark, sf)
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    def ci(part, tag):
        out = es.cluster_bootstrap(part, ["arm"], "value", "bag_id", 10000)
        return out.select("arm", *[F.col(c).alias(f"{c}_{tag}") for c in ("mean", "lo", "hi")])
    both = ci(rows.where(early), "a").join(ci(rows.where(~early), "b"), "arm")
    out = es.power_note(both, "lo_a", "hi_a", "mean_a", "lo_b", "hi_b", "mean_b")
    return r6(out.select("arm", "observed", "required", "shortfall", "orders"), "observed", "required", "shortfall")




def binary_sql(y: str, s: str) -> str:
    return f"""(SELECT auc, n_pos, n_neg, (2*tp/greatest(2*tp+fp+fn, 1e-300) + 2*tn/greatest(2*tn+fp+fn, 1e-300))/2 AS macro_f1, (tp+tn)/(tp+tn+fp+fn) AS acc,
      (tp/(tp+fn) + tn/(tn+fp))/2 AS balanced_acc FROM (SELECT sum(CASE WHEN {y}=1 AND {s}>0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN {y}=0 AND {s}>0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
       sum(CASE WHEN {y}=1 AND {s}<=0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN {y}=0 AND {s}<=0.5 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM preds), {v.auc('preds', '', s, y)})"""


MET = ("auc", "macro_f1", "acc", "balanced_acc")


@query("g16_binary_metrics", f"WITH {PREDS} SELECT n_pos, n_neg, {rs(*MET)} FROM {binary_sql('y', 'score')}")
def binary_metrics(spark, sf):
    return r6(inf.binary_metrics(predictions(spark, sf), [], "y", "score"), *MET)


@query("g16_multilabel_metrics", f"WITH {PREDS} SELECT round(avg(auc), 6) AS auc, round(avg(acc), 6) AS acc, round(avg(f1), 6) AS macro_f1 FROM (SELECT auc, acc, (SELECT 2*sum(CASE WHEN y=1 AND score>0.5 THEN 1 ELSE 0 END)::DOUBLE/greatest(sum(y) + sum(CASE WHEN score>0.5 THEN 1 ELSE 0 END), 1) FROM preds) AS f1 FROM {binary_sql('y', 'score')} UNION ALL SELECT auc, acc, (SELECT 2*sum(CASE WHEN y2=1 AND score2>0.5 THEN 1 ELSE 0 END)::DOUBLE/greatest(sum(y2) + sum(CASE WHEN score2>0.5 THEN 1 ELSE 0 END), 1) FROM preds) FROM {binary_sql('y2', 'score2')})")
def multilabel_metrics(spark, sf):
    return r6(inf.multilabel_metrics(predictions(spark, sf), [("y", "score"), ("y2", "score2")]), "auc", "acc", "macro_f1")


@query("g16_multiclass_metrics", f"""WITH p AS (SELECT vec_id, label AS y, embedding[1:10] AS sc FROM embeddings), q AS (SELECT vec_id, y, generate_subscripts(sc, 1) - 1 AS cls, CAST(unnest(sc) AS DOUBLE) AS score FROM p),
 a AS (SELECT avg(auc) AS auc FROM {v.auc('(SELECT *, CAST(y = cls AS INTEGER) AS isc FROM q)', 'cls', 'score', 'isc')}),
 pr AS (SELECT vec_id, y, cls AS pred FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) = 1),
 c AS (SELECT cls, sum(CASE WHEN y=cls AND pred=cls THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y=cls THEN 1 ELSE 0 END) AS t, sum(CASE WHEN pred=cls THEN 1 ELSE 0 END) AS p FROM pr, range(10) r(cls) GROUP BY cls)
 SELECT sum(t)::BIGINT AS n, round((SELECT auc FROM a), 6) AS auc, round(avg(2*tp/(t+p)), 6) AS macro_f1, round(sum(tp)/sum(t), 6) AS acc, round(avg(tp/t), 6) AS balanced_acc FROM c""")
def multiclass_metrics(spark, sf):
    rows = v.vectors(spark, sf).select(F.col("label").alias("y"), F.slice("embedding", 1, 10).alias("sc"))
    return r6(inf.multiclass_metrics(rows, "y", "sc", 10), *MET)
