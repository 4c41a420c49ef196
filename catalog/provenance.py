"""Splits, fingerprints, chains and gates over orders, customers and line items."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchrank.operators import estimands as es
from patchrank.operators import filters as fl
from patchrank.operators import provenance as pv
from patchrank.operators import splits as sp

from . import views as v
from .filters import ARMS, SPEC, arms, count
from .registry import query, r6, rs

SPLIT = f"""{v.SERIES}, lc AS (SELECT patient_id, label, count(*) AS n FROM series GROUP BY ALL),
 st AS (SELECT patient_id, label AS stratum, (SELECT sum(n) FROM lc x WHERE x.patient_id = lc.patient_id)::BIGINT AS n_series FROM lc QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, label) = 1),
 pl AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '0', patient_id)), patient_id) - 1 AS ix, count(*) OVER (PARTITION BY stratum) AS n FROM st),
 sp AS (SELECT patient_id, stratum, n_series, CASE WHEN ix < round_even(0.7::DOUBLE*n, 0) THEN 'train' WHEN ix < round_even(0.7::DOUBLE*n, 0) + round_even(0.15::DOUBLE*n, 0) THEN 'val' ELSE 'test' END AS split FROM pl),
 asg AS (SELECT s.*, split FROM series s JOIN sp USING (patient_id))"""


def assigned(spark, sf):
    rows = v.series(spark, sf)
    return sp.assign(rows, sp.stratified_split(rows))


@query("j01_stratified_split", f"WITH {SPLIT} SELECT * FROM sp")
def stratified_split(spark, sf):
    return sp.stratified_split(v.series(spark, sf))


RARE = "(status = 'F' AND price > 480000)"


@query("j02_masked_to_eval", f"""WITH {SPLIT}, mk AS (SELECT DISTINCT patient_id FROM asg WHERE {RARE}), mv AS (SELECT DISTINCT patient_id FROM asg WHERE split='train' AND patient_id IN (SELECT patient_id FROM mk)),
 t AS (SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '0', patient_id)), patient_id) - 1 < (SELECT count(*) FROM mv)//2 THEN 'val' ELSE 'test' END AS too FROM mv)
 SELECT bag_id, CASE WHEN split='train' AND t.too IS NOT NULL THEN too ELSE split END AS split FROM asg LEFT JOIN t USING (patient_id)""")
def masked_to_eval(spark, sf):
    rows = assigned(spark, sf).withColumn("has_mask", F.expr(RARE))
    return sp.masked_to_eval(rows).select("bag_id", "split")


@query("j03_class_counts", f"""WITH {SPLIT} SELECT split, {', '.join(f'sum(CASE WHEN label={i} THEN 1 ELSE 0 END)::BIGINT AS "{i}"' for i in range(1, 7))}, TRUE AS empty_class FROM asg GROUP BY split""")
def class_counts(spark, sf):
    return sp.class_counts(assigned(spark, sf), [1, 2, 3, 4, 5, 6])


@query("j03_leak_check", f"""WITH {SPLIT} SELECT (SELECT count(*) FROM (SELECT patient_id FROM asg GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS n_leaks, count(*) AS n_series FROM asg""")
def leak_check(spark, sf):
    rows = assigned(spark, sf)
    n = sp.leaks(rows).agg(count().alias("n"))
    return rows.agg(count().alias("n_series")).withColumn("n_leaks", n.scalar())


JSON_SQL = """'{"bag_id":' || bag_id || ',"label":' || label || ',"patient_id":' || patient_id || '}'"""


@query("j04_canonical_hash", f"WITH {v.SERIES} SELECT bag_id, left(sha256({JSON_SQL}), 16) AS hash FROM series")
def canonical_hash(spark, sf):
    return v.series(spark, sf).select("bag_id", pv.canonical_hash(["patient_id", "label", "bag_id"]).alias("hash"))


@query("j04_split_fingerprint", f"WITH {v.SERIES} SELECT label, bit_xor(CAST('0x' || left(sha256({JSON_SQL}), 15) AS BIGINT)) AS fingerprint, count(*) AS n FROM series GROUP BY label")
def split_fingerprint(spark, sf):
    return pv.table_fingerprint(v.series(spark, sf), ["patient_id", "label", "bag_id"], ["label"])


@query("j05_verify_splits", """WITH d AS (SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN md5(c_custkey || '|' || c_nationkey) END AS h FROM customer),
 f AS (SELECT c_custkey AS k, md5(c_custkey || '|' || CASE WHEN n % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END) AS h FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey)
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN f.k IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'unrecorded' WHEN d.h = f.h THEN 'ok' ELSE 'mismatch' END AS status FROM d LEFT JOIN f USING (k)) GROUP BY status""")
def verify_splits(spark, sf):
    cust = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nat"), "c_acctbal")
    def h(nat):
        return F.md5(F.concat_ws("|", F.col("k").cast("string"), nat.cast("string")))
    declared = cust.select("k", F.when(F.col("c_acctbal") >= 0, h(F.col("nat"))).alias("hash"))
    n = (v.table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(count().alias("n")))
    found = cust.join(n, "k").select("k", h(F.when(F.col("n") % 7 == 0, F.col("nat") + 1).otherwise(F.col("nat"))).alias("hash"))
    return pv.verify_hashes(declared, found, "k").groupBy("status").agg(count().alias("n"))


CHAIN = """chain AS (SELECT o_orderkey AS seq, CASE WHEN o_orderpriority <> '5-LOW' THEN 'amendment' END AS kind,
  CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'P' THEN 'not-a-hash' WHEN o_totalprice > 490000 THEN left(md5('x' || o_orderkey), 16) ELSE left(md5('' || (o_orderkey - 1)), 16) END AS before, left(md5('' || o_orderkey), 16) AS after FROM orders WHERE o_orderkey % 101 <> 0)"""


def chain(spark, sf):
    """Entries whose number 101 divides have been removed."""
    o = v.table(spark, sf, "orders").where("o_orderkey % 101 <> 0")
    def h(text):
        return F.left(F.md5(text), F.lit(16))
    key = F.col("o_orderkey")
    before = (F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "P"), "not-a-hash")
              .when(F.col("o_totalprice") > 490000, h(F.concat(F.lit("x"), key.cast("string"))))
              .otherwise(h((key - 1).cast("string"))))
    return o.select(key.alias("seq"), F.when(F.col("o_orderpriority") != "5-LOW", "amendment").alias("kind"),
                    before.alias("before"), h(key.cast("string")).alias("after"))


@query("j06_amendment_chain", f"""WITH {CHAIN} SELECT status, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, CASE WHEN NOT (regexp_matches(before, '^[0-9a-f]{{16}}$') AND regexp_matches(after, '^[0-9a-f]{{16}}$')) THEN 'not_hex' WHEN kind IS NULL THEN 'no_kind'
  WHEN lead(before) OVER (ORDER BY seq) <> after THEN 'gap' ELSE 'ok' END AS status FROM chain) GROUP BY status""")
def amendment_chain(spark, sf):
    return pv.chain_check(chain(spark, sf)).groupBy("status").agg(count().alias("n"), F.min("seq").alias("first_seq"))


LINEAGE = """lin AS (SELECT o_orderkey AS seq, left(md5('' || (o_orderkey - CASE WHEN o_orderstatus='P' THEN 0 ELSE 1 END)), 16) AS before, left(md5('' || o_orderkey), 16) AS after FROM orders)"""


def lineage(spark, sf):
    key = F.col("o_orderkey")
    prev = key - F.when(F.col("o_orderstatus") == "P", 0).otherwise(1)
    return v.table(spark, sf, "orders").select(key.alias("seq"), F.left(F.md5(prev.cast("string")), F.lit(16)).alias("before"),
                                              F.left(F.md5(key.cast("string")), F.lit(16)).alias("after"))


@query("j07_place_stamps", f"""WITH {LINEAGE}, s AS (SELECT left(md5(CASE WHEN l_quantity > 45 THEN 'u' ELSE '' END || l_orderkey), 16) AS hash FROM lineitem),
 st AS (SELECT seq AS ord, after AS hash, CASE WHEN before <> after THEN 1 ELSE 0 END AS ch FROM lin UNION ALL SELECT min(seq) - 1, min_by(before, seq), 0 FROM lin),
 cu AS (SELECT *, coalesce(sum(ch) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS later FROM st), pc AS (SELECT hash, min_by(later, ord) AS n_later FROM cu GROUP BY hash)
 SELECT status, count(*) AS n, sum(n_later)::BIGINT AS later FROM (SELECT CASE WHEN s.hash = (SELECT max_by(after, seq) FROM lin) THEN 'current' WHEN n_later IS NULL THEN 'unknown' ELSE 'superseded' END AS status, n_later FROM s LEFT JOIN pc USING (hash)) GROUP BY status""")
def place_stamps(spark, sf):
    key = F.concat(F.when(F.col("l_quantity") > 45, "u").otherwise(""), F.col("l_orderkey").cast("string"))
    stamps = v.table(spark, sf, "lineitem").select(F.left(F.md5(key), F.lit(16)).alias("hash"), "l_partkey")
    out = pv.place_stamps(stamps, lineage(spark, sf), "l_partkey")
    return out.groupBy("status").agg(count().alias("n"), F.sum("n_later").alias("later"))


@query("c11_stamp_lineage", f"WITH {LINEAGE} SELECT l.seq IS NOT NULL AS known, count(*) AS n FROM (SELECT left(md5('' || l_orderkey), 16) AS hash FROM lineitem) s LEFT JOIN (SELECT after AS hash, min(seq) AS seq FROM lin GROUP BY 1) l USING (hash) GROUP BY 1")
def stamp_lineage(spark, sf):
    from patchrank.operators.scale import attach
    stamps = v.table(spark, sf, "lineitem").select(F.left(F.md5(F.col("l_orderkey").cast("string")), F.lit(16)).alias("hash"), "l_partkey")
    known = lineage(spark, sf).groupBy(F.col("after").alias("hash")).agg(F.min("seq").alias("seq"))
    out = attach(stamps, known, ["hash"], "l_partkey", how="left")
    return out.groupBy(F.col("seq").isNotNull().alias("known")).agg(count().alias("n"))


@query("j08_strict_lookup", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def strict_lookup(spark, sf):
    config = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    rows = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")
    return pv.require(rows, config, "key", "n_name", "c_custkey").groupBy("n_name").agg(count().alias("n"))


@query("j38_declared_roles", f"WITH {ARMS} SELECT r.arm, a.scoring_class AS role, count(*) AS n FROM runs r JOIN arms a USING (arm) GROUP BY ALL")
def declared_roles(spark, sf):
    config = arms(spark, sf).select("arm", F.col("scoring_class").alias("role"))
    return pv.require(v.runs(spark, sf), config, "arm", "role", "event_id").groupBy("arm", "role").agg(count().alias("n"))


@query("j09_blind_codes", """WITH c AS (SELECT DISTINCT c_name AS name, 'ARM-' || upper(left(sha256('s1' || c_name), 6)) AS code FROM customer), k AS (SELECT code, count(*) AS n FROM c GROUP BY code)
 SELECT count(*) AS n_names, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS n_colliding, min(code) AS first_code FROM c JOIN k USING (code)""")
def blind_codes(spark, sf):
    names = v.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    key = pv.blind_key(names, "name", "s1")
    return key.agg(count().alias("n_names"), F.sum((F.col("n_same_code") > 1).cast("bigint")).alias("n_colliding"), F.min("code").alias("first_code"))


@query("j09_blind_round_trip", f"""WITH {v.RUNS}, t AS (SELECT DISTINCT arm, arm || '_seed' || seed AS tag FROM runs)
 SELECT CASE WHEN arm = 'view' THEN arm ELSE 'ARM-' || upper(left(sha256('s1' || arm), 6)) END AS code, count(*) AS n_tags, min(CASE WHEN arm = 'view' THEN tag ELSE replace(tag, arm, 'ARM-' || upper(left(sha256('s1' || arm), 6))) END) AS first_tag, count(*) AS n_restored
 FROM t GROUP BY arm""")
def blind_round_trip(spark, sf):
    """Names and tags under blinding, the declared control left open, and restored by the inverse."""
    rows = v.runs(spark, sf).select("arm", F.concat("arm", F.lit("_seed"), F.col("seed").cast("string")).alias("tag")).distinct()
    key = pv.blind_key(rows, "arm", "s1").select(F.col("arm").alias("name"), "code", (F.col("arm") != "view").alias("blind"))
    hidden = pv.blind(rows.withColumn("spec", F.col("tag")), key, "arm", ["tag"])
    back = pv.blind(hidden.withColumn("code", F.col("arm")).withColumn("first", F.col("tag")), key, "arm", ["tag"], inverse=True)
    return back.groupBy("code").agg(count().alias("n_tags"), F.min("first").alias("first_tag"), F.count_if(F.col("tag") == F.col("spec")).alias("n_restored"))


@query("j09_blinded_report", f"WITH {v.RUNS} SELECT 'ARM-' || upper(left(sha256('s1' || arm), 6)) AS code, count(*) AS n, round(avg(value), 6) AS mean, FALSE AS leaks FROM runs GROUP BY arm")
def blinded_report(spark, sf):
    rows = v.runs(spark, sf)
    key = pv.blind_key(rows, "arm", "s1").select("arm", "code")
    per = rows.groupBy("arm").agg(count().alias("n"), F.avg("value").alias("mean"))
    out = per.join(key, "arm").withColumn("leaks", F.contains(F.lower("code"), F.col("arm"))).drop("arm")
    return r6(out, "mean")


GATE = """dec AS (SELECT c_custkey AS k, c_nationkey AS grp FROM customer), fnd AS (SELECT o_custkey AS k, CASE WHEN max(o_totalprice) > 499000 THEN NULL WHEN max(o_totalprice) > 495000 THEN 'old' ELSE 'now' END AS hash,
   CASE WHEN min(o_totalprice) < 1500 THEN 'explore' ELSE 'confirm' END AS role, bool_or(o_totalprice BETWEEN 250000 AND 250050) AS dirty FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
 g AS (SELECT k, grp, CASE WHEN fnd.k IS NULL THEN 'missing' WHEN hash IS NULL THEN 'no stamp' WHEN hash <> 'now' THEN 'wrong lineage' WHEN role <> 'confirm' THEN 'wrong role' WHEN dirty THEN 'dirty tree' END AS reason FROM dec LEFT JOIN fnd USING (k)),
 gk AS (SELECT *, CASE WHEN reason IS NULL THEN 'usable' WHEN reason = 'missing' THEN 'ABSENT' ELSE 'UNTRUSTED' END AS kind FROM g)"""


def gated(spark, sf):
    declared = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("grp"))
    o = v.table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    top, low = F.max("o_totalprice"), F.min("o_totalprice")
    found = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.when(top > 499000, F.lit(None)).when(top > 495000, "old").otherwise("now").alias("hash"),
        F.when(low < 1500, "explore").otherwise("confirm").alias("role"),
        F.bool_or(F.col("o_totalprice").between(250000, 250050)).alias("dirty"))
    return pv.gate(declared, found, "k", "now", "confirm")


@query("j10_artefact_gate", f"WITH {GATE} SELECT kind, reason, count(*) AS n FROM gk GROUP BY ALL")
def artefact_gate(spark, sf):
    return gated(spark, sf).groupBy("kind", "reason").agg(count().alias("n"))


@query("j10_gated_groups", f"WITH {GATE} SELECT grp, CASE WHEN bool_or(kind='UNTRUSTED') THEN 'VOID' WHEN bool_or(kind='usable') THEN 'usable' ELSE 'NOT_RUN' END AS state, sum(CASE WHEN kind='usable' THEN 1 ELSE 0 END)::BIGINT AS n_usable, count(*) AS n_declared FROM gk GROUP BY grp")
def gated_groups(spark, sf):
    return pv.gate_groups(gated(spark, sf), "grp")


@query("j11_mean_over_seeds", f"WITH {v.RUNS}, t AS (SELECT arm, seed, avg(value) AS x FROM runs GROUP BY ALL) SELECT arm, round(avg(x), 6) AS mean, count(*) AS n_seeds, array_to_string(list(round(x, 3) ORDER BY seed), ' ') AS per_seed FROM t GROUP BY arm")
def mean_over_seeds(spark, sf):
    per = v.runs(spark, sf).groupBy("arm", "seed").agg(F.avg("value").alias("x"))
    out = es.seed_summary(per, ["arm"], "x", "seed")
    text = F.array_join(F.transform("values", lambda x: F.round(x, 3).cast("string")), " ")
    return r6(out.select("arm", "mean", F.col("n").alias("n_seeds"), text.alias("per_seed")), "mean")


@query("a11_metadata_diff", """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS p FROM orders WHERE o_totalprice > 2000), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority='1-URGENT' AND o_orderstatus='P' THEN 'X' ELSE o_orderstatus END AS s, o_custkey AS p FROM orders WHERE o_totalprice < 490000)
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN r.k IS NULL THEN 'only_left' WHEN l.k IS NULL THEN 'only_right' WHEN l.s = r.s AND l.p = r.p THEN 'same' ELSE 'changed' END AS status FROM l FULL JOIN r USING (k)) GROUP BY status""")
def metadata_diff(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("p"), "o_totalprice", "o_orderpriority")
    right = o.where("o_totalprice < 490000").withColumn(
        "s", F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("s") == "P"), "X").otherwise(F.col("s")))
    return pv.diff_tables(o.where("o_totalprice > 2000"), right, "k", ["s", "p"]).groupBy("status").agg(count().alias("n"))
