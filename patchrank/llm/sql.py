"""The same results as SQL text for the comparison engine, where SQL can express them."""
from __future__ import annotations

from patchrank.llm.chat import CONTROL
from patchrank.llm.secrets import RULES as SECRET_RULES
from patchrank.llm.urls import RULES as URL_RULES


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lowered(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secret(k: int, rule) -> str:
    p = text(rule.pattern)
    return f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {rule.group}) AS v, {rule.least} AS least FROM d"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_secret(k, r) for k, r in enumerate(SECRET_RULES))}),
u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0))::BIGINT AS a,
        length(w[i]) AS n FROM u WHERE length(v[i]) >= least),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""

BLANK_WORDS = "list_filter(string_split_regex(coalesce({x}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {BLANK_WORDS.format(x='text')} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
n AS (SELECT *, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM n WHERE len(win) = 13 GROUP BY win),
h AS (SELECT n.doc_id, n.word, n.i, coalesce(len(n.win) = 13 AND f.first < n.doc_id, FALSE) AS hit FROM n LEFT JOIN f USING (win)),
c AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

ALNUM_WORDS = f"regexp_extract_all({lowered('coalesce({x}, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAM = f"""
WITH b AS (SELECT item_id, {ALNUM_WORDS.format(x='text')} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, win, len(win) AS n FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: ws[i:i+12])) AS win FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {ALNUM_WORDS.format(x='text')} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
n AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM w),
o AS (SELECT x.doc_id, x.i, x.n, bw.item_id FROM (SELECT doc_id, i, l.n, win[1:l.n] AS win FROM n, (SELECT DISTINCT n FROM bw) l WHERE len(win) >= l.n) x JOIN bw ON x.win = bw.win),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {BLANK_WORDS.format(x=lowered('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2]) END) AS g FROM d WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


def _host(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN {lowered(f'''regexp_extract({x}, '^.*?://([^/?#]*)', 1, 's')''')} ELSE '' END"


def _path(x: str) -> str:
    return f"CASE WHEN contains({x}, '://') THEN regexp_extract({x}, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END"


def _rule(host: str, path: str) -> str:
    cases = "".join(f" WHEN ({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND starts_with({path}, '{r.path}') THEN '{r.name}'"
                    for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name)))
    return f"CASE{cases} END"


_VERDICT = "CASE" + "".join(f" WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in URL_RULES) + " END"

URLS = f"""
WITH RECURSIVE l AS (SELECT DISTINCT url AS a, unnest([
    regexp_extract(html, '(?i)<link\\b[^>]*\\brel=["'']?canonical\\b[^>]*\\bhref=["'']?([^"''\\s>]+)', 1),
    regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv=["'']?refresh\\b[^>]*\\bcontent=["'']?[^"''>]*?url=\\s*["'']?([^"''>]+)', 1)]) AS b FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
e AS (SELECT a, b FROM l WHERE contains(b, '://') UNION SELECT b, a FROM l WHERE contains(b, '://')),
u AS (SELECT url, {_host('url')} AS host, {_path('url')} AS path FROM (SELECT url FROM pages UNION SELECT a FROM e)),
j AS (SELECT *, {_rule('host', 'path')} AS rule FROM u),
v AS (SELECT *, {_VERDICT} AS own FROM j),
bad AS (SELECT url FROM v WHERE own = 'block' AND url IN (SELECT a FROM e) UNION SELECT e.b FROM bad JOIN e ON e.a = bad.url)
SELECT page_id, coalesce(v.host, '') AS host, coalesce(v.path, '') AS path, v.rule,
  coalesce(v.own, CASE WHEN p.url IN (SELECT url FROM bad) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN v ON p.url = v.url"""

VECTORS = """
WITH RECURSIVE g AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id
    WHERE list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def _escaped(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, {text(c)}, {text(c[0] + chr(92) + c[1:])})"
    return x


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
f AS (SELECT *, length({_escaped('role')}) + length({_escaped('text')}) + {len('<|turn:|>' + chr(10) + '<|end|>' + chr(10))} AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

COPIES = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# unsigned CRC-32 of a decimal number: bit by bit, with the reflected polynomial of the standard
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::INTEGER, 1))::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda v, _k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS tree, {_leaf()} AS leaf,
    CASE WHEN {_CRC.format(x='doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT tree, 0 AS level, ix, n, leaf AS h FROM l
  UNION ALL SELECT tree, any_value(level) + 1, ix // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY ix)) FROM up WHERE n > 1 GROUP BY tree, ix // 3),
sub AS MATERIALIZED (SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, rank AS ix, n, subroot AS h FROM sub
  UNION ALL SELECT any_value(level) + 1, ix // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY ix)) FROM top WHERE n > 1 GROUP BY ix // 3),
beside AS MATERIALIZED (SELECT a.tree, a.level, a.ix, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix < a.ix), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix > a.ix), '') AS hi
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.ix // 3 = b.ix // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.ix
  UNION ALL SELECT NULL, a.level, a.ix, coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix < a.ix), ''), coalesce(string_agg(b.h, '' ORDER BY b.ix) FILTER (b.ix > a.ix), '')
  FROM top a JOIN top b ON a.level = b.level AND a.ix // 3 = b.ix // 3 WHERE a.n > 1 GROUP BY a.level, a.ix),
path AS (SELECT l.tree, l.ix AS leaf_ix, b.level, b.lo, b.hi FROM l JOIN beside b ON b.tree = l.tree AND b.ix = l.ix // (3 ** b.level)::BIGINT
  UNION ALL SELECT l.tree, l.ix, s.height + b.level, b.lo, b.hi FROM l JOIN sub s USING (tree) JOIN beside b ON b.tree IS NULL AND b.ix = s.rank // (3 ** b.level)::BIGINT),
proof AS MATERIALIZED (SELECT tree, leaf_ix, list(lo ORDER BY level) AS los, list(hi ORDER BY level) AS his, string_agg(lo || hi, '' ORDER BY level) AS all_of FROM path GROUP BY tree, leaf_ix),
fold AS (SELECT l.tree, l.ix, 1 AS k, coalesce(l.other, l.leaf) AS h FROM l
  UNION ALL SELECT f.tree, f.ix, f.k + 1, sha256(p.los[f.k] || f.h || p.his[f.k]) FROM fold f JOIN proof p ON p.tree = f.tree AND p.leaf_ix = f.ix WHERE f.k <= len(p.los)),
done AS (SELECT tree, ix, arg_max(h, k) AS folded_root FROM fold GROUP BY tree, ix),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.all_of, '')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM l JOIN sub s USING (tree) CROSS JOIN r JOIN done f ON f.tree = l.tree AND f.ix = l.ix LEFT JOIN proof p ON p.tree = l.tree AND p.leaf_ix = l.ix"""
