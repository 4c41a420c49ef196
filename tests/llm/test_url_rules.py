"""Many URL rules, long urls and long chains of aliases."""
import random
import time

from patchrank.llm import urls


def plain(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def test_a_thousand_rules_are_planned_in_seconds_and_the_longest_wins(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "net", "a.b.c.net", *(f"h{i}.com" for i in range(200))]
    rules = {h + p: urls.Rule(h, p, rng.choice(["allow", "block"])) for h in hosts for p in ("/", "/en/", "/en/a", "", "/x")}
    rules = list(rules.values())[:1000]
    rows = [(i, f"http://{rng.choice(['', 'www.', 'z.y.', 'no'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/ab', '/xy', '/q'])}", None) for i in range(300)]
    rows += [(900, "http://" + "a." * 20_000 + "example.com/en/" + "p" * 100_000, None), (901, None, None), (902, "com/", None), (903, "://com/", None)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    t = time.time()
    judged = urls.judge(pages, rules)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert time.time() - t < 30 and len(plan) < 200_000
    for r in judged.collect():
        name, verdict = plain(r.host, r.path, rules)
        assert (r.rule, r.verdict) == (name, verdict or "allow")
    assert {r.rule for r in urls.judge(pages, ()).collect()} == {None}


def test_a_long_chain_of_redirects_shares_its_block(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", None) for i in range(60)], "page_id BIGINT, url STRING, html STRING")
    redirects = spark.createDataFrame([(f"http://h.org/{i}", f"http://h.org/{i + 1}") for i in range(59)] + [("http://h.org/59", "http://b.net/es/")], "source STRING, target STRING")
    assert {r.verdict for r in urls.judge(pages, redirects=redirects).collect()} == {"block"}
