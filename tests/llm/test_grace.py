"""Grace hash dedup against brute force on hard rows."""
import hashlib
import random
import re

import pytest

from patchrank.llm import grace

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """[(doc_id, keep_id, group_size, kept, sha)]."""
    found = {}
    for i, t in rows:
        found.setdefault(BLANKS.sub(" ", t or ""), []).append(i)
    out = []
    for text, ids in found.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_normalised_is_the_pattern():
    for t in ["", " ", "\t\n", "a", " a", "a ", " a\r\n\x0bb\x0c ", "a\x1cb\x85c  d", "é  ü\n"]:
        assert grace.normalised(t.encode()) == BLANKS.sub(" ", t).encode()


def test_table_compares_complete_contents():
    table = grace.Table()
    words = [b"%d" % (i % 300) for i in range(1000)]
    assert [table.put(7, w) for w in words] == [i % 300 for i in range(1000)]  # one hash for all
    other = grace.Table()
    assert [other.put(hash(w), w) for w in words] == [i % 300 for i in range(1000)]


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 300, "bucket_bytes": 9000, "fan": 4}, {"batch_bytes": 1, "bucket_bytes": 500, "fan": 16}])
def test_groups_equal_brute_force(make, hard, options):
    rng = random.Random(3)
    many = [(i, rng.choice(["hot\tcopy", "hot  copy", "a b", " a b", f"own {i} " + "z" * (i % 50)])) for i in range(150)]
    for df in (hard, make(many + many[:20], 7)):
        got = grace.groups(df, **options)
        assert {"node", "blob", "_shard", "n_chars", "text"} <= set(got.columns)
        mine = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()), key=repr)
        assert mine == brute(pairs(df))


def test_digests_dedup_and_empty_table(make, hard):
    assert sorted((tuple(r) for r in grace.digests(hard).collect()), key=repr) == brute(pairs(hard))
    kept = grace.dedup(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, _, k, _ in brute(pairs(hard)) if k), key=repr)
    assert grace.digests(make([])).count() == 0 and grace.dedup(make([])).count() == 0
    assert [tuple(r)[1:4] for r in grace.digests(make([(None, None), (None, "")])).collect()].count((None, 2, True)) == 1


def test_result_names_of_the_caller_are_replaced(make):
    df = make([(2, "x"), (1, "x")]).withColumnsRenamed({"node": "kept", "blob": "entry", "score": "sha", "lang": "bucket"})
    got = {r.doc_id: r for r in grace.groups(df).collect()}
    assert got[1].kept is True and got[2].kept is False and got[2].entry == "x" and got[2].bucket == "en"
