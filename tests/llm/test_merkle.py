"""Merkle manifest against a tree built in plain Python."""
import hashlib
import random
import zlib

import pytest

from patchrank.llm import merkle


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row, text=...):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is ... else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """(root, siblings of each leaf by level as (left, right))."""
    at, paths = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 3 * 3
            path.append((digests[run:at[k]], digests[at[k] + 1:run + 3]))
            at[k] //= 3
        digests = [h(*digests[k:k + 3]) for k in range(0, len(digests), 3)]
    return digests[0], paths


def brute(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)]."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        ordered = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((ordered, *climb([leaf(r) for r in ordered])))
    root, tops = climb([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (ordered, subroot, paths), top in zip(trees, tops):
        for r, path in zip(ordered, paths):
            cut = r["text"] if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 else r["text"].replace("\n", "")
            at, proof = leaf(r, cut), ""
            for left, right in path + top:
                at = h(*left, at, *right)
                proof += "".join(left + right)
            out.append((r["doc_id"], leaf(r), subroot, root, h(proof), at, at == root))
    return sorted(out, key=repr)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a\nb", "x", "", None, "é\n"]), None if rng.random() < 0.1 else "en", rng.choice(["hot", "hot", None, "", "b", "é", f"s{i % 30}"]), i % 7 or None) for i in range(400)]
    data += data[:9] + [(None, "t\n", None, "hot", None)] * 5 + [(7, "other\n", "en", "one", 2)]
    return spark.createDataFrame(data, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(5)


@pytest.mark.parametrize("step, width", [(7, 2), (1, 1), (1, 2), (2, 2)])
def test_proofs_equal_a_plain_tree(many, step, width):
    even = merkle.F.pmod(merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")), merkle.F.lit(2)) == 0
    cut = merkle.F.when(even, merkle.leaf(text=merkle.F.replace(merkle.F.col("text"), merkle.F.lit("\n"), merkle.F.lit(""))))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, h(*r.proof), r.folded_root, r.folded_root == r.root)
           for r in merkle.proofs(many, ["doc_id"], cut, step, width).collect()]
    assert sorted(got, key=repr) == brute(rows_of(many))


def test_digests_on_hard_rows_and_an_empty_table(make, hard, spark):
    assert sorted((tuple(r) for r in merkle.digests(hard).collect()), key=repr) == brute(rows_of(hard))
    assert merkle.digests(make([])).count() == 0
    one = make([(4, "a\nb")])
    assert [tuple(r) for r in merkle.digests(one).collect()] == brute(rows_of(one))


def test_manifest_keeps_the_columns_and_proves_every_row(make):
    docs = make([(i, f"t{i}") for i in range(10)]).withColumnsRenamed({"node": "leaf", "blob": "root"})
    out = merkle.manifest(docs)
    assert set(docs.columns) <= set(out.columns) and {"subroot", "proof"} <= set(out.columns)
    assert len({r.root for r in out.collect()}) == 1 and out.count() == 10


@pytest.mark.parametrize("total", [1, 2, 3, 4, 9, 10, 28, 100])
def test_wanted_is_the_minimal_union(total):
    """A coordinate is asked for exactly if a leaf's proof needs it and no leaf of the shard stands below it."""
    for a, b in ((0, 1), (0, total), (total // 2, total), (total // 3, total // 3 + 2)):
        known = [k for k in range(a, b) if k < total]
        need = set()
        for k in known:
            level, count = 0, total
            while count > 1:
                run = k // 3 * 3
                need |= {(level, x) for x in range(run, min(run + 3, count))}
                k, level, count = k // 3, level + 1, -(-count // 3)
        have = {(level, k // 3 ** level) for k in known for level in range(12)}
        assert set(merkle.wanted(known, total, 0)) == need - have
