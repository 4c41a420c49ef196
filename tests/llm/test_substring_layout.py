"""Substring dedup of rows that share a doc_id but lie in different batches."""
from patchrank.llm import substring

from . import brute


def test_a_wholly_repeated_text_takes_no_other_text_of_its_doc_id_along(make):
    shared = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    mixed = " ".join(f"c{i}" for i in range(20)) + " " + shared[:shared.index(" a30 ")] + " " + " ".join(f"d{i}" for i in range(20))
    batches = [[(1, shared), (5, shared), (5, shared), (5, "short text"), (6, shared), (7, shared), (7, other)], [(5, other), (5, mixed), (5, None)], [(6, shared), (7, mixed), (5, shared)]]
    docs = make(batches[0], 1)
    for k, rows in enumerate(batches[1:]):
        docs = docs.union(make(rows, k + 2))  # unequal numbers of partitions: a union of equal ones may merge them
    key = lambda x: tuple(map(str, x))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.dedup(docs).collect()), key=key)
    want = sorted(brute.substring([x for rows in batches for x in rows], 13), key=key)
    assert got == want and (5, 60, 0, other) in got
