"""Near-duplicate search: what a census removes, and what every step makes, follows the documents and not their pairs or groups."""
import numpy as np
import pyarrow as pa
import pytest

from patchrank.llm import jaccard

from . import brute


def key(row):
    return str(row[0]), row[1], str(row[2])


def corpus():
    """Passages that many texts share, exact copies, near copies, a doc_id with two texts, null doc_ids, short and empty texts."""
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage if i % 2 else ''} " + " ".join(f"o{i}x{k}" for k in range(40))) for i in range(120)]
    base = [f"b{i}" for i in range(200)]
    for i in range(200, 240):
        rows.append((i, " ".join(f"e{i}" if k == int(rng.integers(200)) else w for k, w in enumerate(base))))
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [(5, rows[11][1]), (340, "two words"), (341, "Two  words"), (342, None), (343, " ")]
    return rows + [(None, rows[5][1]), (None, None), (None, rows[5][1])]


@pytest.mark.parametrize("width,percent,group_rows", [(3, 90, 200), (5, 80, 200), (5, 80, 1_000_000), (2, 50, 500)])
def test_links_equal_brute_force(make, width, percent, group_rows):
    rows = corpus()
    got = [tuple(r) for r in jaccard.classes_of(make(rows, 7), width=width, percent=percent, block=2000, group_rows=group_rows).collect()]
    assert sorted(got, key=key) == sorted(brute.jaccard(rows, width, percent), key=key)


def test_only_sets_that_can_link_are_signed(make, monkeypatch):
    """Texts with a common passage, and all copies but one, never reach the signatures."""
    seen = []
    thinned = jaccard._thinned
    monkeypatch.setattr(jaccard, "_thinned", lambda sets, *a: seen.extend(r.doc_id for r in sets.select("doc_id").collect()) or thinned(sets, *a))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"o{i}x{k}" for k in range(300))) for i in range(40)]
    rows += [(50, rows[7][1] + " end")] + [(i, rows[9][1]) for i in range(60, 80)]
    got = {r.doc_id: r.component_id for r in jaccard.classes_of(make(rows, 4), width=5, percent=80).collect()}
    assert got == {i: 7 if i == 50 else 9 if i >= 60 else i for i, _ in rows}
    assert {7, 50} <= set(seen) <= {7, 9, 50} and len(seen) == len(set(seen))


def test_a_group_of_codes_returns_its_singles_packed():
    """200 documents with a code of their own in each of 9 groups: rows follow the groups, not documents times groups."""
    groups, ids = 9, np.arange(200) * 3
    codes = (np.repeat(np.arange(groups), 200).astype(np.uint64) << np.uint64(32)) | np.arange(groups * 200, dtype=np.uint64)
    sent = list(jaccard._coded(codes, np.tile(np.arange(200), groups), ids))
    told = [r for batch in jaccard._census(groups)(iter(sent)) for r in batch.to_pylist()]
    assert len(told) <= groups * groups
    told.sort(key=lambda r: r["grp"])
    summed = pa.Table.from_batches(jaccard._summed(iter([pa.RecordBatch.from_pylist(told)])))
    assert sorted(zip(*(summed[c].to_pylist() for c in ("doc_id", "alone")))) == [(i, groups) for i in ids.tolist()]


def test_groups_that_link_the_same_sets_add_no_edges():
    """Near copies agree in most groups of signatures: a packed row a group, and one forest of all."""
    groups, ids = 20, np.arange(100) * 5
    sigs = np.repeat(np.arange(groups, dtype=np.uint64) * np.uint64((1 << 64) // groups), 100) + np.uint64(1 << 40)
    sent = list(jaccard._dealt([sigs], [np.tile(ids, groups)], groups))
    packed = list(jaccard._families(iter(sent)))
    assert sum(x.num_rows for x in packed) == groups
    edges = pa.Table.from_batches(jaccard._forests(iter(packed)))
    assert sorted(edges["a"].to_pylist()) == ids[1:].tolist() and set(edges["b"].to_pylist()) == {0}
