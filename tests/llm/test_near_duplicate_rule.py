"""The pipeline's near-duplicate stage links at five words and 0.8."""
import inspect
import os

import pyarrow as pa
import pytest

import corpus_pipeline
from patchrank.llm import jaccard
from patchrank.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"


def test_the_stage_drops_copies_that_five_words_link(make):
    base = [f"p{i}" for i in range(200)]
    edited = [f"q{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base + [f"t{i}" for i in range(40)])), (4, " ".join(f"o{i}" for i in range(200)))]
    # copies 2 and 3 are below 0.9 by three words, at 0.8 or more by five
    assert [i for i, _, c in brute.jaccard(rows, 3, 90) if i == c] == [1, 2, 3, 4]
    docs = make(rows)
    got = corpus_pipeline.drop_near_duplicates(docs.sparkSession, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _, c in brute.jaccard(rows, 5, 80) if i == c] == [1, 4]


def test_links_take_the_same_rule_by_default():
    given = inspect.signature(jaccard.links).parameters
    assert (given["width"].default, given["percent"].default) == (5, 80)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_the_stage_equals_brute_force_on_the_smallest_tables(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _, c in brute.jaccard(rows, 5, 80) if i == c)


def test_documents_with_a_common_passage_leave_their_family(make):
    """300 shared words of 400: similarity about 0.6, so no family, no incidence row; two near copies among them stay."""
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, passage + " " + " ".join(f"o{i}x{k}" for k in range(100))) for i in range(200)]
    rows.append((200, rows[7][1] + " end"))
    df = make(rows, 4)
    got = {r.doc_id: r.component_id for r in jaccard.classes_of(df, width=5, percent=80, block=5000).collect()}
    assert got == {i: 7 if i == 200 else i for i in range(201)}

    sets = []
    for i, text in rows:
        members, _ = jaccard.sets_of(jaccard.lowered(pa.array([text])), 5)
        sets.append((i, 0, bytearray(members.tobytes())))
    left = jaccard._thinned(df.sparkSession.createDataFrame(sets, jaccard.SETS).repartition(5), 80, 1000)
    assert sorted(r.doc_id for r in left.collect()) == [7, 200]


def test_a_doc_id_with_two_texts_is_never_thinned(make):
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (4, texts[2] + " x y"), (5, None)]
    got = jaccard.classes_of(make(rows, 3), width=5, percent=80, block=10).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
