"""Queries against their SQL, and the pipeline against a brute-force version of its stages."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from catalog import checks
from patchrank.llm import quality
from patchrank.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, name):
    assert checks.compare(entry.queries()[name](spark, SF), checks.duck(SF), entry.oracle_sql()[name]) == []


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard", "decontamination", "secret_scan", "bpe"]


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in quality.score(docs, model).where("score >= 0.3").collect()]
    rows = _first_of_groups(rows)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, n, h, _ in brute.contamination(rows, items) if h and 20 * h >= n}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        if i not in bad:
            clean = brute.redacted(t or "")
            want[i] = (len(tokenizer.encode(clean, add_special_tokens=False).ids), hashlib.sha256(clean.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def _first_of_groups(rows):
    kept = {i for i, _, c in brute.jaccard(rows, 5, 80) if i == c}
    return [(i, t) for i, t in rows if i in kept]


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns


def test_stages_on_hard_rows_and_on_an_empty_table(spark, make, hard):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names: every stage ends and keeps the columns."""
    holes = hard.unionByName(make([(None, None)]).withColumns({c: F.lit(None).cast(t) for c, t in hard.dtypes}))
    n = holes.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, holes, SF)
        assert out.columns == holes.columns
        rows = out.collect()
        if name == "secret_scan":
            assert len(rows) == n
        elif name == "ngram_jaccard":  # rows without a doc_id are linked with nothing and stay
            assert sum(r.doc_id is None for r in rows) == 3 and {-4} == {r.doc_id for r in rows if r.doc_id is not None and (r.doc_id in (-4, 5, 6) or r.doc_id >= 100)}
        assert stage(spark, make([]), SF).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, holes, SF)
    assert tokens.count() == n and corpus_pipeline.STAGES[-1][1](spark, make([]), SF).count() == 0
