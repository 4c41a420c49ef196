"""Substring dedup, Jaccard join, decontamination and BPE against brute force on hard rows."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from patchrank.llm import bpe, decontam, jaccard, substring
from patchrank.llm import text as T

from . import brute


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def some_texts(seed, n=60):
    """Texts that share passages of all lengths around the window."""
    rng = random.Random(seed)
    pool = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(3, 40))] for _ in range(8)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages)[rng.randint(0, 4):] if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randint(1, 30))]
        out.append((rng.choice([i, i, 1000 - i]), rng.choice([" ", "\n", "  "]).join(w)))
    return out


def test_word_fingerprints_follow_the_words_alone():
    texts = ["the cat  the", None, "", "\tthe\ncat", "éa the"]
    words = T.Words(*T.utf8(pa.array(texts)), T.BLANK)
    h = words.hashes()
    assert words.counts().tolist() == [3, 0, 0, 2, 2]
    assert h[0] == h[2] == h[3] == h[6] and h[1] == h[4] and len(set(h.tolist())) == 3
    sh, first = T.shingles(h, words.first, 2)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 1] and sh[0] == sh[2]


def test_batches_keep_every_row():
    rows = pa.table({"text": ["a" * 10, None, "b" * 100, "", "c" * 5] * 7})
    got = pa.concat_tables(T.batches(iter(rows.to_batches(max_chunksize=4)), 30))
    assert got["text"].to_pylist() == rows["text"].to_pylist()


@pytest.mark.parametrize("group_rows", [1_000_000, 10])
def test_substring_equals_brute_force(make, hard, group_rows):
    for df, width in ((hard, 13), (make(some_texts(1)), 5)):
        got = substring.dedup(df, width, group_rows)
        assert {"node", "blob", "_shard", "n_chars"} <= set(got.columns)
        mine = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got.collect()))
        want = sorted(((i is None, i or 0, n, g, k) for i, n, g, k in brute.substring(pairs(df), width)))
        assert mine == want


def test_substring_digests_and_empty_table(make, hard):
    got = substring.digests(hard).collect()
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute.substring(pairs(hard), 13)}
    assert {tuple(r) for r in got} == want and len(got) == hard.count()
    assert substring.digests(make([])).count() == 0


def test_path_groups_cut_frequent_prefixes():
    counts = np.zeros(1 << substring.CELL_BITS, np.int64)
    counts[[1, 2, 3, 9]] = 4, 4, 100, 4
    groups = substring.Groups(counts, 10)
    codes = np.array([(c << 48) | (t << 16) for c, t in ((1, 0), (2, 5), (3, 0), (3, (1 << 32) - 1), (9, 1))], np.uint64)
    got = groups.of(codes)
    assert got[0] == got[1] and got[3] - got[2] == 9 and got[4] > got[3] and groups.n == got[4] + 1


@pytest.mark.parametrize("block, width, percent", [(2_000_000, 3, 90), (150, 3, 90), (1000, 5, 80)])
def test_jaccard_equals_brute_force(make, hard, block, width, percent):
    for df in (hard, make(some_texts(2, 50) + some_texts(2, 50))):
        got = [tuple(r) for r in jaccard.classes_of(df, width=width, percent=percent, block=block).collect()]
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(got, key=key) == sorted(brute.jaccard(pairs(df), width, percent), key=key)


@pytest.mark.parametrize("width, percent, edits", [(3, 90, 5), (5, 80, 8)])
def test_jaccard_near_copies_at_the_bound(make, width, percent, edits):
    rng = random.Random(5)
    base = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(200)] = f"q{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = make(rows, 5)
    assert sorted(tuple(r) for r in jaccard.classes_of(df, width=width, percent=percent, block=900).collect()) == sorted(brute.jaccard(rows, width, percent))


@pytest.mark.parametrize("percent", [90, 80])
@pytest.mark.parametrize("size", [1, 3, 9, 19, 20, 50, 333])
def test_linked_sets_share_a_signature(size, percent):
    rng = np.random.default_rng(size)
    part = 19 if percent == 90 else 9
    for _ in range(100):
        a = rng.integers(1, 2 ** 63, size).astype(np.uint64)
        drop = rng.integers(0, size // part + 1)
        b = np.concatenate([a[drop:], rng.integers(1, 2 ** 63, rng.integers(0, size // part + 2)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        classes = jaccard.Classes(percent, len(a))
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= percent * (len(a) + len(b) - o):
            classes_b = jaccard.Classes(percent, 2 * len(b))
            assert len(np.intersect1d(jaccard.signatures(a, classes), jaccard.signatures(b, classes_b)))
            assert len(np.intersect1d(jaccard.signatures(a, classes_b), jaccard.signatures(b, classes_b)))


def test_jaccard_dedup_keeps_the_smallest(make, hard):
    kept = {r.doc_id for r in jaccard.dedup(hard, width=3, percent=90).select("doc_id").collect()}
    assert kept == {i for i, _, c in brute.jaccard(pairs(hard)) if i == c}
    assert jaccard.dedup(hard).columns == hard.columns
    assert jaccard.classes_of(make([])).count() == 0 and jaccard.dedup(make([(1, None)])).count() == 1


ITEMS = [(1, " ".join(f"A{i}" for i in range(20, 45))), (2, "one, TWO!"), (3, None), (None, "same"), (4, ""), (5, "é ü é ü é ü é ü é ü é ü é"), (1, "tail words")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, make, hard, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    got = decontam.mark(hard, items, block_bytes=block_bytes)
    mine = sorted((r.doc_id is None, r.doc_id or 0, r._words, r._hit, r._items) for r in got.collect())
    want = sorted((i is None, i or 0, n, h, x) for i, n, h, x in brute.contamination(pairs(hard), ITEMS))
    assert mine == want


def test_decontamination_drops_and_cuts(spark, make):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id BIGINT, text STRING")
    docs = make([(1, "ALPHA, beta\tGamma."), (2, "x " * 70 + "alpha beta gamma"), (3, "alpha beta"), (4, None)])
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect()) == [2, 3, 4]
    assert decontam.decontaminate(docs, items).columns == docs.columns
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect()}
    assert cut == {1: ".", 2: "x " * 70, 3: "alpha beta", 4: ""}
    none = items.where("item_id > 5")
    assert decontam.decontaminate(docs, none).count() == 4 and decontam.decontaminate(make([]), items).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    s = np.append(rng.integers(1, 5, 500), 0)
    s[100:160] = s[200:260]
    index = decontam.FMIndex(s, 6)
    for n in (1, 2, 7, 40):
        phrase = s[205:205 + n]
        low, high = index.search(phrase[None, :], np.array([n]))
        want = [i for i in range(len(s) - n + 1) if (s[i:i + n] == phrase).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
    assert np.subtract(*index.search(np.array([[5, 5]]), np.array([2])))[0] == 0


ODD = ["a<|endoftext|>  b <|endoftext|><|endoftext|>x", "it's  we'll\n\n\t x'S   y \u0085z \x1cq ½ ① ٣ 漢字 \U0001F600 ' ''s  ", " ", "\n", "​﻿᠎ a b  c", "<|endoftext", "\x00"]


def test_bpe_equals_the_library_and_round_trips(make, hard):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = corpus_pipeline.vocabulary()
    df = make(pairs(hard) + [(500 + i, t) for i, t in enumerate(ODD)])
    encoded = bpe.encode(df, vocabulary)
    assert {"node", "blob", "_shard"} <= set(encoded.columns)
    rows = encoded.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
    back = bpe.decode(encoded.select("doc_id", "ids", "n_chars"), vocabulary).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in pairs(df))
    digest = {r.doc_id: r for r in bpe.digests(df, vocabulary).collect()}
    for i, t in pairs(df):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() or i in (None, 6)
        assert digest[500].decoded_sha256 == hashlib.sha256(ODD[0].encode()).hexdigest()
    assert bpe.digests(make([]), vocabulary).count() == 0


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_slices_unpack_to_what_was_packed(small):
    from patchrank.llm.common import packed_slices, unpacked_slice
    rng = np.random.default_rng(1)
    codes = np.sort(rng.integers(0, 2 ** 63, 9000).astype(np.uint64))
    grp, owner, ids = (codes >> np.uint64(51)).astype(np.int64), rng.integers(0, 300, 9000), np.sort(rng.integers(-10 ** 12, 10 ** 12, 300))
    rows = [(g, *unpacked_slice(c, r, d)) for columns in packed_slices(grp, codes, owner, ids, small) for g, c, r, d in zip(*(x.to_pylist() for x in columns))]
    assert [r[0] for r in rows] == sorted(set(grp.tolist()))
    assert (np.concatenate([r[1] for r in rows]) == codes).all() and (np.concatenate([r[2] for r in rows]) == ids[owner]).all()
