"""The word rule against the tokenizers library, on every code point."""
import json
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patchrank.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_of_every_code_point_before_an_apostrophe():
    vocabulary, library = bpe.Vocabulary.read(PATH), Tokenizer.from_file(PATH)
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    step = 1 << 14
    for a in range(0, len(points), step):
        texts = [f"x{c}'s 1{c}2" for c in points[a:a + step]]
        words = [vocabulary.words(t) for t in texts]
        assert ["".join(w) for w in words] == texts
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = vocabulary.encode([w for ws in words for w in ws])
        at = 0
        for t, ws, ids in zip(texts, words, want):
            got = [i for w in flat[at:at + len(ws)] for i in w]
            at += len(ws)
            assert got == ids, t


def test_unsettled_code_points_beside_special_tokens():
    vocabulary, library = bpe.Vocabulary.read(PATH), Tokenizer.from_file(PATH)
    for c in sorted(bpe.unsettled())[::997]:
        for text in (f"{c}'s<|endoftext|>x{c}'s", f" {c}<|endoftext|>", c, f"{c}\n\n {c}", f"\u00e9{c}'ll \u4e2d{c}"):
            got = [i for ids in vocabulary.encode(vocabulary.words(text)) for i in ids]
            assert got == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))
