"""BPE encoding and decoding through a table of distinct words.

1. Documents are dealt into shards of a bounded size. Each shard splits its texts into words and asks once for each distinct word.
2. Requests meet by word hash. Each part of the word table encodes each of its distinct words once, with the tokenizer itself, and
   answers every shard that asked.
3. A shard numbers its words, takes the answers in the order of its requests, and joins the ids back by position. Decoding looks every id up in the table of pieces, whose size is the
   vocabulary's.

Frequent words travel once per shard, never once per occurrence. The shuffle of the documents is shared by steps 1 and 3.
"""
from __future__ import annotations

import functools
import hashlib
import json
import os
import sys
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import schema_with, spread

WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level word rule
RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}  # the pre-tokenizer that splits by WORD
SHARD_BYTES = 16 << 20
ASKED = "part INT, shard INT, words BINARY"
ANSWERED = "shard INT, part INT, ids BINARY"


def byte_letters() -> dict[str, int]:
    """Letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def unsettled() -> frozenset[str]:
    """Code points that the regular expressions take for letters or digits but this Python's Unicode tables do not know yet.

    The tokenizers library may class them otherwise, so a text that holds one is split by the library itself.
    """
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE tokenizer file; executors get its text, not its path.

    A file with a normalizer, another pre-tokenizer or added tokens that reach beyond their own characters is an error: its texts are not cut into words by ``WORD``.
    """
    spec: str

    def __post_init__(self):
        spec = json.loads(self.spec)
        rule = {"add_prefix_space": True, "use_regex": True} | (spec.get("pre_tokenizer") or {})
        if spec.get("normalizer") or any(rule.get(k) != v for k, v in RULE.items()):
            raise ValueError("only tokenizers without a normalizer whose pre-tokenizer is byte-level, without a prefix space, can be used")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip blanks or stand for whole words only cannot be used")

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    @functools.cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in json.loads(self.spec)["added_tokens"]}

    @functools.cached_property
    def pieces(self) -> list[bytes]:
        letters = byte_letters()
        model = json.loads(self.spec)["model"]["vocab"]
        out = [b""] * (1 + max([*model.values(), *self.special.values()]))
        for token, i in model.items():
            out[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    @functools.cached_property
    def words(self):
        """Function from a text to its words in order; special tokens are words."""
        plain, odd = regex.compile(WORD).findall, unsettled()

        def find(text: str) -> list[str]:
            return plain(text) if text.isascii() or odd.isdisjoint(text) else self.split(text)
        if not self.special:
            return find
        split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        hints = tuple(self.special)

        def words(text: str) -> list[str]:
            if not any(h in text for h in hints):
                return find(text)
            return [w for i, part in enumerate(split(text)) for w in ([part] if i % 2 else find(part))]
        return words

    @functools.cached_property
    def split(self):
        """Function from a text without special tokens to the words that the library cuts it into."""
        from tokenizers import Tokenizer
        cut, letters = Tokenizer.from_str(self.spec).pre_tokenizer.pre_tokenize_str, byte_letters()
        return lambda text: [bytes(letters[c] for c in word).decode() for word, _ in cut(text)]

    @functools.cached_property
    def encode(self):
        """Function from words to their ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(self.spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def pack(values: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, values), np.uint32, len(values))
    return zlib.compress(np.uint32(len(values)).tobytes() + sizes.tobytes() + b"".join(values), 6)


def unpack(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    ends = np.cumsum(np.frombuffer(data[4:4 + 4 * n], np.uint32, n)).tolist()
    body = data[4 + 4 * n:]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def pack_ids(values: list[bytes]) -> bytes:
    """Ids of words as their numbers and, where all fit, two bytes an id."""
    sizes = np.fromiter((len(v) // 4 for v in values), np.uint32, len(values))
    ids = np.frombuffer(b"".join(values), "<u4")
    narrow = len(ids) == 0 or ids.max() < 1 << 16
    counts = sizes.astype(np.uint8) if len(sizes) == 0 or sizes.max() < 256 else sizes
    head = np.array([len(values), narrow, counts.itemsize], np.uint32).tobytes()
    return zlib.compress(head + counts.tobytes() + (ids.astype("<u2") if narrow else ids).tobytes(), 6)


def unpack_ids(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n, narrow, width = np.frombuffer(data[:12], np.uint32).tolist()
    counts = np.frombuffer(data[12:12 + width * n], np.uint8 if width == 1 else np.uint32)
    body = np.frombuffer(data[12 + width * n:], "<u2" if narrow else "<u4").astype("<u4").tobytes()
    ends = (4 * np.cumsum(counts, dtype=np.int64)).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def requests(words, parts: int) -> dict[int, list[bytes]]:
    """Distinct words by part of the word table, each list in byte order."""
    dealt: dict[int, list[bytes]] = {}
    for w in sorted(x.encode() for x in words):
        dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
    return dealt


def _ask(spec: str, parts: int):
    def rows(stream):
        words = _vocabulary(spec).words
        shards: dict[int, set] = {}
        for batch in stream:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text")):
                shards.setdefault(shard, set()).update(words(text.as_py() or ""))
        for shard, found in shards.items():
            for part, asked in requests(found, parts).items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([pack(asked)], pa.binary())], ["part", "shard", "words"])
        shards.clear()
        T.release()
    return rows


def _answer(spec: str, step: int = 1 << 14):
    """The word table of a part: each distinct word is encoded once, then every shard gets the ids of its words."""
    def rows(stream):
        encode = _vocabulary(spec).encode
        table: dict[bytes, bytes] = {}
        for batch in stream:
            for part, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "words"))):
                asked = unpack(blob)
                new = [w for w in asked if w not in table]
                for a in range(0, len(new), step):
                    some = new[a:a + step]
                    table.update(zip(some, (np.array(i, np.uint32).tobytes() for i in encode([w.decode() for w in some]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([pack_ids([table[w] for w in asked])], pa.binary())],
                    ["shard", "part", "ids"])
        table.clear()
        T.release()
    return rows


class Digest:
    """Counts and digests of a document's ids and of the text decoded from them."""

    columns = (["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])
    schema = "n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"

    def __call__(self, ids: bytes, vocabulary: Vocabulary):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode_ids(np.frombuffer(ids, "<u4"), vocabulary.pieces).encode()).hexdigest()


class Ids:
    """The ids themselves."""

    columns = (["ids"], [pa.list_(pa.int32())])
    schema = "ids ARRAY<INT>"

    def __call__(self, ids: bytes, vocabulary: Vocabulary):
        return (np.frombuffer(ids, "<u4").astype(np.int32),)


def decode_ids(ids: np.ndarray, pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _join(spec: str, parts: int, emit):
    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary = _vocabulary(spec)
        words = vocabulary.words
        number: dict[str, int] = {}
        texts = [np.array([number.setdefault(w, len(number)) for w in words(text.as_py() or "")], np.int32) for text in left["text"]]
        ids: list = [b""] * len(number)
        answers = dict(zip(right["part"].to_pylist(), right["ids"].to_pylist()))
        for part, asked in requests(number, parts).items():
            for w, i in zip(asked, unpack_ids(answers[part]), strict=True):
                ids[number[w.decode()]] = i
        number.clear()
        out = [emit(b"".join(map(ids.__getitem__, t.tolist())), vocabulary) for t in texts]
        left = left.drop_columns(["shard"])
        for k, (name, kind) in enumerate(zip(*emit.columns)):
            left = left.append_column(name, pa.array([row[k] for row in out], kind))
        del texts, ids, answers, out
        T.release()
        return left
    return shard


def encode(docs: DataFrame, vocabulary: Vocabulary, emit=None, columns=None) -> DataFrame:
    """``columns`` of ``docs`` (all by default, text last) with ``ids`` or what ``emit`` adds instead.

    A null text is empty and has no ids. A column named like an added one is replaced; other extra columns pass through.
    """
    emit = emit or Ids()
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = spread(spark, volume, SHARD_BYTES)
    base = docs.select(*columns) if columns else docs.drop("text")
    key = F.pmod(F.xxhash64(*[F.col(c) for c in ["text", "doc_id"] if c in docs.columns]), F.lit(shards)).cast("int")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in base.columns if c not in emit.columns[0]]).alias("row"), F.col("text").cast("string"), key.alias("shard"))
    dealt = rows.repartition(shards, "shard")
    asked = dealt.mapInArrow(_ask(vocabulary.spec, shards), ASKED)
    answers = asked.repartition(shards, "part").mapInArrow(_answer(vocabulary.spec), ANSWERED)
    joined = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_join(vocabulary.spec, shards, emit), schema_with(rows.drop("shard"), emit.schema))
    return joined.select("row.*", *([] if columns else ["text"]), *emit.columns[0])


def _decoder(spec: str):
    def rows(stream):
        pieces = _vocabulary(spec).pieces
        for batch in stream:
            texts = [decode_ids(np.array([i for i in ids if i is not None], np.int64), pieces) if ids is not None else "" for ids in batch.column("ids").to_pylist()]
            table = pa.Table.from_batches([batch])
            if "text" in table.column_names:
                table = table.drop_columns(["text"])
            yield from table.append_column("text", pa.array(texts, pa.string())).to_batches()
    return rows


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``text`` made of the pieces of ``ids``; null ids give an empty text, null entries are left out."""
    return encoded.mapInArrow(_decoder(vocabulary.spec), schema_with(encoded.drop("text"), "text STRING"))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document."""
    return encode(docs, vocabulary, Digest(), ["doc_id"])
