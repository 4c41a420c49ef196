"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its frequent byte n-grams. The filters are stored bit-sliced: a position holds a mask with one bit a
language, so the AND of the masks at an n-gram's positions names all languages that contain it. A text's masks are counted per
language, the count is corrected for the filter's rate of false positives, and the largest share decides.

The filters are learned from at most ``sample`` distinct rows (doc_id, text) of each language, drawn by a hash of both.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import schema_with
from patchrank.llm.quality import held_out

SAMPLE, GRAM, BITS, HASHES, CAPACITY = 1000, 4, 18, 3, 20_000
MOST_LANGUAGES = 1024

LETTERS = T.LOWER.copy()  # letters lower-cased, everything else in ASCII a space
LETTERS[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20


def grams(column, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(key of each n-gram, number before each text); n-grams that start with two spaces are left out."""
    data, offsets = T.utf8(column)
    data = LETTERS[data].astype(np.uint32)
    capital = np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]) if len(data) else np.zeros(0, bool)
    data = data + np.where(capital, np.uint32(0x20), np.uint32(0))
    key = np.zeros(max(len(data) - n + 1, 0), np.uint32)
    for k in range(n):
        key = (key << np.uint32(8)) | data[k:len(data) - n + 1 + k]
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    at = np.arange(count.sum()) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    key = key[at]
    good = (key >> np.uint32(8 * n - 16)) != 0x2020
    before = np.concatenate([[0], np.cumsum(good)])
    return key[good], before[np.concatenate([[0], np.cumsum(count)])]


def positions(keys: np.ndarray, bits: int = BITS, hashes: int = HASHES) -> list[np.ndarray]:
    mixed = T.mix(keys.astype(np.uint64) + np.uint64(1))
    return [(mixed >> np.uint64(64 - bits * (k + 1))) & np.uint64((1 << bits) - 1) for k in range(hashes)]


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    masks: np.ndarray    # (positions, words of up to 64 languages); narrow integers while they suffice
    false: np.ndarray    # rate of false positives per language

    def shares(self, column) -> np.ndarray:
        """Corrected share of each text's n-grams that each language contains."""
        keys, first = grams(column)
        n = np.maximum(np.diff(first), 1)
        out = np.zeros((len(n), len(self.languages)))
        at = positions(keys)
        for w in range(self.masks.shape[1]):
            column_masks = np.ascontiguousarray(self.masks[:, w])
            found = column_masks[at[0]]
            for p in at[1:]:
                found &= column_masks[p]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = ((found >> found.dtype.type(k - 64 * w)) & found.dtype.type(1)).astype(bool)
                hits = np.diff(np.concatenate([[0], np.cumsum(bit)])[first])
                out[:, k] = (hits - n * self.false[k]) / (1 - self.false[k]) / n
        return np.clip(out, 0, 1)


def _filter_of(bits: int, capacity: int):
    """The Bloom filter of one language: its n-grams that most sampled texts hold, and at least two."""
    def build(group: pa.Table) -> pa.Table:
        keys, first = grams(group["text"])
        each = [np.unique(keys[a:b]) for a, b in zip(first[:-1], first[1:])]
        found, count = np.unique(np.concatenate(each), return_counts=True)
        order = np.lexsort((found, -count))[:capacity]
        kept = found[order][count[order] >= min(2, len(each))]
        plane = np.zeros(1 << bits, bool)
        for p in positions(kept, bits):
            plane[p] = True
        return pa.table({"lang": group["lang"].slice(0, 1), "plane": pa.array([np.packbits(plane).tobytes()], pa.binary())})
    return build


def draw(known: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """lang and text of the ``sample`` rows of each language with the smallest ``draw``, or of all; ``sizes`` counts distinct draws.

    A share with five deviations to spare is taken first, so that only few rows are ordered.
    """
    share = {k: min(1.0, (sample + 5 * sample ** 0.5 + 25) / n) for k, n in sizes.items()}
    share = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    near = known.where(F.pmod("draw", F.lit(1 << 40)) < share * float(1 << 40)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw"))
    return near.withColumn("place", place).where(F.col("place") <= sample).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, capacity: int = CAPACITY) -> Filters:
    """Learn from documents with a language that are not held out. At most MOST_LANGUAGES languages are supported.

    Rows are told apart by doc_id and text together, so rows without a doc_id, or with a common one, are drawn like any others.
    """
    known = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
             .select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
             .select("lang", "text", F.xxhash64("doc_id", "text").alias("draw")))
    sizes = {r["lang"]: r["n"] for r in known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Filters([], np.zeros((1 << bits, 1), np.uint8), np.zeros(0))
    drawn = draw(known, sizes, sample)
    planes = drawn.groupBy("lang").applyInArrow(_filter_of(bits, capacity), "lang STRING, plane BINARY").toArrow()
    planes = dict(zip(planes["lang"].to_pylist(), planes["plane"].to_pylist()))
    languages = sorted(planes)
    words = -(-len(languages) // 64)
    kind = np.uint64 if len(languages) > 32 else np.uint32 if len(languages) > 16 else np.uint16 if len(languages) > 8 else np.uint8
    masks, false = np.zeros((1 << bits, words), kind), np.zeros(len(languages))
    for k, name in enumerate(languages):
        plane = np.unpackbits(np.frombuffer(planes[name], np.uint8))
        masks[:, k // 64] |= plane.astype(kind) << kind(k % 64)
        false[k] = min(0.99, plane.mean() ** HASHES)
    return Filters(languages, masks, false)


def _identifier(filters: Filters):
    def rows(stream):
        for batch in T.batches(stream, 1 << 20):
            lettered = [t is not None and any(map(str.isalpha, t)) for t in batch["text"].to_pylist()]
            if filters.languages:
                shares = filters.shares(batch["text"])
                best = shares.argmax(axis=1)
                top = shares[np.arange(len(best)), best]
                total = shares.sum(axis=1)
                score = np.where(total > 0, top / np.maximum(total, 1e-300), 1 / len(filters.languages))
                names = [filters.languages[b] if x else "und" for b, x in zip(best, lettered)]
            else:
                score, names = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            score = np.where(lettered, score, 0.0)
            yield from (batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(score, pa.float64()))).to_batches()
    return rows


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred and score (share of the best language among all).

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. Texts without a known n-gram
    get the first language and an even score. Columns with these names are replaced.
    """
    rows = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_identifier(filters), schema_with(rows, "lang_pred STRING, score DOUBLE"))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score per document."""
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
