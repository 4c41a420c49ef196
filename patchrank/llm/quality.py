"""Quality classifier: supervised subword embeddings.

Hashed words and byte n-grams have learned vectors; a document is the mean of its features' vectors, and a softmax over two classes
reads it. Vectors and output weights are learned by stochastic gradient descent in NumPy over a bounded sample of labelled rows
(``sample`` rows, whole texts, chosen by a hash of doc_id, alike at every input size). Since the mean and the output are linear, scoring
needs one number per bucket: the output weights are folded into the vectors, and a score is the mean of those numbers.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchrank.llm import text as T
from patchrank.llm.common import packed, schema_with, unpacked

SAMPLE = 4000
BITS = 17
GRAMS = (3, 4)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def features(column, bits: int = BITS, grams=GRAMS):
    """Yield (bucket of each feature, number of features before each text) for words, their repetition and each n-gram length.

    A word's repetition says whether it equals the first or the second word before it; n-grams of words cannot say so in general.
    """
    data, offsets = T.utf8(column)
    words = T.Words(data, offsets, T.BLANK)
    hashes = words.hashes()
    yield (hashes >> np.uint64(64 - bits)).astype(np.int32), words.first
    nth = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts())
    same = sum(((nth >= k) & (hashes == np.roll(hashes, k))) * np.uint64(k) for k in (1, 2))
    yield (T.mix(same.astype(np.uint64) + np.uint64(0x5EED)) >> np.uint64(64 - bits)).astype(np.int32), words.first
    wide = data.astype(np.uint32)
    for n in grams:
        key = np.zeros(max(len(wide) - n + 1, 0), np.uint32)
        for k in range(n):
            key = (key << np.uint32(8)) | wide[k:len(wide) - n + 1 + k]
        bucket = ((key * np.uint32(0x9E3779B1) ^ np.uint32(n)) >> np.uint32(32 - bits)).astype(np.int32)
        count = np.maximum(np.diff(offsets) - n + 1, 0)
        at = np.arange(count.sum()) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
        yield bucket[at], np.concatenate([[0], np.cumsum(count)])


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        """Probability of class 1 for each text; a text without features gets the prior."""
        total, n = 0.0, 0
        for bucket, first in features(column, int(np.log2(len(self.weight)))):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
            total, n = total + np.diff(sums[first]), n + np.diff(first)
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """SGD over (label, buckets, counts). Without both classes the model is the prior."""
    rng = np.random.default_rng(seed)
    positive = sum(y for y, _, _ in rows)
    prior = np.log((positive + 1) / (len(rows) - positive + 1))
    vectors = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.array([0, prior], np.float32)
    if 0 < positive < len(rows):
        step, steps = 0, epochs * len(rows)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                y, bucket, count = rows[i]
                lr = rate * (1 - step / steps)
                step += 1
                if not len(bucket):
                    continue
                share = (count / count.sum()).astype(np.float32)
                mean = share @ vectors[bucket]
                z = mean @ output + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                pull = output @ p
                output -= lr * np.outer(mean, p)
                bias -= lr * 0.1 * p
                vectors[bucket] -= (lr * 4) * share[:, None] * pull * 32
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def folded(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and their counts in about an eighth of the space: distances and counts are small, their leading bytes mostly zero."""
    values = np.concatenate([np.diff(buckets, prepend=0), counts]).astype(np.int32)
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T), 1)


def unfolded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and counts of ``folded``."""
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    half = len(values) // 2
    return np.cumsum(values[:half], dtype=np.int32), values[half:]


def _counted(bits):
    def rows(stream):
        for batch in T.batches(stream, 1 << 20):
            parts = list(features(batch["text"], bits))
            out = []
            for i in range(batch.num_rows):
                own = np.concatenate([bucket[first[i]:first[i + 1]] for bucket, first in parts])
                buckets, counts = np.unique(own, return_counts=True)
                out.append((len(buckets), folded(buckets, counts)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].combine_chunks(), batch["quality"].combine_chunks(), pa.array([n for n, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                ["doc_id", "quality", "n", "features"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, **options) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    chosen = known.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).distinct().orderBy(F.xxhash64("doc_id"), "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    found = texts.mapInArrow(_counted(bits), "doc_id BIGINT, quality INT, n INT, features BINARY").orderBy(F.xxhash64("doc_id"), "quality", F.xxhash64("features")).limit(sample).toArrow()
    at = np.concatenate([[0], np.cumsum(found["n"].to_numpy(), dtype=np.int64)])
    buckets, counts = np.empty((2, at[-1]), np.int32)  # one block, which goes back to the system as a whole
    rows = []
    for y, x, a, b in zip(found["quality"].to_pylist(), found["features"], at[:-1], at[1:]):
        buckets[a:b], counts[a:b] = unfolded(x.as_buffer())
        rows.append((y, buckets[a:b], counts[a:b]))
    return train(rows, bits, **options)


def _scorer(model: Model):
    def rows(stream):
        for batch in T.batches(stream, 1 << 20):
            yield from batch.append_column("score", pa.array(model.scores(batch["text"]), pa.float64())).to_batches()
    return rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 from the whole text alone; null and empty texts get the prior.

    A column named score is replaced; rows and all other columns stay.
    """
    rows = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_scorer(model), schema_with(rows, "score DOUBLE"))


def predictions(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted per document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return unpacked(score(packed(docs, "text"), fit(docs, labels)).where(F.col("score") >= least), docs.columns)
