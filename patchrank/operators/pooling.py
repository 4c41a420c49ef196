"""Pooling of instance vectors into bag vectors, with given weights (forward pass only)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..session import pin
from .scale import attach, hashed_positions

BAG = ["bag_id"]


def mean_pool(df: DataFrame, vector: str, keys: Sequence[str] = BAG) -> DataFrame:
    """(keys, dim, value, attention): element-wise mean, uniform attention 1/n."""
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"),
                                          (F.lit(1.0) / F.count(F.lit(1))).alias("attention"))


def max_pool(df: DataFrame, vector: str) -> DataFrame:
    """(bag_id, dim, value, winner): element-wise maximum and the instance that holds it."""
    long = df.select("bag_id", "pos", F.posexplode(vector).alias("dim", "x"))
    return long.groupBy("bag_id", "dim").agg(
        F.max("x").cast("double").alias("value"),
        F.max_by("pos", F.struct(F.col("x"), -F.col("pos"))).alias("winner"))


def max_pool_credit(pooled: DataFrame) -> DataFrame:
    """The instance that wins most dimensions, the first on ties (``dim`` rows per bag)."""
    n = pooled.groupBy("bag_id", "winner").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("bag_id").agg(F.max_by("winner", F.struct(F.col("n"), -F.col("winner"))).alias("winner"),
                                   F.max("n").alias("n_dims"))


def matrix_udf(weights: np.ndarray, head: np.ndarray | None = None, gate: np.ndarray | None = None):
    """Arrow batches through ``x -> (tanh(x V') [* sigmoid(x U')]) w'`` or ``x -> x V'``."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        block = np.asarray(x.tolist(), dtype=np.float64)
        if block.size == 0:
            return pd.Series([], dtype=object)
        out = block @ weights.T
        if head is not None:
            out = np.tanh(out)
            if gate is not None:
                out = out / (1.0 + np.exp(-(block @ gate.T)))
            k, hidden = head.shape
            out = np.einsum("nkh,kh->nk", out.reshape(len(block), k, hidden), head)
        return pd.Series(list(out))
    return apply


def attention_logits(df: DataFrame, vector: str, weights: np.ndarray, head: np.ndarray,
                     gate: np.ndarray | None = None) -> DataFrame:
    """One row per (instance, head) with the attention logit.

    ``weights`` is (heads * hidden, dim), ``head`` (heads, hidden); ``gate`` like ``weights``.
    """
    udf = matrix_udf(weights, head, gate)
    return df.withColumn("_l", udf(vector)).select("*", F.posexplode("_l").alias("head", "logit")).drop("_l")


def softmax(df: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """Normalise over the instances of each key: column ``attention``."""
    keys = list(keys)
    top = df.groupBy(*keys).agg(F.max(logit).alias("_top"))
    rows = attach(df, top, keys).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    total = rows.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    return attach(rows, total, keys).withColumn("attention", F.col("_e") / F.col("_z")).drop("_top", "_e", "_z")


def pooled_attention(df: DataFrame, vector: str, keys: Sequence[str], weights: np.ndarray, head: np.ndarray,
                     gate: np.ndarray | None = None) -> DataFrame:
    """(keys, head, dim, value): softmax attention over the instances of a key, and the weighted sum of their vectors.

    Every task reduces its own rows to one partial sum per key and head, taken against the largest logit it has seen; partial
    sums are rescaled and added. The vectors themselves cross no exchange, and a hot key leaves one row per batch.
    """
    keys = list(keys)
    heads = head.shape[0]

    def partial(batches):
        for batch in batches:
            batch = batch[batch[vector].map(lambda x: x is not None and len(x) > 0)]
            if not len(batch):
                continue
            x = np.asarray(batch[vector].tolist(), dtype=np.float64)
            out = np.tanh(x @ weights.T)
            if gate is not None:
                out = out / (1.0 + np.exp(-(x @ gate.T)))
            logit = np.einsum("nkh,kh->nk", out.reshape(len(x), heads, head.shape[1]), head)
            for _, at in batch.groupby(keys, dropna=False, sort=False).indices.items():
                top = logit[at].max(axis=0)
                e = np.exp(logit[at] - top)
                yield pd.DataFrame({**{k: [batch[k].iloc[at[0]]] * heads for k in keys}, "head": np.arange(heads, dtype=np.int32), "_top": top,
                                    "_z": e.sum(axis=0), "_sum": list(e.T @ x[at])})

    schema = T.StructType([*df.select(*keys).schema.fields, *T.StructType.fromDDL("head INT, _top DOUBLE, _z DOUBLE, _sum ARRAY<DOUBLE>").fields])
    parts = pin(df.select(*keys, vector).mapInPandas(partial, schema))
    tops = parts.groupBy(*keys, "head").agg(F.max("_top").alias("_m"))
    scaled = attach(parts, tops, [*keys, "head"], "_top").withColumn("_f", F.exp(F.col("_top") - F.col("_m")))
    long = scaled.select(*keys, "head", "_f", "_z", F.posexplode("_sum").alias("dim", "x"))
    return long.groupBy(*keys, "head", "dim").agg((F.sum(F.col("x") * F.col("_f")) / F.sum(F.col("_z") * F.col("_f"))).alias("value"))


def attention_pool(rows: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    """(keys, dim, value): attention-weighted sum of the vectors."""
    long = rows.select(*keys, "attention", F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(F.sum(F.col("attention") * F.col("x").cast("double")).alias("value"))


def critical_instances(df: DataFrame, vector: str, classes: np.ndarray, query: np.ndarray) -> DataFrame:
    """Query-distance attention: per class the top instance, then softmax of query products.

    Returns one row per (instance, class) with ``logit``, ``critical`` and ``attention``.
    """
    hidden = query.shape[0]
    inst = matrix_udf(classes)
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        block = np.asarray(x.tolist(), dtype=np.float64)
        return pd.Series(list(np.tanh(block @ query.T))) if block.size else pd.Series([], dtype=object)
    rows = (df.withColumn("_s", inst(vector)).withColumn("_q", project(vector)).drop(vector)
            .select("*", F.posexplode("_s").alias("cls", "logit")).drop("_s"))
    crit = rows.groupBy("bag_id", "cls").agg(
        F.max_by(F.struct("pos", F.col("_q").alias("q")), F.struct(F.col("logit"), -F.col("pos"))).alias("c"))
    joined = attach(rows, crit, ["bag_id", "cls"])
    dot = F.aggregate(F.zip_with("_q", F.col("c.q"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    out = joined.withColumn("_d", dot / F.lit(float(np.sqrt(hidden)))).withColumn("critical", F.col("c.pos"))
    return softmax(out, ["bag_id", "cls"], "_d").drop("_q", "c", "_d")


def class_max(df: DataFrame, vector: str, classes: np.ndarray) -> DataFrame:
    """Highest instance logit per (bag, class)."""
    rows = df.select("bag_id", F.posexplode(matrix_udf(classes)(vector)).alias("cls", "logit"))
    return rows.groupBy("bag_id", "cls").agg(F.max("logit").alias("logit"))


def slot_columns(df: DataFrame, key: str, slot: str, vector: str, k: int) -> DataFrame:
    """Slot vectors of a bag as ``k`` array columns ``v0..``; absent slots are NULL."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(slot) == i, F.col(vector))).alias(f"v{i}") for i in range(k)])


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def vector_cosines(wide: DataFrame, k: int) -> list[Column]:
    """Pairwise cosines of the slot columns, row-local; the number of slots is fixed by schema."""
    norm = [F.greatest(F.sqrt(dot(f"v{i}", f"v{i}")), F.lit(1e-8)) for i in range(k)]
    return [dot(f"v{i}", f"v{j}") / (norm[i] * norm[j]) for i in range(k) for j in range(i + 1, k)]


def gated_readout(wide: DataFrame, k: int, gate: Sequence[float], key: str = "bag_id") -> DataFrame:
    """Softmax over slots of a linear gate; weighted sum of the slot vectors and the weights."""
    w = F.array(*[F.lit(float(g)) for g in gate])
    logits = [F.coalesce(dot(f"v{i}", w), F.lit(float("-inf"))) for i in range(k)]
    rows = wide.withColumn("_l", F.array(*logits))
    top = F.array_max("_l")
    rows = rows.withColumn("_e", F.transform("_l", lambda x: F.exp(x - top)))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("weights", F.transform("_e", lambda x: x / total))
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("weights")[i].alias("weight"), F.col(f"v{i}").alias("v"))
                     for i in range(k)])
    long = rows.select(key, F.explode(each).alias("s")).where(F.col("s.v").isNotNull())
    dims = long.select(key, "s.slot", "s.weight", F.posexplode("s.v").alias("dim", "x"))
    return dims.groupBy(key, "dim").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("value"),
                                        F.max_by("slot", F.struct(F.col("weight"), -F.col("slot"))).alias("top_slot"))


def max_readout(wide: DataFrame, k: int, key: str = "bag_id") -> DataFrame:
    """Element-wise maximum over slots and the slot that holds it."""
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"v{i}").alias("v")) for i in range(k)])
    long = wide.select(key, F.explode(each).alias("s")).where(F.col("s.v").isNotNull())
    dims = long.select(key, "s.slot", F.posexplode("s.v").alias("dim", "x"))
    return dims.groupBy(key, "dim").agg(F.max("x").cast("double").alias("value"),
                                        F.max_by("slot", F.struct(F.col("x"), -F.col("slot"))).alias("slot"))


def extremes(df: DataFrame, score: str, k: int) -> DataFrame:
    """Top and bottom ``least(k, n DIV 2)`` instances per bag with pseudo-labels 1 and 0.

    Both ranks are compared with the constant ``k``, so each task keeps ``k`` rows per bag before
    the shuffle.
    """
    sizes = df.groupBy("bag_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for label, first in ((1, F.col(score).desc()), (0, F.col(score).asc())):
        w = W.partitionBy("bag_id").orderBy(first, "pos")
        parts.append(df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                     .withColumn("pseudo", F.lit(label)))
    return (parts[0].unionByName(parts[1]).join(sizes, "bag_id")
            .where(F.col("rank") <= F.floor(F.col("_n") / 2)).drop("_n"))


def probe_fit_set(df: DataFrame, per_positive: int, seed: int) -> DataFrame:
    """All positives and ``per_positive`` negatives per positive of each bag, drawn by hash order.

    Bags without a positive give nothing. Negatives are numbered by bucketed positions, so a bag
    of any size is numbered in parallel.
    """
    n_pos = df.groupBy("bag_id").agg(F.sum((F.col("target") > 0).cast("bigint")).alias("_p")).where("_p > 0")
    neg = df.where(F.col("target") == 0).withColumn("_h", draws.order_key(seed, F.col("bag_id"), F.col("pos")))
    neg = hashed_positions(neg, ["bag_id"], "_h", ["pos"], name="_ix")
    kept = attach(neg, n_pos, ["bag_id"]).where(F.col("_ix") < F.col("_p") * per_positive)
    return df.where(F.col("target") > 0).unionByName(kept.drop("_h", "_ix", "_p"))


def fit_probe(fit: DataFrame, vector: str, max_iter: int = 200):
    """Balanced logistic regression (L2, C = 1) on the fit set with Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    fit = pin(fit)  # the optimiser passes over it many times
    counts = fit.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("target") > 0).cast("bigint")).alias("p"))
    n, p = counts.select("n").scalar(), counts.select("p").scalar()
    rows = fit.withColumn("_n", n).withColumn("_p", p)
    weight = F.when(F.col("target") > 0, F.col("_n") / (2.0 * F.col("_p"))).otherwise(
        F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    rows = rows.select(array_to_vector(vector).alias("features"), (F.col("target") > 0).cast("double").alias("label"),
                       weight.alias("weight"))
    size = fit.count()
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / max(size, 1), elasticNetParam=0.0,
                              standardization=False, weightCol="weight").fit(rows)


def probe_scores(model, df: DataFrame, vector: str) -> DataFrame:
    """Log-odds of every instance; no saturation, so no manufactured ties."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = model.transform(df.withColumn("features", array_to_vector(vector)))
    return out.withColumn("score", vector_to_array("rawPrediction")[1].cast("float").cast("double")).drop(
        "features", "rawPrediction", "probability", "prediction")
