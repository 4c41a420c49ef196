"""Scorer registry: a scorer maps instances to (scorer, bag_id, pos, score) rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def scorer(name: str):
    def add(fn):
        if name in SCORERS:
            raise ValueError(f"scorer {name} is registered already")
        SCORERS[name] = fn
        return fn
    return add


def score_all(instances: DataFrame, names) -> DataFrame:
    """Rows of several registered scorers; an unknown name is an error."""
    out = None
    for name in names:
        if name not in SCORERS:
            raise KeyError(f"unknown scorer {name}; known: {sorted(SCORERS)}")
        part = SCORERS[name](instances).withColumn("scorer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
