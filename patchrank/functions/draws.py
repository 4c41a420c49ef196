"""Deterministic draws: the leading 32 bits of an MD5 over the draw's key.

A draw depends on its key alone, so a recomputed task or another engine gives the same number.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0  # 2 ** 32


def text_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def draw(*parts) -> Column:
    """BIGINT in [0, 2**32)."""
    return F.conv(F.substring(F.md5(text_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """DOUBLE in (0, 1): the draw's cell centre, so that a logarithm is finite."""
    return (draw(*parts).cast("double") + F.lit(0.5)) / F.lit(SPAN)


def normal(*parts) -> Column:
    """Standard normal by the Box-Muller transform of two draws."""
    u, v = uniform(*parts, "u"), uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def order_key(*parts) -> Column:
    """A shuffled order as sortable text."""
    return F.md5(text_key(*parts))


def half(identifier: Column) -> Column:
    """``fit`` or ``score`` by the parity of the identifier's SHA-256."""
    last = F.substring(F.sha2(identifier.cast("string"), 256), -1, 1)
    even = F.conv(last, 16, 10).cast("int") % 2 == 0
    return F.when(even, F.lit("fit")).otherwise(F.lit("score"))
