"""Small statistical expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)
