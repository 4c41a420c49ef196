"""Explicit schemas of the library's tables; nothing is inferred."""
from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


INTERVAL = _s(mean=T.DoubleType(), lo=T.DoubleType(), hi=T.DoubleType(), n=T.LongType(), n_clusters=T.LongType())
FEATURES = _s(bag_id=T.StringType(), slice=T.IntegerType(), patch=T.IntegerType(), embedding=T.ArrayType(T.FloatType()))
BAGS = _s(bag_id=T.StringType(), patient_id=T.StringType(), label=T.IntegerType(), has_mask=T.BooleanType(),
          n_slices=T.IntegerType(), grid_h=T.IntegerType(), grid_w=T.IntegerType(), attrs=T.MapType(T.StringType(), T.StringType()))
SCORES = _s(tag=T.StringType(), split=T.StringType(), bag_ix=T.IntegerType(), bag_id=T.StringType(), pos=T.IntegerType(),
            slot=T.IntegerType(), score=T.FloatType())
INSTANCES = _s(bag_id=T.StringType(), pos=T.LongType(), slice=T.LongType(), patch=T.LongType(), n_slices=T.LongType(),
               target=T.IntegerType(), coverage=T.DoubleType())
REGION = _s(bag_id=T.StringType(), pos=T.LongType(), frac=T.FloatType())
AXES = _s(tag=T.StringType(), scorer=T.StringType(), bag_id=T.StringType(), patient_id=T.StringType(), flat=T.DoubleType(),
          slice=T.DoubleType(), within_slice=T.DoubleType(), n_slices=T.IntegerType(), n_lesion_slices=T.IntegerType())
STAMP = _s(prereg_hash=T.StringType(), git_commit=T.StringType(), git_dirty=T.BooleanType())
SCORER = _s(scorer=T.StringType(), flat_auc=INTERVAL, slice_auc=INTERVAL, within_slice_auc=INTERVAL)
RESULT = _s(tag=T.StringType(), scorers=T.ArrayType(SCORER))
ARTEFACT = _s(prereg=STAMP, analysis_role=T.StringType(), results=T.ArrayType(RESULT))
AMENDMENTS = _s(seq=T.LongType(), date=T.StringType(), title=T.StringType(), kind=T.StringType(), before=T.StringType(), after=T.StringType())
