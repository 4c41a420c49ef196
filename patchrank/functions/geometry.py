"""Expressions over the (slice, patch) position of an instance."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_of(pos: Column, n_patch: int) -> Column:
    return F.floor(pos / F.lit(n_patch)).cast("bigint")


def patch_of(pos: Column, n_patch: int) -> Column:
    return (pos % F.lit(n_patch)).cast("bigint")


def depth_bin(slice_ix: Column, n_slices: Column, n_bins: int) -> Column:
    """Bin over normalised depth; a bag without slices is an error."""
    if n_bins <= 0:
        raise ValueError(f"n_bins must be positive, got {n_bins}")
    raw = F.least(F.floor(slice_ix * F.lit(n_bins) / n_slices), F.lit(n_bins - 1))
    bad = F.raise_error(F.lit("n_slices must be positive")).cast("bigint")
    return F.when(n_slices <= 0, bad).otherwise(raw.cast("bigint"))


def spread(index: Column, count: Column) -> Column:
    """Evenly spaced value in [-1, 1]; -1 where there is a single point."""
    gap = F.lit(2.0) / F.greatest(count - 1, F.lit(1)).cast("double")
    return F.lit(-1.0) + index.cast("double") * gap


def centre_prior(slice_ix: Column, n_slices: Column, patch: Column, grid: int) -> Column:
    """Minus the distance from the volume centre, as FLOAT so that ties follow float32."""
    y = spread(F.floor(patch / F.lit(grid)), F.lit(grid))
    x = spread(patch % F.lit(grid), F.lit(grid))
    in_plane = F.sqrt(y * y + x * x)
    z = spread(slice_ix, n_slices)
    return (-F.sqrt(z * z + in_plane * in_plane)).cast("float")


def pixel_radius(patch: Column, grid: int) -> Column:
    """Distance of a patch from the grid centre, in patches."""
    mid = F.lit((grid - 1) / 2.0)
    y = F.floor(patch / F.lit(grid)).cast("double") - mid
    x = (patch % F.lit(grid)).cast("double") - mid
    return F.sqrt(y * y + x * x)


def depth_only(slice_ix: Column, n_slices: Column) -> Column:
    """Minus the normalised distance from the middle slice."""
    mid = (n_slices - 1).cast("double") / F.lit(2.0)
    return -(F.abs(slice_ix.cast("double") - mid) / F.greatest(mid, F.lit(1.0)))


def radius_only(patch: Column, grid: int) -> Column:
    """Minus the normalised in-plane radius."""
    return -(pixel_radius(patch, grid) / F.lit(max((grid - 1) / 2.0, 1.0)))
