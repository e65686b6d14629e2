"""The three rules for missing values, each for its own operators; the outcome is a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLE_TOLERANCE = 1.1920929e-05


def exact(v: Column, nodata: Column) -> Column:
    """Queries: NaN, or equal."""
    return F.coalesce(F.isnan(v), F.lit(False)) | F.coalesce(v == nodata, F.lit(False)) | v.isNull()


def relative(v: Column, nodata: Column) -> Column:
    """Bilinear resampling: within 1e-5 of the value, relative and absolute."""
    return exact(v, nodata) | F.coalesce(F.abs(v - nodata) <= F.abs(nodata) * 1e-5 + 1e-5, F.lit(False))


def absolute(v: Column, nodata: Column) -> Column:
    """Styles: within 100 float steps of 1, or not finite."""
    near = F.coalesce(F.abs(v - nodata) < STYLE_TOLERANCE, F.lit(False))
    return exact(v, nodata) | near | F.coalesce(F.abs(v) == float("inf"), F.lit(False))


def effective(override: float | None, own: Column) -> Column:
    """A request's nodata wins over the raster's."""
    return F.coalesce(F.lit(override).cast("float"), own.cast("float"))
