"""Point samples: points are projected to (row, col) and join cells on equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import crs, nodata, tilemath
from gridlake.raster import Raster


def located(points: DataFrame, raster: Raster) -> DataFrame:
    """points (lon, lat) with row and col."""
    x, y = crs.project(F.col("lon"), F.col("lat"), raster.epsg)
    col, row = tilemath.affine_inverse(raster.gt, x, y)
    return points.withColumn("row", F.floor(row).cast("int")).withColumn("col", F.floor(col).cast("int"))


def sample(points: DataFrame, raster: Raster, band: int = 0, nodata_value: float | None = None) -> DataFrame:
    """points with row, col, value and status: ok, outside or nodata. A request's nodata hides equal values."""
    cells = raster.band(band).select("row", "col", "value", F.lit(True).alias("_inside"))
    joined = located(points, raster).join(cells, ["row", "col"], "left")
    missing = nodata.exact(F.col("value"), F.lit(nodata_value).cast("float"))
    value = F.when(~missing, F.col("value"))
    state = F.when(F.col("_inside").isNull(), "outside").when(missing, "nodata").otherwise("ok")
    return joined.withColumn("status", state).withColumn("value", value).drop("_inside")
