"""Queries whose results SQL can't state: images, encodings and files. Tests hold them against decoders and originals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.engine import Engine
from gridlake.functions import twkb
from gridlake.operators import resample, style
from gridlake.plans.registry import query
from gridlake.plans.table_queries import _zone_polygons
from gridlake.raster import orders_raster


def _tiles(raster):
    """The tiles of zoom 9 over the whole raster."""
    west, width, _, north, _, height = raster.gt
    ends = raster.cells.agg(F.min("row").alias("top"), (F.max("row") + 1).alias("bottom"), F.min("col").alias("left"), (F.max("col") + 1).alias("right"))
    side = lambda start, step, end: F.lit(start) + F.col(end) * step
    extent = ends.select(side(west, width, "left").alias("west"), side(west, width, "right").alias("east"), side(north, height, "top").alias("north"), side(north, height, "bottom").alias("south"))
    return resample.tiles_in_extent(extent, 9).select("z", "x", "y")


@query()
def png_tiles(spark, sf):
    raster = orders_raster(spark, sf)
    return Engine(spark).render(_tiles(raster), raster, style.Style(min=1000.0, max=500000.0), 64)


@query()
def png_hillshade(spark, sf):
    raster = orders_raster(spark, sf)
    return Engine(spark).render(_tiles(raster), raster, style.Style(mode="hillshade"), 64, "bilinear")


@query("SELECT zone_id, 1 AS polygons, x0 AS west, y1 AS north FROM z_nat")
def twkb_roundtrip(spark, sf):
    decoded = _zone_polygons(spark, sf).select("zone_id", twkb.twkb_decode(twkb.twkb_encode("polygons")).alias("g"))
    ring = F.get(F.get("g", 0), 0)
    return decoded.select("zone_id", F.size("g").alias("polygons"), F.array_min(F.transform(ring, lambda p: p["x"])).alias("west"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("north"))
