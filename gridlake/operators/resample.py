"""Tiles: output pixels join source cells on equality, never by range; and overviews as group-bys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import crs, nodata, tilemath
from gridlake.raster import Raster


def tile_pixels(tiles: DataFrame, size: int) -> DataFrame:
    """Every pixel (px, py) of tiles (z, x, y)."""
    rows = tiles.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("py"))
    return rows.select("z", "x", "y", "py", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px"))


def pixel_places(pixels: DataFrame, raster: Raster, size: int) -> DataFrame:
    """pixels with their fractional place (fcol, frow) in the raster, taken at their centres."""
    n = F.pow(F.lit(2.0), "z")
    lon = (F.col("x") + (F.col("px") + 0.5) / size) / n * 360 - 180
    lat = F.degrees(F.atan(F.sinh(tilemath.PI * (1 - 2 * (F.col("y") + (F.col("py") + 0.5) / size) / n))))
    col, row = tilemath.affine_inverse(raster.gt, *crs.project(lon, lat, raster.epsg))
    return pixels.withColumn("fcol", col).withColumn("frow", row)


def nearest(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """pixels with value; null where there is no cell."""
    placed = pixels.withColumn("row", F.floor("frow").cast("int")).withColumn("col", F.floor("fcol").cast("int"))
    return placed.join(cells.select("row", "col", "value"), ["row", "col"], "left")


def bilinear(pixels: DataFrame, cells: DataFrame, nodata_value: Column | None = None) -> DataFrame:
    """pixels with value from four cells; a missing neighbour gives the top left one, or null if that is missing.

    Each cell first gathers its right, lower and diagonal neighbour (two windows), then one equi-join serves all four."""
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    v = F.when(~nodata.relative(F.col("value"), nodata_value if nodata_value is not None else F.lit(None).cast("double")), F.col("value").cast("double"))
    base = cells.select("row", "col", v.alias("v00"))
    right = base.withColumn("v01", F.when(F.lead("col").over(along) == F.col("col") + 1, F.lead("v00").over(along)))
    low = F.lead("row").over(down) == F.col("row") + 1
    four = right.withColumn("v10", F.when(low, F.lead("v00").over(down))).withColumn("v11", F.when(low, F.lead("v01").over(down)))
    placed = pixels.withColumn("row", F.floor("frow").cast("int")).withColumn("col", F.floor("fcol").cast("int"))
    fx, fy = F.col("fcol") - F.col("col"), F.col("frow") - F.col("row")
    top = F.col("v00") + (F.col("v01") - F.col("v00")) * fx
    bottom = F.col("v10") + (F.col("v11") - F.col("v10")) * fx
    return placed.join(four, ["row", "col"], "left").withColumn("value", F.coalesce(top + (bottom - top) * fy, F.col("v00"))).drop("v00", "v01", "v10", "v11")


def overview(cells: DataFrame, factor: int, how: str = "avg") -> DataFrame:
    """A coarser level: the top left cell of each block ("nearest") or the mean of its data."""
    coarse = [F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    if how == "nearest":
        kept = cells.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))
        return kept.select(*coarse, "value")
    return cells.groupBy(*coarse).agg(F.avg(F.col("value").cast("double")).alias("value"))


def tiles_in_extent(extents: DataFrame, zoom: Column | int) -> DataFrame:
    """(z, x, y) of the tiles that overlap extents (west, south, east, north) by more than 1e-9 degrees."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    a, b = tilemath.tile_of(F.col("west"), F.col("north"), z), tilemath.tile_of(F.col("east"), F.col("south"), z)
    rows = extents.withColumn("z", z).withColumn("x", F.explode(F.sequence(a["x"], b["x"])))
    rows = rows.withColumn("y", F.explode(F.sequence(a["y"], b["y"])))
    box = tilemath.tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    wide = F.least(box["east"], F.col("east")) - F.greatest(box["west"], F.col("west")) > 1e-9
    high = F.least(box["north"], F.col("north")) - F.greatest(box["south"], F.col("south")) > 1e-9
    return rows.where(wide & high)


def deepest_tile(extents: DataFrame, max_zoom: int = 22) -> DataFrame:
    """extents with the z, x, y of the deepest tile that holds them whole, starting from the zoom at which they fill one."""
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    start = F.least(F.lit(max_zoom), tilemath.zoom_for_span(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))))
    place = F.transform(F.sequence(F.lit(0), start), lambda z: F.struct(z.alias("z"), *(c.alias(k) for k, c in tilemath.tile_of(lon, lat, z).items())))

    def holds(t: Column) -> Column:
        box = tilemath.tile_bbox(t["z"], t["x"], t["y"])
        return (box["west"] <= F.col("west")) & (F.col("east") <= box["east"]) & (box["south"] <= F.col("south")) & (F.col("north") <= box["north"]) | (t["z"] == 0)

    best = F.array_max(F.filter(place, holds))
    return extents.withColumn("_t", best).withColumns({k: F.col("_t")[k] for k in "zxy"}).drop("_t")
