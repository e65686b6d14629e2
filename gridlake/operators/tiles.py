"""From tiles to images, in long form: pixels are styled as rows and put together per tile in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import png
from gridlake.operators import coverage, mosaic, resample, style
from gridlake.raster import Raster


def clip(pixels: DataFrame, tiles: DataFrame, zones: DataFrame | None, size: int) -> DataFrame:
    """pixels without those whose centre lies outside the zones (zone_id, polygons in degrees), by an equi-join with the zones' filled pixels."""
    if zones is None:
        return pixels
    inside = coverage.cells_of(mosaic.tile_masks(tiles, zones, size)).select("z", "x", "y", F.col("row").alias("py"), F.col("col").alias("px")).distinct()
    return pixels.join(inside, ["z", "x", "y", "px", "py"], "left_semi")


def rgba(values: DataFrame, wanted: style.Style) -> DataFrame:
    """values with r, g, b, a under a style of one band."""
    colour: dict[str, object] = {"colormap": style.colormap, "contour": style.contour, "classified": style.classified}
    made: Column = colour[wanted.mode](F.col("value"), wanted)  # type: ignore[operator]
    return values.withColumn("_c", made).select("*", "_c.r", "_c.g", "_c.b", "_c.a").drop("_c")


def assemble(coloured: DataFrame, size: int, as_png: bool = True) -> DataFrame:
    """(z, x, y, image) of pixels (z, x, y, px, py, r, g, b, a); those that are not there are transparent."""

    def one(table: pa.Table) -> pa.Table:
        pixels = np.zeros((size, size, 4), np.uint8)
        px, py = table.column("px").to_numpy(), table.column("py").to_numpy()
        for k, c in enumerate("rgba"):
            pixels[py, px, k] = table.column(c).to_numpy()
        data = png.encode(pixels) if as_png else pixels.tobytes()
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()], pa.int32()) for k in "zxy"}, "image": pa.array([data], pa.binary())})

    return coloured.select("z", "x", "y", "px", "py", *"rgba").groupBy("z", "x", "y").applyInArrow(one, "z int, x int, y int, image binary")


def render(tiles: DataFrame, raster: Raster, wanted: style.Style, size: int = 256, interpolation: str = "nearest", zones: DataFrame | None = None, as_png: bool = True) -> DataFrame:
    """(z, x, y, image) of tiles (z, x, y), pixel by pixel: what operators.mosaic must equal. zones: polygons in degrees."""
    places = clip(resample.pixel_places(resample.tile_pixels(tiles, size), raster, size), tiles, zones, size)
    if wanted.mode == "rgb":
        by_band = raster.cells.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == min(k, raster.bands - 1), F.col("value"))).alias(f"v{k}") for k in range(3)))
        placed = places.withColumn("row", F.floor("frow").cast("int")).withColumn("col", F.floor("fcol").cast("int")).join(by_band, ["row", "col"])
        coloured = placed.withColumn("_c", style.rgb([F.col(f"v{k}") for k in range(3)], wanted)).select("*", "_c.r", "_c.g", "_c.b", "_c.a")
        return assemble(coloured, size, as_png)
    cells = raster.band(0)
    values = resample.bilinear(places, cells, F.lit(wanted.nodata).cast("double")) if interpolation == "bilinear" else resample.nearest(places, cells)
    if wanted.mode == "hillshade":
        grid = values.select("z", "x", "y", "px", "py", F.col("py").alias("row"), F.col("px").alias("col"), "value")
        shaded = style.hillshade(grid, wanted, style.cell_metres(raster.gt, raster.epsg), ("z", "x", "y"))
        coloured = shaded.withColumn("_c", style.shade_rgba(F.col("shade"), F.col("value"), wanted)).select("*", "_c.r", "_c.g", "_c.b", "_c.a")
        return assemble(coloured, size, as_png)
    return assemble(rgba(values, wanted), size, as_png)
