"""Tiles from blocks, a tile at a time in numpy: the vectorised twin of operators.tiles, which is the specification.

Tiles are exploded to the blocks that their windows overlap and join them on (level, bx, by); what a tile needs then
meets in one group: its window of blocks, and the runs of pixels inside its zones. No pixel travels as a row."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions import crs, png, ramps, tilemath
from gridlake.operators import coverage
from gridlake.operators.style import Style, cell_metres

BLOCK = 64
PARTS = "z int, x int, y int, level int, band int, row0 int, col0 int, width int, height int, values array<float>"


@dataclass(frozen=True)
class Grid:
    """A pyramid level, as tiles need it."""

    gt: tuple[float, ...]
    epsg: int | None
    bands: int


# values ----------------------------------------------------------------------------------------------------------------


def pixel_places(z: int, x: int, y: int, size: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Fractional (col, row) of a tile's pixel centres."""
    n, centre = 2.0**z, (np.arange(size) + 0.5) / size
    lon = (x + centre) / n * 360 - 180
    lat = np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * (y + centre) / n))))
    lon, lat = np.meshgrid(lon, lat)
    east, north = crs.project(lon, lat, grid.epsg, crs.Arrays)
    g = grid.gt
    det = g[1] * g[5] - g[2] * g[4]
    if abs(det) < 1e-15:
        return np.full(lon.shape, np.nan), np.full(lon.shape, np.nan)
    dx, dy = east - g[0], north - g[3]
    return (dx * g[5] - dy * g[2]) / det, (dy * g[1] - dx * g[4]) / det


def _take(mosaic: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    inside = (row >= 0) & (row < mosaic.shape[0]) & (col >= 0) & (col < mosaic.shape[1])
    out = np.full(row.shape, np.nan)
    out[inside] = mosaic[row[inside], col[inside]]
    return out


def sample(mosaic: np.ndarray, row0: int, col0: int, fcol: np.ndarray, frow: np.ndarray, bilinear: bool, nodata: float | None) -> np.ndarray:
    """Values at the places; NaN where there is none. Bilinear: a missing neighbour gives the top left one."""
    good = np.isfinite(fcol) & np.isfinite(frow)
    col, row = (np.where(good, np.floor(v), -1).astype(np.int64) for v in (fcol, frow))
    if not bilinear:
        return _take(mosaic, row - row0, col - col0)
    if nodata is not None:
        mosaic = np.where(np.abs(mosaic - nodata) <= abs(nodata) * 1e-5 + 1e-5, np.nan, mosaic)
    v00, v01, v10, v11 = (_take(mosaic, row - row0 + i, col - col0 + j) for i in (0, 1) for j in (0, 1))
    fx, fy = fcol - col, frow - row
    top, bottom = v00 + (v01 - v00) * fx, v10 + (v11 - v10) * fx
    mixed = top + (bottom - top) * fy
    return np.where(np.isnan(mixed), v00, mixed)


# styles: arithmetic of 32-bit floats, each step rounded once ------------------------------------------------------------


def _f32(v):
    return np.asarray(v, np.float64).astype(np.float32).astype(np.float64)


def _unit(v: np.ndarray, low: float, high: float) -> np.ndarray:
    span = float(_f32(high - low))
    return np.zeros(v.shape) if span <= 0 else _f32(_f32(v - low) / span)


def _visible(v: np.ndarray, nodata: float | None) -> np.ndarray:
    seen = np.isfinite(v)
    return seen if nodata is None else seen & ~((np.abs(v - nodata) < 1.1920929e-05) | (v == nodata))


def _on_ramp(name: str, t: np.ndarray) -> np.ndarray:
    colours = np.array(ramps.ramp(name), float)
    at = np.clip(np.nan_to_num(t), 0, 1) * (len(colours) - 1)
    low = np.minimum(np.floor(at).astype(int), len(colours) - 2)
    mixed = colours[low] + (colours[low + 1] - colours[low]) * (at - low)[..., None]
    return np.floor(mixed + 0.5)


def shade(v: np.ndarray, style: Style, scale: float) -> np.ndarray:
    """Hillshade in [0, 1]; 0 on the border and beside missing values."""
    out = np.zeros(v.shape)
    nw, n, ne, w, _, e, sw, s, se = (v[i : v.shape[0] - 2 + i, j : v.shape[1] - 2 + j] for i in range(3) for j in range(3))
    cell = 8 * scale * style.z_factor
    gx = _f32((nw - ne) + 2 * (w - e) + (sw - se)) / cell
    gy = _f32((sw + 2 * s + se) - (nw + 2 * n + ne)) / cell
    azimuth, zenith = math.radians(450 - style.azimuth), math.radians(90 - style.altitude)
    slope = np.arctan(np.sqrt(gx * gx + gy * gy))
    with np.errstate(divide="ignore", invalid="ignore"):
        steep = math.pi / 2 - np.arctan(gy / gx) + np.where(gx < 0, math.pi, 0.0)
    aspect = np.where(np.abs(gx) < 1e-10, np.where(gy > 0, 0.0, math.pi), steep)
    found = math.cos(zenith) * np.cos(slope) + math.sin(zenith) * np.sin(slope) * np.cos(azimuth - aspect)
    out[1:-1, 1:-1] = np.nan_to_num(np.maximum(found, 0))
    return out


def paint(values: list[np.ndarray], style: Style, scale: float) -> np.ndarray:
    """(rows, columns, 4) of one band's values, or of three under rgb."""
    v = values[0]
    seen = _visible(v, style.nodata)
    pixels = np.zeros((*v.shape, 4))
    if style.mode == "rgb":
        for k, (band, low, high) in enumerate(zip(values, style.rgb_min, style.rgb_max)):
            pixels[..., k] = np.clip(np.floor(np.nan_to_num(_unit(band, low, high)) * 255 + 0.5), 0, 255)
    elif style.mode == "classified":
        colour, some = np.zeros((*v.shape, 3)), np.zeros(v.shape, bool)
        for threshold, rgb in style.stops:
            above = v >= threshold
            colour[above], some = rgb, some | above
        pixels[..., :3], seen = colour, seen & some
    elif style.mode == "contour":
        n = style.contour_level
        step = float(_f32(max(style.max - style.min, 0.001) / n))
        band = np.clip(np.floor(np.nan_to_num(_f32(_f32(v - style.min) / step))), 0, n - 1)
        pixels[..., :3] = _on_ramp(style.colormap, (band + 0.5) / n)
    elif style.mode == "hillshade":
        light = shade(v, style, scale)
        if style.hillshade_colormap:
            pixels[..., :3] = np.floor(_on_ramp(style.hillshade_colormap, _unit(v, style.min, style.max)) * light[..., None] + 0.5)
        else:
            pixels[..., :3], seen = np.floor(light * 255 + 0.5)[..., None], light > 0
    else:
        pixels[..., :3] = _on_ramp(style.colormap, _unit(v, style.min, style.max))
    pixels[..., 3] = 255
    pixels[~seen] = 0
    return pixels.astype(np.uint8)


# tiles -----------------------------------------------------------------------------------------------------------------


def _mosaic(parts: list[dict], bands: list[int]) -> tuple[list[np.ndarray], int, int]:
    """The parts' blocks put together, for each band; and where the whole begins."""
    if not parts:
        return [np.full((0, 0), np.nan)] * len(bands), 0, 0
    row0, col0 = min(p["row0"] for p in parts), min(p["col0"] for p in parts)
    shape = max(p["row0"] + p["height"] for p in parts) - row0, max(p["col0"] + p["width"] for p in parts) - col0
    out = {b: np.full(shape, np.nan) for b in bands}
    for p in parts:
        if p["band"] in out:
            r, c = p["row0"] - row0, p["col0"] - col0
            out[p["band"]][r : r + p["height"], c : c + p["width"]] = p["values"].reshape(p["height"], p["width"])
    return [out[b] for b in bands], row0, col0


def image(z: int, x: int, y: int, grid: Grid, parts: list[dict], mask: np.ndarray | None, style: Style, size: int, bilinear: bool) -> np.ndarray:
    bands = [min(k, grid.bands - 1) for k in range(3)] if style.mode == "rgb" else [0]
    mosaics, row0, col0 = _mosaic(parts, sorted(set(bands)))
    places = pixel_places(z, x, y, size, grid)
    by_band = {b: sample(m, row0, col0, *places, bilinear and style.mode != "rgb", style.nodata) for b, m in zip(sorted(set(bands)), mosaics)}
    values = [by_band[b] for b in bands]
    if mask is not None:
        values = [np.where(mask, v, np.nan) for v in values]
    return paint(values, style, cell_metres(grid.gt, grid.epsg))


def _parts_of(table: pa.Table) -> list[dict]:
    scalars = {c: table.column(c).to_pylist() for c in ("band", "row0", "col0", "width", "height")}
    column = table.column("values").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    out = []
    for k in range(table.num_rows):
        if scalars["band"][k] is not None:
            out.append({c: v[k] for c, v in scalars.items()} | {"values": column[k].values.to_numpy(zero_copy_only=False).astype(float)})
    return out


def tile_masks(tiles: DataFrame, zones: DataFrame, size: int) -> DataFrame:
    """(z, x, y, row, col0, length, w) runs of the tiles' pixels whose centre lies in a zone (zone_id, polygons in degrees).

    A zone is dealt to the tiles that its bounds overlap, within the rows and columns that are asked for, and joins them on (z, x, y)."""
    zooms = tiles.groupBy("z").agg(*(f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("low", F.min), ("high", F.max)))).collect()  # a row for each zoom
    points = F.flatten(F.flatten("polygons"))
    of = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    bounded = zones.select("polygons", of(F.array_min, "x").alias("_w"), of(F.array_max, "x").alias("_e"), of(F.array_min, "y").alias("_s"), of(F.array_max, "y").alias("_n")).where("_w is not null")
    span = lambda a, b, low, high: F.when(F.least(b, F.lit(high)) >= F.greatest(a, F.lit(low)), F.sequence(F.greatest(a, F.lit(low)), F.least(b, F.lit(high))))
    dealt = None
    for r in zooms:
        z = F.lit(r.z)
        first, last = tilemath.tile_of(F.col("_w"), F.col("_n"), z), tilemath.tile_of(F.col("_e"), F.col("_s"), z)
        part = bounded.select("polygons", z.alias("z"), F.explode(span(first["x"], last["x"], r.low_x, r.high_x)).alias("x"), span(first["y"], last["y"], r.low_y, r.high_y).alias("_ys"))
        part = part.select("polygons", "z", "x", F.explode("_ys").alias("y"))
        dealt = part if dealt is None else dealt.unionAll(part)
    if dealt is None:
        return coverage.coverage_runs(bounded.select("polygons", *(F.lit(0).alias(c) for c in "zxy")).limit(0), size, size, exact=False)

    def place(p):
        col, row = tilemath.tile_pixel(p["x"], p["y"], F.col("z"), F.col("x"), F.col("y"), size)
        return F.struct(col.alias("x"), row.alias("y"))

    near = dealt.join(tiles.select("z", "x", "y").distinct(), ["z", "x", "y"])
    placed = near.withColumn("polygons", F.transform("polygons", lambda p: F.transform(p, lambda ring: F.transform(ring, place))))
    return coverage.coverage_runs(placed, size, size, exact=False)


def render(tiles: DataFrame, parts: DataFrame, grids: dict[int, Grid], style: Style, size: int = 256, interpolation: str = "nearest", masks: DataFrame | None = None, as_png: bool = True) -> DataFrame:
    """(z, x, y, image) of tiles (z, x, y, level), from their blocks (PARTS) and the runs of pixels that masks leave."""
    frame = tiles.select("z", "x", "y", "level", *(F.lit(None).cast("int").alias(c) for c in ("band", "row0", "col0", "width", "height")), F.lit(None).cast("array<float>").alias("values"))
    every = frame.unionAll(parts.select(*frame.columns))
    bilinear = interpolation == "bilinear"

    def made(table: pa.Table, mask: np.ndarray | None) -> pa.Table:
        z, x, y, level = (table.column(c)[0].as_py() for c in ("z", "x", "y", "level"))
        pixels = image(z, x, y, grids[level], _parts_of(table), mask, style, size, bilinear)
        data = png.encode(pixels) if as_png else pixels.tobytes()
        return pa.table({**{k: pa.array([v], pa.int32()) for k, v in zip("zxy", (z, x, y))}, "image": pa.array([data], pa.binary())})

    schema = "z int, x int, y int, image binary"
    if masks is None:
        return every.groupBy("z", "x", "y").applyInArrow(lambda table: made(table, None), schema)

    def masked(table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:  # a mask of no tile
            return made_none
        mask = np.zeros((size, size), bool)
        for row, col, n in zip(*(runs.column(c).to_pylist() for c in ("row", "col0", "length"))):
            mask[row, col : col + n] = True
        return made(table, mask)

    made_none = pa.table({**{k: pa.array([], pa.int32()) for k in "zxy"}, "image": pa.array([], pa.binary())})
    return every.groupBy("z", "x", "y").cogroup(masks.groupBy("z", "x", "y")).applyInArrow(masked, schema)


def blocks_of_cells(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cells (row, col, band, value) as blocks, for rasters that are tables."""
    keyed = cells.select(F.floor(F.col("row") / block).cast("int").alias("by"), F.floor(F.col("col") / block).cast("int").alias("bx"), F.col("band").cast("int").alias("band"), "row", "col", F.col("value").cast("float").alias("value"))

    def dense(table: pa.Table) -> pa.Table:
        by, bx, band = (table.column(c)[0].as_py() for c in ("by", "bx", "band"))
        grid = np.full((block, block), np.nan, np.float32)
        grid[table.column("row").to_numpy() - by * block, table.column("col").to_numpy() - bx * block] = table.column("value").to_numpy()
        values = pa.array([grid.ravel()], pa.list_(pa.float32()))
        scalars = {"level": 0, "band": band, "bx": bx, "by": by, "row0": by * block, "col0": bx * block, "width": block, "height": block}
        return pa.table({**{k: pa.array([v], pa.int32()) for k, v in scalars.items()}, "values": values})

    return keyed.groupBy("by", "bx", "band").applyInArrow(dense, "level int, band int, bx int, by int, row0 int, col0 int, width int, height int, values array<float>")


def windows(tiles: DataFrame, grids: dict[int, Grid], shapes: dict[int, tuple[int, int]], size: int, bilinear: bool) -> DataFrame:
    """tiles (z, x, y, level) with the window c0, c1, r0, r1 of cells that their pixels touch in the level; null beside the raster.

    The outermost pixels' places bound those of all, whatever the projection."""

    def one(z: int, x: int, y: int, level: int) -> list[int | None]:
        (width, height), places = shapes[level], pixel_places(z, x, y, size, grids[level])
        edge = [np.concatenate([p[0], p[-1], p[:, 0], p[:, -1]]) for p in places]
        good = np.isfinite(edge[0]) & np.isfinite(edge[1])
        if not good.any():
            return [None] * 4
        (c0, c1), (r0, r1) = ((math.floor(p[good].min()), math.floor(p[good].max()) + 1 + bilinear) for p in edge)
        c0, c1, r0, r1 = max(c0, 0), min(c1, width), max(r0, 0), min(r1, height)
        return [c0, c1, r0, r1] if c1 > c0 and r1 > r0 else [None] * 4

    def run(batches):
        for batch in batches:
            found = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "level")))]
            columns = [pa.array([f[k] for f in found], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("z", "x", "y", "level")), *columns], names=["z", "x", "y", "level", "c0", "c1", "r0", "r1"])

    typed = tiles.select(*(F.col(c).cast("int").alias(c) for c in ("z", "x", "y", "level")))
    return typed.mapInArrow(run, "z int, x int, y int, level int, c0 int, c1 int, r0 int, r1 int")


def parts_of(tiles: DataFrame, blocks: DataFrame, block_w: int, block_h: int) -> DataFrame:
    """PARTS: the tiles (z, x, y, level and their windows c0, c1, r0, r1) with the blocks that these overlap."""
    return tile_blocks(tiles, block_w, block_h).join(blocks, ["level", "bx", "by"]).select(*(c.split()[0] for c in PARTS.split(", ")))


def tile_blocks(tiles: DataFrame, block_w: int, block_h: int) -> DataFrame:
    """tiles exploded to the blocks (bx, by) that their windows overlap; those that miss the raster have none."""
    across = F.sequence(F.floor(F.col("c0") / block_w).cast("int"), F.floor((F.col("c1") - 1) / block_w).cast("int"))
    down = F.sequence(F.floor(F.col("r0") / block_h).cast("int"), F.floor((F.col("r1") - 1) / block_h).cast("int"))
    some = tiles.where("c0 is not null").select("z", "x", "y", "level", F.explode(across).alias("bx"), down.alias("_by"))
    return some.select("z", "x", "y", "level", "bx", F.explode("_by").alias("by"))

