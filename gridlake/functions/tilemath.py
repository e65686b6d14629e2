"""Tile, affine and overview arithmetic as Column expressions. z, x, y and pixel places are ints; degrees are doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
MAX_LAT = 85.05112878
PI = math.pi


def _d(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double")


def tile_bbox(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """West, south, east, north of a Web Mercator tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda row: F.degrees(F.atan(F.sinh(PI * (1 - 2 * _d(row) / n))))
    return {"west": _d(x) / n * 360 - 180, "south": lat(y + 1), "east": (_d(x) + 1) / n * 360 - 180, "north": lat(y)}


def tile_of(lon: Column, lat: Column, z: Column) -> dict[str, Column]:
    """The tile that holds a point; latitude is clamped to the Mercator limit and the tile to the grid."""
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    place = lambda v: F.greatest(F.lit(0.0), F.least(n - 1, F.floor(v).cast("double"))).cast("int")
    return {"x": place((lon + 180) / 360 * n), "y": place((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / PI) / 2 * n)}


def zoom_for_span(span: Column, fill: float = 0.7) -> Column:
    """The zoom at which `span` degrees fill that share of a tile; ties round to even."""
    z = F.bround(F.log2(F.lit(360.0 * fill) / span)).cast("int")
    return F.when(span <= 0, 18).otherwise(F.greatest(F.lit(0), F.least(F.lit(22), z)))


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    side = F.pow(F.lit(2.0), z)
    return (z >= 0) & (z <= 30) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def address_problem(z: Column, x: Column, y: Column) -> Column:
    """What is wrong with a tile's address, null if nothing is; numbers that only fit the order x, y, z are told so."""
    address = F.concat_ws("/", z, x, y)
    swapped = valid_tile(y, z, x)
    return F.when(~valid_tile(z, x, y), F.when(swapped, F.concat(F.lit("there is no tile "), address, F.lit("; addresses are z/x/y, not x/y/z"))).otherwise(F.concat(F.lit("there is no tile "), address)))


def tile_pixel(lon: Column, lat: Column, z: Column, x: Column, y: Column, size: int) -> tuple[Column, Column]:
    """Place (col, row) of a point in the pixels of a tile."""
    n = F.pow(F.lit(2.0), z)
    return ((lon + 180) / 360 * n - x) * size, ((1 - F.asinh(F.tan(F.radians(lat))) / PI) / 2 * n - y) * size


def tile_size(size: Column) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(512), size))


def affine_forward(gt, col, row) -> tuple[Column, Column]:
    """World coordinates of pixel place (col, row) under gt = (x0, pw, xr, y0, yr, ph)."""
    g = [_d(v) for v in gt]
    return g[0] + _d(col) * g[1] + _d(row) * g[2], g[3] + _d(col) * g[4] + _d(row) * g[5]


def affine_inverse(gt, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel place (col, row) of world coordinates; null where the transform is degenerate."""
    g = [_d(v) for v in gt]
    det = g[1] * g[5] - g[2] * g[4]
    ok = lambda v: F.when(F.abs(det) >= 1e-15, v)
    dx, dy = x - g[0], y - g[3]
    return ok((dx * g[5] - dy * g[2]) / det), ok((dy * g[1] - dx * g[4]) / det)


def cell_area_planar(gt) -> float:
    return abs(gt[1] * gt[5] - gt[2] * gt[4])


def cell_area_spherical(gt, row: Column) -> Column:
    """Square metres of a degree cell: the spherical band between its latitudes times its width."""
    top = _d(gt[3]) + _d(row) * _d(gt[5])
    middle, half = top + _d(gt[5]) / 2, abs(gt[5]) / 2
    band = F.abs(F.sin(F.radians(middle - half)) - F.sin(F.radians(middle + half)))
    return F.lit(EARTH_RADIUS * EARTH_RADIUS) * band * F.lit(math.radians(abs(gt[1])))


def is_geographic(epsg: int | None) -> bool:
    return epsg in (None, 4326, 4269)


def overview_target(gt, dx: Column, dy: Column, size: Column | int) -> Column:
    """How many base cells a tile's pixel covers, the finer axis counting."""
    res_x, res_y = math.hypot(gt[1], gt[4]), math.hypot(gt[2], gt[5])
    return F.least(dx / res_x, dy / res_y) / _d(size)


def overview_level(target: Column, levels: Column | int) -> Column:
    """The coarsest level whose factor 2^i is no more than the target, 0 at least."""
    last = (F.lit(levels) if isinstance(levels, int) else levels) - 1
    return F.when(target < 1, 0).otherwise(F.least(last, F.floor(F.log2(target) + 1e-12))).cast("int")


def level_geotransform(gt, width0: int, width: int) -> tuple[float, ...]:
    scale = width0 / width
    return (gt[0], gt[1] * scale, gt[2] * scale, gt[3], gt[4] * scale, gt[5] * scale)


def pixel_window(gt, west: Column, south: Column, east: Column, north: Column, width: int, height: int) -> dict[str, Column]:
    """Columns and rows [c0, c1) x [r0, r1) that a native bbox covers, clamped to the raster; nulls where it misses."""
    return corner_window(gt, [(x, y) for x in (west, east) for y in (south, north)], width, height)


def corner_window(gt, corners: list[tuple[Column, Column]], width: int, height: int, grown: int = 0) -> dict[str, Column]:
    """The same of a box whose native corners are given, `grown` cells wider on each side; corners that have no place don't count."""
    places = [affine_inverse(gt, x, y) for x, y in corners]
    real = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    places = [(real(a), real(b)) for a, b in places]
    cols, rows = [p[0] for p in places], [p[1] for p in places]
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v.cast("int")))
    c0, c1 = clamp(F.floor(F.least(*cols)) - grown, width), clamp(F.ceil(F.greatest(*cols)) + grown, width)
    r0, r1 = clamp(F.floor(F.least(*rows)) - grown, height), clamp(F.ceil(F.greatest(*rows)) + grown, height)
    some = (c1 > c0) & (r1 > r0)
    return {"c0": F.when(some, c0), "c1": F.when(some, c1), "r0": F.when(some, r0), "r1": F.when(some, r1)}


def grid_resolutions(max_zoom: int, size: int = 256) -> list[float]:
    half = PI * EARTH_RADIUS
    return [2 * half / (size * 2**z) for z in range(max_zoom + 1)]


def native_zoom(degrees_per_pixel: Column) -> Column:
    return F.log2(F.lit(360.0) / (256 * degrees_per_pixel))
