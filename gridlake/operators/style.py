"""Styles: values to colours. Arithmetic is that of 32-bit floats: each step is done in double and rounded to float once."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import nodata, ramps

METRES_PER_DEGREE = 111320.0


def f32(c: Column) -> Column:
    """Round a double to the nearest float and go on in double."""
    return c.cast("float").cast("double")


@dataclass(frozen=True)
class Style:
    """One of five modes with its parameters, as a request gives them; numbers may be text."""

    mode: str = "colormap"
    colormap: str = "viridis"
    min: float = 0.0
    max: float = 255.0
    nodata: float | None = None
    contour_level: int = 10
    rgb_min: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rgb_max: tuple[float, float, float] = (255.0, 255.0, 255.0)
    z_factor: float = 1.0
    azimuth: float = 315.0
    altitude: float = 45.0
    hillshade_colormap: str | None = None
    stops: list = field(default_factory=list)

    @staticmethod
    def from_params(params: dict) -> Style:
        p = dict(params)
        number = lambda k, d: d if p.get(k) in (None, "") else float(p[k])
        level = number("contour_level", 10)
        if level != int(level) or level < 1:
            raise ValueError("contour_level must be a whole number of 1 or more")
        mode = p.get("mode", "colormap")
        if mode not in ("colormap", "rgb", "hillshade", "contour", "classified"):
            raise ValueError(f"there is no mode {mode!r}")
        stops = p.get("stops") or []
        return Style(
            mode, p.get("colormap", "viridis"), number("min", 0.0), number("max", 255.0), None if p.get("nodata") in (None, "") else float(p["nodata"]), int(level),
            tuple(number(f"rgb_min_{c}", 0.0) for c in "rgb"), tuple(number(f"rgb_max_{c}", 255.0) for c in "rgb"),
            number("z_factor", 1.0), number("azimuth", 315.0), number("altitude", 45.0), p.get("hillshade_colormap"), parse_stops(stops),
        )


def parse_stops(stops) -> list[tuple[float, tuple[int, int, int]]]:
    """[threshold, [r, g, b] or "#rrggbb"] pairs or {value, color} objects, ascending; a JSON text is read first."""
    if isinstance(stops, str):
        stops = json.loads(stops)
    out = []
    for s in stops:
        value, colour = (s["value"], s["color"]) if isinstance(s, dict) else s
        out.append((float(value), ramps.parse_hex(colour) if isinstance(colour, str) else tuple(int(c) for c in colour)))
    return sorted(out, key=lambda s: s[0])


def _rgba(rgb: Column, visible: Column) -> Column:
    return F.struct(*(F.when(visible, rgb[c]).otherwise(0).alias(c) for c in "rgb"), F.when(visible, 255).otherwise(0).alias("a"))


def _unit(v: Column, low: float, high: float) -> Column:
    span = f32(F.lit(float(high)) - F.lit(float(low)))
    return F.when(span <= 0, 0.0).otherwise(f32(f32(v.cast("double") - low) / span))


def _visible(v: Column, nd: float | None) -> Column:
    return ~nodata.absolute(v, F.lit(nd).cast("double"))


def colormap(v: Column, style: Style) -> Column:
    return _rgba(ramps.sample(ramps.ramp(style.colormap), _unit(v, style.min, style.max)), _visible(v, style.nodata))


def contour(v: Column, style: Style) -> Column:
    """Bands of one colour each, sampled at their middles."""
    n = style.contour_level
    step = f32(F.lit(max(style.max - style.min, 0.001) / n))
    band = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(f32(f32(v.cast("double") - style.min) / step)).cast("int")))
    return _rgba(ramps.sample(ramps.ramp(style.colormap), (band + 0.5) / n), _visible(v, style.nodata))


def classified(v: Column, style: Style) -> Column:
    """The highest stop not above the value; transparent below all."""
    colour = F.lit(None).cast("struct<r:int,g:int,b:int>")
    for threshold, rgb in style.stops:
        colour = F.when(v >= threshold, F.struct(*(F.lit(x).alias(c) for c, x in zip("rgb", rgb)))).otherwise(colour)
    return _rgba(colour, _visible(v, style.nodata) & colour.isNotNull())


def rgb(bands: list[Column], style: Style) -> Column:
    """Three bands stretched apart; transparent where the first is missing."""
    channel = lambda v, a, b: F.greatest(F.lit(0), F.least(F.lit(255), F.round(_unit(v, a, b) * 255).cast("int")))
    made = F.struct(*(F.coalesce(channel(v, a, b), F.lit(0)).alias(c) for c, v, a, b in zip("rgb", bands, style.rgb_min, style.rgb_max)))
    return _rgba(made, _visible(bands[0], style.nodata))


def cell_metres(gt, epsg: int | None, compat: bool = False) -> float:
    """A cell's side in metres; with compat, metres too are scaled as if they were degrees."""
    side = max(abs(gt[1]), abs(gt[5]))
    return side * METRES_PER_DEGREE if compat or epsg in (None, 4326, 4269) else side


def hillshade(cells: DataFrame, style: Style, scale: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """cells (keys, row, col, value) with shade in [0, 1]; 0 on the border and beside missing cells.

    Two windows, one along rows and one along columns: the row sums of neighbours first, then those of three rows."""
    v = F.col("value").cast("double")
    along = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")
    west, east = F.lag(v).over(along), F.lead(v).over(along)
    near = (F.lag("col").over(along) == F.col("col") - 1) & (F.lead("col").over(along) == F.col("col") + 1)
    sided = cells.withColumn("_dx", F.when(near, west - east)).withColumn("_sum", F.when(near, west + 2 * v + east))
    stacked = (F.lag("row").over(down) == F.col("row") - 1) & (F.lead("row").over(down) == F.col("row") + 1)
    dx = F.lag("_dx").over(down) + 2 * F.col("_dx") + F.lead("_dx").over(down)
    dy = F.lead("_sum").over(down) - F.lag("_sum").over(down)
    cell = 8 * scale * style.z_factor
    sloped = sided.withColumn("_gx", F.when(stacked, f32(dx) / cell)).withColumn("_gy", F.when(stacked, f32(dy) / cell))
    azimuth, zenith = math.radians(450 - style.azimuth), math.radians(90 - style.altitude)
    gx, gy = F.col("_gx"), F.col("_gy")
    slope = F.atan(F.sqrt(gx * gx + gy * gy))
    aspect = F.when(F.abs(gx) < 1e-10, F.when(gy > 0, 0.0).otherwise(math.pi)).otherwise(math.pi / 2 - F.atan(gy / gx) + F.when(gx < 0, math.pi).otherwise(0.0))
    shade = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(azimuth - aspect)
    out = sloped.withColumn("shade", F.coalesce(F.greatest(F.lit(0.0), shade), F.lit(0.0)))
    return out.drop("_dx", "_sum", "_gx", "_gy")


def shade_rgba(shade: Column, v: Column, style: Style) -> Column:
    """Grey shade, transparent where it is 0; or the shade on a ramp."""
    if style.hillshade_colormap:
        base = colormap(v, Style(colormap=style.hillshade_colormap, min=style.min, max=style.max, nodata=style.nodata))
        return F.struct(*(F.round(base[c] * shade).cast("int").alias(c) for c in "rgb"), base["a"].alias("a"))
    grey = F.round(shade * 255).cast("int")
    return F.struct(*(grey.alias(c) for c in "rgb"), F.when(shade > 0, 255).otherwise(0).alias("a"))
