"""Tile arithmetic, resampling, overviews and styles over the table-backed rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridlake.functions import crs, ramps, tilemath
from gridlake.operators import resample, style
from gridlake.plans.registry import query
from gridlake.raster import event_points, lineitem_raster, orders_raster, read

Z = 11


@query("""
SELECT point_id, CAST(floor((lon + 180) / 360 * 2048) AS INTEGER) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) AS INTEGER) AS y FROM p_evt""")
def tile_of_point(spark, sf):
    tile = tilemath.tile_of(F.col("lon"), F.col("lat"), F.lit(Z))
    return event_points(spark, sf).select("point_id", tile["x"].alias("x"), tile["y"].alias("y"))


_BBOX = """
WITH t AS (SELECT DISTINCT CAST(p_size % 12 AS INTEGER) AS z, CAST(p_partkey % (2 ** (p_size % 12))::BIGINT AS INTEGER) AS x, CAST((p_partkey * 7) % (2 ** (p_size % 12))::BIGINT AS INTEGER) AS y FROM part)
SELECT z, x, y, round(x / 2.0 ** z * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 2.0 ** z)))), 6) AS south,
  round((x + 1) / 2.0 ** z * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 2.0 ** z)))), 6) AS north FROM t"""


@query(_BBOX.replace("sinh(pi() * (1 - 2 * (y + 1) / 2.0 ** z))", "(exp(pi() * (1 - 2 * (y + 1) / 2.0 ** z)) - exp(-pi() * (1 - 2 * (y + 1) / 2.0 ** z))) / 2").replace("sinh(pi() * (1 - 2 * y / 2.0 ** z))", "(exp(pi() * (1 - 2 * y / 2.0 ** z)) - exp(-pi() * (1 - 2 * y / 2.0 ** z))) / 2"))
def tile_bbox(spark, sf):
    z, key = (F.col("p_size") % 12).cast("int"), F.col("p_partkey")
    side = F.pow(F.lit(2.0), z).cast("long")
    tiles = read(spark, sf, "part").select(z.alias("z"), (key % side).cast("int").alias("x"), ((key * 7) % side).cast("int").alias("y")).distinct()
    box = tilemath.tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    return tiles.select("z", "x", "y", *(F.round(c, 6).alias(k) for k, c in box.items()))


def _extents(spark, sf):
    """A degree box for each nation."""
    n = F.col("n_nationkey")
    west, south = 10 + (n % 5) * 0.2, 0.1 + F.floor(n / 5) * 0.3
    return read(spark, sf, "nation").select(n.alias("id"), west.cast("double").alias("west"), south.cast("double").alias("south"), (west + 0.17 + n * 0.001).cast("double").alias("east"), (south + 0.21).cast("double").alias("north"))


_EXT = """
WITH e AS (SELECT n_nationkey AS id, 10 + (n_nationkey % 5) * 0.2::DOUBLE AS west, 0.1::DOUBLE + (n_nationkey // 5) * 0.3::DOUBLE AS south, 10 + (n_nationkey % 5) * 0.2::DOUBLE + 0.17::DOUBLE + n_nationkey * 0.001::DOUBLE AS east, 0.1::DOUBLE + (n_nationkey // 5) * 0.3::DOUBLE + 0.21::DOUBLE AS north FROM nation),
a AS (SELECT *, {z} AS n FROM e),
"""
_TX = "CAST(floor(({lon} + 180) / 360 * n) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * n) AS BIGINT)"


@query(_EXT.format(z="2048.0::DOUBLE") + f"""
t AS (SELECT *, unnest(range({_TX.format(lon='west')}, {_TX.format(lon='east')} + 1)) AS x FROM a),
u AS (SELECT *, unnest(range({_TY.format(lat='north')}, {_TY.format(lat='south')} + 1)) AS y FROM t)
SELECT id, 11 AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM u""")
def tile_cover_extent(spark, sf):
    return resample.tiles_in_extent(_extents(spark, sf), Z).select("id", "z", "x", "y")


@query(_EXT.format(z="0") + f"""
l AS (SELECT id, west, south, east, north, unnest(range(0, least(22, greatest(0, CAST(round_even(log2(360 * 0.7 / greatest(east - west, north - south)), 0) AS BIGINT))) + 1)) AS z FROM a),
m AS (SELECT *, (west + east) / 2 AS lon, (south + north) / 2 AS lat, 2.0::DOUBLE ** z AS n FROM l),
p AS (SELECT *, {_TX.format(lon='lon')} AS x, {_TY.format(lat='lat')} AS y FROM m),
b AS (SELECT *, x / n * 360 - 180 AS w, (x + 1) / n * 360 - 180 AS e, pi() * (1 - 2 * (y + 1) / n) AS ss, pi() * (1 - 2 * y / n) AS nn FROM p),
h AS (SELECT * FROM b WHERE z = 0 OR (w <= west AND east <= e AND degrees(atan((exp(ss) - exp(-ss)) / 2)) <= south AND north <= degrees(atan((exp(nn) - exp(-nn)) / 2))))
SELECT id, CAST(max(z) AS INTEGER) AS z, CAST(arg_max(x, z) AS INTEGER) AS x, CAST(arg_max(y, z) AS INTEGER) AS y FROM h GROUP BY id""")
def deepest_tile(spark, sf):
    return resample.deepest_tile(_extents(spark, sf)).select("id", "z", "x", "y")


def _pixels(spark, sf):
    tiles = spark.createDataFrame([(9, 270, 253), (9, 270, 254)], "z int, x int, y int")
    return resample.pixel_places(resample.tile_pixels(tiles, 64), orders_raster(spark, sf), 64)


_PIXELS = """
WITH px AS (SELECT t.y, a.px, b.py, (270 + (px + 0.5::DOUBLE) / 64) / 512 * 360 - 180 AS lon, pi() * (1 - 2 * (t.y + (py + 0.5::DOUBLE) / 64) / 512) AS m
  FROM (SELECT unnest([253, 254]) AS y) t, (SELECT unnest(range(64)) AS px) a, (SELECT unnest(range(64)) AS py) b),
pl AS (SELECT y, px, py, (lon - 10) / 0.01 AS fc, (degrees(atan((exp(m) - exp(-m)) / 2)) - 2) / -0.01 AS fr FROM px),
pc AS (SELECT *, CAST(floor(fc) AS INTEGER) AS col, CAST(floor(fr) AS INTEGER) AS rw FROM pl)
"""


@query(_PIXELS + 'SELECT CAST(pc.y AS INTEGER) AS y, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, r.value::DOUBLE AS value FROM pc LEFT JOIN r_ord r ON r."row" = pc.rw AND r.col = pc.col')
def tile_pixel_nearest(spark, sf):
    out = resample.nearest(_pixels(spark, sf), orders_raster(spark, sf).cells)
    return out.select("y", "px", "py", F.col("value").cast("double").alias("value"))


@query(_PIXELS + """, f AS (SELECT pc.*, a.value::DOUBLE AS a, b.value::DOUBLE AS b, c.value::DOUBLE AS c, d.value::DOUBLE AS d, fc - pc.col AS fx, fr - pc.rw AS fy FROM pc
  LEFT JOIN r_ord a ON a."row" = pc.rw AND a.col = pc.col LEFT JOIN r_ord b ON b."row" = pc.rw AND b.col = pc.col + 1
  LEFT JOIN r_ord c ON c."row" = pc.rw + 1 AND c.col = pc.col LEFT JOIN r_ord d ON d."row" = pc.rw + 1 AND d.col = pc.col + 1)
SELECT CAST(y AS INTEGER) AS y, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(coalesce((a + (b - a) * fx) + ((c + (d - c) * fx) - (a + (b - a) * fx)) * fy, a), 3) AS value FROM f""")
def tile_pixel_bilinear(spark, sf):
    out = resample.bilinear(_pixels(spark, sf), orders_raster(spark, sf).cells)
    return out.select("y", "px", "py", F.round("value", 3).alias("value"))


@query("""
WITH t AS (SELECT unnest(range(0, 12)) AS z), f AS (SELECT z, 360.0::DOUBLE / 2 ** z / 0.01 / 256 AS target FROM t)
SELECT CAST(z AS INTEGER) AS z, round(target, 6) AS target, CASE WHEN target < 1 THEN 0 ELSE CAST(least(4, floor(log2(target))) AS INTEGER) END AS level FROM f""")
def overview_level_select(spark, sf):
    span = F.lit(360.0) / F.pow(F.lit(2.0), "id")
    target = tilemath.overview_target(orders_raster(spark, sf).gt, span, span, 256)
    return spark.range(12).select(F.col("id").cast("int").alias("z"), F.round(target, 6).alias("target"), tilemath.overview_level(target, 5).alias("level"))


@query('SELECT CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, value::DOUBLE AS value FROM r_ord WHERE "row" % 2 = 0 AND col % 2 = 0')
def overview_build_nearest(spark, sf):
    return resample.overview(orders_raster(spark, sf).cells, 2, "nearest").withColumn("value", F.col("value").cast("double"))


@query('SELECT CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(avg(value::DOUBLE), 4) AS value FROM r_ord GROUP BY 1, 2')
def overview_build_avg(spark, sf):
    return resample.overview(orders_raster(spark, sf).cells, 4).withColumn("value", F.round("value", 4))


def _lut(name: str) -> str:
    return "[" + ", ".join(f"{{'r': {r}, 'g': {g}, 'b': {b}}}" for r, g, b in ramps.ramp(name)) + "]"


_LIT = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_UNIT = _LIT.format(_LIT.format("value::DOUBLE - {low}") + " / " + _LIT.format("{span}"))
_SAMPLE = """, s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0, t)) * ({n} - 1) AS pos FROM u), l AS (SELECT *, CAST(least(floor(pos), {n} - 2) AS INTEGER) AS low FROM s),
c AS (SELECT *, {lut}[low + 1] AS p, {lut}[low + 2] AS q FROM l)
SELECT "row", col, CASE WHEN ok THEN CAST(round(p.r + (q.r - p.r) * (pos - low)) AS INTEGER) ELSE 0 END AS r, CASE WHEN ok THEN CAST(round(p.g + (q.g - p.g) * (pos - low)) AS INTEGER) ELSE 0 END AS g,
  CASE WHEN ok THEN CAST(round(p.b + (q.b - p.b) * (pos - low)) AS INTEGER) ELSE 0 END AS b, CASE WHEN ok THEN 255 ELSE 0 END AS a FROM c"""


def _coloured(cells, colour):
    return cells.select("row", "col", colour.alias("c")).select("row", "col", "c.r", "c.g", "c.b", "c.a")


@query('WITH u AS (SELECT "row", col, coalesce(value, 0) AS value, value IS NOT NULL AS ok, ' + _UNIT.format(low="1000.0", span="499000.0").replace("value::DOUBLE", "coalesce(value, 0)::DOUBLE") + " AS t FROM r_ord)" + _SAMPLE.format(n=256, lut=_lut("viridis")))
def style_colormap(spark, sf):
    return _coloured(orders_raster(spark, sf).cells, style.colormap(F.col("value"), style.Style(min=1000.0, max=500000.0)))


@query('WITH v AS (SELECT "row", col, value IS NOT NULL AS ok, greatest(0, least(7, floor(' + _LIT.format(_LIT.format("coalesce(value, 0)::DOUBLE") + " / " + _LIT.format("62500.0")) + '))) AS band FROM r_ord), u AS (SELECT *, (band + 0.5) / 8 AS t FROM v)' + _SAMPLE.format(n=16, lut=_lut("spectral")))
def style_contour(spark, sf):
    return _coloured(orders_raster(spark, sf).cells, style.contour(F.col("value"), style.Style(colormap="spectral", min=0.0, max=500000.0, contour_level=8)))


STOPS = [(50000.0, (10, 20, 30)), (150000.0, (40, 50, 60)), (300000.0, (200, 100, 0))]


@query("""
WITH s AS (SELECT unnest([{'t': 50000.0, 'r': 10, 'g': 20, 'b': 30}, {'t': 150000.0, 'r': 40, 'g': 50, 'b': 60}, {'t': 300000.0, 'r': 200, 'g': 100, 'b': 0}]) AS s),
m AS (SELECT o."row", o.col, max(s.s.t) AS t FROM r_ord o LEFT JOIN s ON o.value >= s.s.t GROUP BY 1, 2)
SELECT m."row", m.col, coalesce(s.s.r, 0) AS r, coalesce(s.s.g, 0) AS g, coalesce(s.s.b, 0) AS b, CASE WHEN s.s.r IS NULL THEN 0 ELSE 255 END AS a FROM m LEFT JOIN s ON s.s.t = m.t""")
def style_classified(spark, sf):
    return _coloured(orders_raster(spark, sf).cells, style.classified(F.col("value"), style.Style(stops=STOPS)))


_CHANNEL = "CAST(greatest(0, least(255, round(" + _LIT.format(_LIT.format("{v}") + " / " + _LIT.format("105000.0")) + " * 255))) AS INTEGER)"


@query("""
WITH w AS (SELECT "row", col, CAST(max(value) FILTER (WHERE band = 0) AS FLOAT) AS x, CAST(max(value) FILTER (WHERE band = 1) AS FLOAT) AS y, CAST(max(value) FILTER (WHERE band = 2) AS FLOAT) AS z FROM r_li GROUP BY 1, 2)
SELECT "row", col, """ + ", ".join(f"CASE WHEN x IS NULL THEN 0 ELSE coalesce({_CHANNEL.format(v=v + '::DOUBLE')}, 0) END AS {c}" for v, c in zip("xyz", "rgb")) + ", CASE WHEN x IS NULL THEN 0 ELSE 255 END AS a FROM w")
def style_rgb(spark, sf):
    """The first three bands; a pivot turns band rows to columns in one aggregation."""
    wide = lineitem_raster(spark, sf).cells.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == k, F.col("value"))).cast("float").alias(f"v{k}") for k in range(3)))
    return _coloured(wide, style.rgb([F.col(f"v{k}") for k in range(3)], style.Style(rgb_max=(105000.0,) * 3)))


_ZEN, _AZ = math.radians(45), math.radians(135)


@query(f"""
WITH n AS (SELECT c."row", c.col, {', '.join(f'max(CASE WHEN o."row" = c."row" + {i} AND o.col = c.col + {j} THEN o.v END) AS p{i + 1}{j + 1}' for i in (-1, 0, 1) for j in (-1, 0, 1))}
  FROM (SELECT CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col FROM orders) c
  JOIN (SELECT CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col, CAST(o_totalprice AS FLOAT)::DOUBLE AS v FROM orders) o
  ON o."row" BETWEEN c."row" - 1 AND c."row" + 1 AND o.col BETWEEN c.col - 1 AND c.col + 1 GROUP BY 1, 2),
g AS (SELECT "row", col, CAST(CAST(((p20 + 2 * p10) + p00) - ((p22 + 2 * p12) + p02) AS FLOAT) AS DOUBLE) / 800000.0 AS gx, CAST(CAST((p20 + 2 * p21 + p22) - (p00 + 2 * p01 + p02) AS FLOAT) AS DOUBLE) / 800000.0 AS gy FROM n),
a AS (SELECT *, CASE WHEN abs(gx) < 1e-10 THEN CASE WHEN gy > 0 THEN 0 ELSE pi() END ELSE pi() / 2 - atan(gy / gx) + CASE WHEN gx < 0 THEN pi() ELSE 0 END END AS aspect, atan(sqrt(gx * gx + gy * gy)) AS slope FROM g)
SELECT "row", col, round(coalesce(greatest(0, cos({_ZEN}) * cos(slope) + sin({_ZEN}) * sin(slope) * cos({_AZ} - aspect)), 0), 4) AS shade FROM a""")
def hillshade_3x3(spark, sf):
    cells = read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), F.col("o_totalprice").cast("float").alias("value"))
    return style.hillshade(cells, style.Style(), 100000.0).select("row", "col", F.round("shade", 4).alias("shade"))


@query("SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round((lon - 10) / 0.01, 4) AS fcol, round((lat - 2) / -0.01, 4) AS frow FROM p_evt")
def affine_forward_inverse(spark, sf):
    gt = orders_raster(spark, sf).gt
    col, row = tilemath.affine_inverse(gt, F.col("lon"), F.col("lat"))
    lon, lat = tilemath.affine_forward(gt, col, row)
    return event_points(spark, sf).select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(col, 4).alias("fcol"), F.round(row, 4).alias("frow"))


@query("SELECT point_id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(radians(lat)) + 1 / cos(radians(lat))) * 6378137.0, 3) AS y FROM p_evt")
def mercator_forward(spark, sf):
    x, y = crs.mercator(F.col("lon"), F.col("lat"))
    return event_points(spark, sf).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _utm_sql() -> str:
    f = crs.FLATTENING["wgs84"]
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = list(enumerate(crs._series(n), 1))
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    x = " + ".join(f"{a!r}::DOUBLE * cos({2 * k} * xi) * {sinh.format(f'{2 * k} * eta')}" for k, a in terms)
    y = " + ".join(f"{a!r}::DOUBLE * sin({2 * k} * xi) * {cosh.format(f'{2 * k} * eta')}" for k, a in terms)
    return f"""
WITH a AS (SELECT point_id, radians(lat) AS phi, radians(lon - 9) AS lam FROM p_evt),
b AS (SELECT *, 0.5 * ln((1 + sin(phi)) / (1 - sin(phi))) - {e!r}::DOUBLE * 0.5 * ln((1 + {e!r}::DOUBLE * sin(phi)) / (1 - {e!r}::DOUBLE * sin(phi))) AS q FROM a),
c AS (SELECT *, (exp(q) - exp(-q)) / 2 AS tau FROM b),
d AS (SELECT point_id, atan2(tau, cos(lam)) AS xi, ln(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam)) + sqrt((sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) ** 2 + 1)) AS eta FROM c)
SELECT point_id, round(0.9996::DOUBLE * {radius!r}::DOUBLE * (eta + {x}) + 500000, 2) AS x, round(0.9996::DOUBLE * {radius!r}::DOUBLE * (xi + {y}), 2) AS y FROM d"""


@query(_utm_sql())
def utm_forward(spark, sf):
    x, y = crs.project(F.col("lon"), F.col("lat"), 32632)
    return event_points(spark, sf).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))
