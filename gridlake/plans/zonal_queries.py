"""Zonal and point queries over the table-backed rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.functions import nodata
from gridlake.operators import sample as points
from gridlake.operators import zonal
from gridlake.plans.registry import query
from gridlake.raster import category_raster, event_points, lineitem_raster, nation_zones, orders_raster


def _r(*names: str, digits: int = 4):
    return [F.round(n, digits).alias(n) for n in names]


def _joined(spark, sf):
    return zonal.covered(zonal.box_coverage(nation_zones(spark, sf)), orders_raster(spark, sf).cells)


@query("""
SELECT zone_id, round(sum(w) FILTER (WHERE v IS NOT NULL), 4) AS count, round(sum(w * v), 2) AS sum, round(sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL), 4) AS avg,
  min(v) AS min, max(v) AS max, round(coalesce(sum(w) FILTER (WHERE v IS NULL), 0), 4) AS nodata_count FROM joined GROUP BY zone_id""")
def zonal_box_stats(spark, sf):
    out = zonal.stats(_joined(spark, sf))
    return out.select("zone_id", *_r("count", "avg", "nodata_count"), *_r("sum", digits=2), "min", "max")


@query("""
WITH m AS (SELECT zone_id, sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL) AS mean FROM joined GROUP BY zone_id)
SELECT zone_id, round(sqrt(sum(w * (v - mean) ** 2) / sum(w) FILTER (WHERE v IS NOT NULL)), 3) AS stdev FROM joined JOIN m USING (zone_id) GROUP BY zone_id""")
def zonal_stdev(spark, sf):
    return zonal.stats(_joined(spark, sf), deviation=True).select("zone_id", *_r("stdev", digits=3))


@query("""
SELECT zone_id, round(sum(w * 0.0001), 8) AS area_total, round(coalesce(sum(w * 0.0001) FILTER (WHERE v IS NOT NULL), 0), 8) AS area_data,
  round(coalesce(sum(w * 0.0001) FILTER (WHERE v IS NULL), 0), 8) AS area_nodata FROM joined GROUP BY zone_id""")
def zonal_area(spark, sf):
    out = zonal.stats(_joined(spark, sf), area=F.lit(0.0001))
    return out.select("zone_id", *_r("area_total", "area_data", "area_nodata", digits=8))


@query("""
WITH a AS (SELECT *, 6378137.0::DOUBLE * 6378137.0 * abs(sin(radians(2 - "row" * 0.01::DOUBLE - 0.005 - 0.005)) - sin(radians(2 - "row" * 0.01::DOUBLE - 0.005 + 0.005))) * radians(0.01::DOUBLE) AS area FROM joined)
SELECT zone_id, round(sum(w * area) / 1e6, 3) AS total_km2, round(coalesce(sum(w * area) FILTER (WHERE v IS NOT NULL), 0) / 1e6, 3) AS data_km2 FROM a GROUP BY zone_id""")
def zonal_area_spherical(spark, sf):
    out = zonal.stats(_joined(spark, sf), area=zonal.cell_area(orders_raster(spark, sf)))
    return out.select("zone_id", F.round(F.col("area_total") / 1e6, 3).alias("total_km2"), F.round(F.col("area_data") / 1e6, 3).alias("data_km2"))


def _classes(spark, sf):
    return zonal.classes(zonal.covered(zonal.box_coverage(nation_zones(spark, sf)), category_raster(spark, sf).cells), F.lit(0.0001))


_CLASSES = """
WITH j AS (SELECT c.zone_id, c.w, r.value::DOUBLE AS value FROM cover c JOIN r_cat r ON r."row" = c."row" AND r.col = c.col),
g AS (SELECT zone_id, value, sum(w) AS n FROM j WHERE value IS NOT NULL GROUP BY zone_id, value)
"""


@query(_CLASSES + "SELECT zone_id, value, round(n, 4) AS count, round(n * 0.0001, 8) AS area FROM g ORDER BY zone_id, value")
def zonal_classes(spark, sf):
    return _classes(spark, sf).select("zone_id", "value", *_r("count"), *_r("area", digits=8)).orderBy("zone_id", "value")


@query(_CLASSES + "SELECT zone_id, value, round(n / sum(n) OVER (PARTITION BY zone_id), 6) AS frac, 'ok' AS status FROM g")
def zonal_class_frac(spark, sf):
    return _classes(spark, sf).select("zone_id", "value", *_r("frac", digits=6), "status")


@query("""
SELECT zone_id, count(r.value)::BIGINT AS count, round(avg(r.value::DOUBLE), 4) AS avg, round(stddev_pop(r.value::DOUBLE), 3) AS stdev, min(r.value::DOUBLE) AS min, max(r.value::DOUBLE) AS max
FROM z_nat z JOIN r_ord r ON r.col + 0.5 >= x0 AND r.col + 0.5 < x1 AND r."row" + 0.5 >= y0 AND r."row" + 0.5 < y1 GROUP BY zone_id""")
def zonal_binary_center(spark, sf):
    """Unweighted statistics over the cells whose centre a zone holds."""
    joined = zonal.covered(zonal.center_coverage(nation_zones(spark, sf)), orders_raster(spark, sf).cells)
    v = F.col("value").cast("double")
    return joined.groupBy("zone_id").agg(F.count(v).alias("count"), F.round(F.avg(v), 4).alias("avg"), F.round(F.stddev_pop(v), 3).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"))


@query("""
WITH u AS (SELECT n_regionkey AS zone_id, "row", col, least(sum(w), 1.0) AS w FROM cover JOIN nation ON n_nationkey = zone_id GROUP BY n_regionkey, "row", col)
SELECT u.zone_id, round(sum(w) FILTER (WHERE value IS NOT NULL), 4) AS count, round(sum(w * value::DOUBLE), 2) AS sum FROM u JOIN r_ord r ON r."row" = u."row" AND r.col = u.col GROUP BY u.zone_id""")
def zonal_multi_id_union(spark, sf):
    """One zone for each region: the union of its nations' boxes."""
    groups = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("group_id"))
    union = zonal.union_coverage(zonal.box_coverage(nation_zones(spark, sf)), groups)
    return zonal.stats(zonal.covered(union, orders_raster(spark, sf).cells)).select("zone_id", *_r("count"), *_r("sum", digits=2))


@query("""
SELECT z.zone_id, CASE WHEN s.n IS NULL THEN 'outside' WHEN s.n <= 0 THEN 'nodata' ELSE 'ok' END AS status
FROM (SELECT zone_id FROM z_nat) z LEFT JOIN (SELECT zone_id, coalesce(sum(w) FILTER (WHERE v IS NOT NULL), 0) AS n FROM joined GROUP BY zone_id) s ON s.zone_id = z.zone_id""")
def zonal_status(spark, sf):
    return zonal.status(nation_zones(spark, sf), zonal.stats(_joined(spark, sf))).select("zone_id", "status")


@query("""
SELECT zone_id, band, round(sum(w) FILTER (WHERE value IS NOT NULL), 4) AS count, round(sum(w * value) / sum(w), 3) AS avg
FROM cover c JOIN r_li r ON r."row" = c."row" AND r.col = c.col GROUP BY zone_id, band""")
def zonal_bands(spark, sf):
    """Statistics of every band in one pass: the band is one more grouping key."""
    coverage = zonal.box_coverage(nation_zones(spark, sf))
    joined = coverage.join(lineitem_raster(spark, sf).cells, ["row", "col"])
    w, v = F.col("w"), F.col("value")
    return joined.groupBy("zone_id", "band").agg(F.round(F.sum(w), 4).alias("count"), F.round(F.sum(w * v) / F.sum(w), 3).alias("avg"))


_POINTS = """
WITH q AS (SELECT point_id, CAST(floor((lat - 2) / -0.01) AS INTEGER) AS "row", CAST(floor((lon - 10) / 0.01) AS INTEGER) AS col FROM p_evt)
"""


@query(_POINTS + 'SELECT point_id, q."row", q.col, r.value::DOUBLE AS value FROM q LEFT JOIN r_ord r ON r."row" = q."row" AND r.col = q.col')
def point_sample(spark, sf):
    out = points.sample(event_points(spark, sf), orders_raster(spark, sf))
    return out.select("point_id", "row", "col", F.col("value").cast("double").alias("value"))


@query(_POINTS + """SELECT status, count(*) AS n FROM (SELECT CASE WHEN r."row" IS NULL THEN 'outside' WHEN r.value IS NULL OR r.value = 3 THEN 'nodata' ELSE 'ok' END AS status
FROM q LEFT JOIN r_cat r ON r."row" = q."row" AND r.col = q.col) GROUP BY status""")
def point_sample_status(spark, sf):
    """A request's nodata value (3) hides cells that hold it."""
    return points.sample(event_points(spark, sf), category_raster(spark, sf), nodata_value=3.0).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders), nd AS (SELECT 250000.0::DOUBLE AS nd)
SELECT CAST(count(*) FILTER (WHERE round(v / 1000) * 1000 = nd) AS BIGINT) AS exact_n, CAST(count(*) FILTER (WHERE abs(v - nd) <= abs(nd) * 1e-5 + 1e-5) AS BIGINT) AS relative_n,
  CAST(count(*) FILTER (WHERE abs(v - nd) < 1.1920929e-05) AS BIGINT) AS absolute_n FROM v, nd""")
def nodata_policies(spark, sf):
    """The three rules side by side on prices, with 250 000 as the missing value."""
    v, nd = F.col("o_totalprice"), F.lit(250000.0)
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    return rows.agg(n(nodata.exact(F.round(v / 1000) * 1000, nd), "exact_n"), n(nodata.relative(v, nd), "relative_n"), n(nodata.absolute(v, nd), "absolute_n"))
