"""Readers, addresses, access, load records, data sets and files, each beside its SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gridlake.engine import Engine
from gridlake.functions import crs, geometry, text, tilemath
from gridlake.operators import datasets, geostore, perf, sample, zonal
from gridlake.plans.registry import query
from gridlake.plans.table_queries import _zone_polygons
from gridlake.raster import event_points, nation_zones, orders_raster, read
from gridlake.sources import tiff
from gridlake.streaming import store


@query("SELECT zone_id, x0 AS west, y1 AS north, (x1 - x0) * (y1 - y0) AS area FROM z_nat")
def geojson_read(spark, sf):
    """Zones written as GeoJSON features and read again."""
    point = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"), point("x0", "y0"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}"))
    g = nation_zones(spark, sf).select("zone_id", geometry.from_geojson(feature).alias("g"))
    b = geometry.bounds(F.col("g"))
    return g.select("zone_id", b["west"].alias("west"), b["north"].alias("north"), geometry.area(F.col("g")).alias("area"))


@query('''SELECT zone_id, count(*) AS points FROM p_evt JOIN z_nat ON (lon - 10) / 0.01 >= x0 AND (lon - 10) / 0.01 < x1 AND (lat - 2) / -0.01 >= y0 AND (lat - 2) / -0.01 < y1 GROUP BY zone_id''')
def point_in_polygon(spark, sf):
    """Points meet the zones of their cell and are tested against the polygons."""
    points = sample.located(event_points(spark, sf), orders_raster(spark, sf))
    col, row = tilemath.affine_inverse(orders_raster(spark, sf).gt, F.col("lon"), F.col("lat"))
    boxes = zonal.box_coverage(nation_zones(spark, sf)).select("zone_id", "row", "col")
    near = points.withColumn("x", col).withColumn("y", row).join(boxes, ["row", "col"]).join(_zone_polygons(spark, sf), "zone_id")
    return near.where(geometry.contains(F.col("polygons"), F.col("x"), F.col("y"))).groupBy("zone_id").agg(F.count("*").alias("points"))


@query("SELECT n_regionkey AS region, count(*) AS polygons, sum((x1 - x0) * (y1 - y0)) AS area FROM z_nat JOIN nation ON n_nationkey = zone_id GROUP BY 1")
def geometry_union(spark, sf):
    regions = read(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("region"))
    joined = geostore.union_geometry(_zone_polygons(spark, sf).join(regions, "zone_id"), "region")
    return joined.select("region", F.size("polygons").cast("long").alias("polygons"), geometry.area(F.col("polygons")).alias("area"))


@query("SELECT point_id, 32600 + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 + CASE WHEN lat < 0 THEN 100 ELSE 0 END AS epsg FROM p_evt")
def utm_code(spark, sf):
    return event_points(spark, sf).select("point_id", crs.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


@query("SELECT point_id, round(((lon + 180) / 360 * 512 - floor((lon + 180) / 360 * 512)) * 256, 4) AS px FROM p_evt")
def tile_pixel_of_point(spark, sf):
    z = F.lit(9)
    tile = tilemath.tile_of(F.col("lon"), F.col("lat"), z)
    px, _ = tilemath.tile_pixel(F.col("lon"), F.col("lat"), z, tile["x"], tile["y"], 256)
    return event_points(spark, sf).select("point_id", F.round(px, 4).alias("px"))


@query("SELECT p_partkey, p_size <= 30 AND p_partkey % 64 < 2 ** p_size AND p_partkey % 32 < 2 ** p_size AS good FROM part")
def tile_addresses(spark, sf):
    z, x, y = F.col("p_size"), F.col("p_partkey") % 64, F.col("p_partkey") % 32
    return read(spark, sf, "part").select("p_partkey", tilemath.address_problem(z, x, y).isNull().alias("good"))


@query("SELECT p_partkey, round(log2(360.0::DOUBLE / (256 * (p_size / 1000.0::DOUBLE))), 6) AS zoom FROM part")
def native_zooms(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(tilemath.native_zoom(F.col("p_size") / 1000.0), 6).alias("zoom"))


_OK = "event_type <> 'purchase'"


@query(f"""
SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE {_OK}) AS ok, count(*) - count(*) FILTER (WHERE {_OK}) AS errors, quantile_disc(value, 0.5) FILTER (WHERE {_OK}) AS p50,
  quantile_disc(value, 0.99) FILTER (WHERE {_OK}) AS p99, round(count(*) FILTER (WHERE {_OK}) / 60.0::DOUBLE, 6) AS achieved_rps, round(coalesce(sum(event_id) FILTER (WHERE {_OK}), 0) / 1e6 / 60, 8) AS mb_per_s,
  round(CASE WHEN count(*) FILTER (WHERE {_OK}) > 0 THEN sum(event_id) FILTER (WHERE {_OK}) / count(*) FILTER (WHERE {_OK}) / 1024 ELSE 0 END, 6) AS kb_per_request FROM events GROUP BY user_id""")
def run_summaries(spark, sf):
    """Served requests only count for rates, bytes and latencies."""
    found = perf.soak(perf.summary(read(spark, sf, "events"), ["user_id"], F.lit(60.0), F.expr(_OK), "value", "event_id"))
    return found.select("user_id", "requests", "ok", "errors", "p50", "p99", F.round("achieved_rps", 6).alias("achieved_rps"), F.round("mb_per_s", 8).alias("mb_per_s"), F.round("kb_per_request", 6).alias("kb_per_request"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def interpolated_percentile(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(perf.interpolated("value", 0.9), 6).alias("p90"))


@query("""
WITH s AS (SELECT user_id, event_type, sum(value) AS ms, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, round(ms, 4) AS ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) - 1 AS INTEGER) AS place FROM s""")
def phase_spans(spark, sf):
    return perf.spans(read(spark, sf, "events"), "user_id", "event_type", "value", "event_id").withColumn("ms", F.round("ms", 4))


@query("""
WITH p AS (SELECT user_id, event_type, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1, 2), a AS (SELECT user_id, sum(p50) AS accounted FROM p GROUP BY 1), s AS (SELECT user_id, quantile_disc(value, 0.5) AS service FROM events GROUP BY 1)
SELECT user_id, round(accounted, 4) AS accounted, service, round(accounted / service, 6) AS share FROM a JOIN s USING (user_id)""")
def phase_accounting(spark, sf):
    events = read(spark, sf, "events")
    phases = events.groupBy("user_id", "event_type").agg(perf.nearest_rank("value", 0.5).alias("p50"))
    found = perf.accounted(phases, events.groupBy("user_id").agg(perf.nearest_rank("value", 0.5).alias("p50")), "user_id")
    return found.select("user_id", F.round("accounted", 4).alias("accounted"), "service", F.round("share", 6).alias("share"))


@query("""
WITH u AS (SELECT user_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1), f AS (SELECT quantile_disc(value, 0.05) AS floor FROM events)
SELECT user_id, (p99 > 10 AND p99 > p50 * 3) OR p50 > p50 * 3 AS saturated, p50 < floor * 3 AS near_floor FROM u, f""")
def saturation_flags(spark, sf):
    """Lag percentiles against a service median, and medians within three times the floor."""
    events = read(spark, sf, "events")
    floor = events.agg(perf.nearest_rank("value", 0.05).alias("floor")).first().floor
    by = events.groupBy("user_id").agg(perf.nearest_rank("value", 0.5).alias("p50"), perf.nearest_rank("value", 0.99).alias("p99"))
    return by.select("user_id", perf.saturated(F.col("p50"), F.col("p99"), F.col("p50") * 3).alias("saturated"), perf.near_floor(F.col("p50"), F.lit(floor)).alias("near_floor"))


@query("SELECT user_id, arg_min(value, event_id) AS start, list_sort(list(value))[len(list(value)) // 2 + 1] AS p50, max(value) AS peak, arg_max(value, event_id) AS \"end\" FROM events GROUP BY 1")
def resource_summary(spark, sf):
    return datasets.resources(read(spark, sf, "events"), ["user_id"], "event_id", "value")


@query("SELECT event_type AS k, max(value) FILTER (WHERE event_id % 7 <> 0 AND value * 0.97 >= 0.95 * value) AS sustained, min(value) FILTER (WHERE event_id % 7 = 0) AS first_failing FROM events GROUP BY 1")
def rate_knee(spark, sf):
    """The highest rate that was kept up and the lowest that was not, of recorded probes."""
    probes = read(spark, sf, "events").select(F.col("event_type").alias("k"), F.col("value").alias("offered"), (F.col("value") * 0.97).alias("achieved"), (F.col("event_id") % 7 == 0).alias("saturated"))
    return datasets.knee(probes, ["k"])


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN value < 100 THEN 'pass' WHEN value < 300 THEN 'known' ELSE 'fail' END AS verdict FROM events) GROUP BY 1")
def verdict_counts(spark, sf):
    events = read(spark, sf, "events").select("event_id", "value")
    known = F.when(F.col("value") < 100, 0.0).when(F.col("value") < 300, 20.0).otherwise(50.0)
    found = perf.verdicts(events.select("event_id", F.lit(100.0).alias("v")), events.select("event_id", (100 + known).alias("v")), "event_id", "v", 0.1, 0.3)
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT event_id FROM (SELECT event_id, value, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) ORDER BY value, ts DESC LIMIT 1)""")
def least_cloudy_scene(spark, sf):
    scenes = read(spark, sf, "events").select("event_id", "value", F.struct("ts", "event_id").alias("taken"))
    return datasets.least_cloudy(scenes, "taken", "value").select("event_id")


@query("""SELECT CAST(row_number() OVER (ORDER BY (x0 + x1) / 2, (y0 + y1) / 2) - 1 AS INTEGER) AS block, zone_id FROM z_nat""")
def block_numbers(spark, sf):
    return datasets.block_set(_zone_polygons(spark, sf)).select("block", "zone_id")


@query("SELECT count(*) AS blocks, min(x0) AS west, min(y0) AS south, max(x1) AS east, max(y1) AS north, 5 * count(*) AS vertices, CAST(0 AS BIGINT) AS holes FROM z_nat")
def block_set_shape(spark, sf):
    found = datasets.describe_blocks(datasets.block_set(_zone_polygons(spark, sf)))
    return found.select("blocks", "west", "south", "east", "north", "vertices", "holes")


@query("""
WITH a AS (SELECT o_orderkey, CAST(o_orderkey % 256 AS INTEGER) AS r, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 255 END AS a FROM orders), b AS (SELECT o_orderkey, CAST(o_custkey % 256 AS INTEGER) AS r, 255 AS a FROM orders)
SELECT round(100.0 * avg(CASE WHEN a.a <> b.a THEN 1.0 ELSE 0 END), 6) AS alpha_percent, round(avg(abs(a.r - b.r) / 3.0) FILTER (WHERE a.a > 0), 6) AS mean, max(abs(a.r - b.r)) FILTER (WHERE a.a > 0) AS largest FROM a JOIN b USING (o_orderkey)""")
def image_differences(spark, sf):
    place = [F.col("o_orderkey").alias("px"), F.lit(0).alias("py")]
    grey = lambda r, a: [r.cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), a.cast("int").alias("a")]
    orders = read(spark, sf, "orders")
    a = orders.select(*place, *grey(F.col("o_orderkey") % 256, F.when(F.col("o_orderstatus") == "P", 0).otherwise(255)))
    found = datasets.image_difference(a, orders.select(*place, *grey(F.col("o_custkey") % 256, F.lit(255))))
    return found.select(F.round("alpha_percent", 6).alias("alpha_percent"), F.round("mean", 6).alias("mean"), "largest")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'a provider needs ids' WHEN c_custkey % 4 = 2 THEN 'ids need a provider' WHEN c_custkey % 8 = 3 THEN 'a shape and a provider both name the clip' END AS problem FROM customer")
def clip_references(spark, sf):
    k = F.col("c_custkey")
    given = lambda c: F.when(c, F.lit("x"))
    problem = geostore.reference_problem(given(k % 8 == 3), given((k % 4).isin(1, 3)), given((k % 4).isin(2, 3)))
    return read(spark, sf, "customer").select("c_custkey", problem.alias("problem"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN c_custkey % 5 <> 0 WHEN 4 THEN c_custkey % 5 <> 0 ELSE true END AS allowed FROM customer")
def access_answers(spark, sf):
    """Answers in all their forms: empty, a boolean, a flag, lists and what is no JSON."""
    k = F.col("c_custkey")
    listed = F.when(k % 5 == 0, '["a"]').otherwise('["b","a"]')
    body = F.when(k % 6 == 0, "").when(k % 6 == 1, "false").when(k % 6 == 2, '{"allowed": true}').when(k % 6 == 3, F.concat(F.lit('{"ids":'), listed, F.lit("}"))).when(k % 6 == 4, listed).otherwise("<html>")
    return read(spark, sf, "customer").select("c_custkey", geostore.answer_allows(body, F.array(F.lit("a"), F.lit("b"))).alias("allowed"))


@query("SELECT event_type AS method, count(*) AS lines, CAST(sum(200 + event_id % 3) AS BIGINT) AS status, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1")
def access_log(spark, sf):
    """Log lines written and read again."""
    line = F.concat(F.col("event_id"), F.lit(" "), F.col("event_type"), F.lit(' "/a?b=c" '), (200 + F.col("event_id") % 3).cast("string"), F.lit(" "), F.col("event_id"), F.lit(' "-"'))
    lines = read(spark, sf, "events").select(line.alias("value"))
    return text.log_lines(lines).groupBy("method").agg(F.count("*").alias("lines"), F.sum("status").alias("status"), F.sum("bytes").alias("bytes"))


@query("SELECT event_id, round(value, 3) AS geom, 'geom;dur=' || printf('%.3f', round(value, 3)) AS header FROM events")
def server_timings(spark, sf):
    """Timing headers written and read again."""
    header = text.server_timing_header(F.array(F.struct(F.lit("geom").alias("phase"), F.round("value", 3).alias("ms"))))
    found = read(spark, sf, "events").select("event_id", header.alias("header"))
    return found.select("event_id", F.get(text.server_timing(F.col("header")), 0)["ms"].alias("geom"), "header")


@query("SELECT p_partkey, 'a=' || p_size || '&b=' || p_partkey AS q, 'u/' || p_partkey || ',' || p_size AS url, p_partkey || '|' || p_size AS key FROM part")
def request_texts(spark, sf):
    ids = F.array("p_partkey", "p_size")
    params = F.create_map(F.lit("b"), F.col("p_partkey").cast("string"), F.lit("a"), F.col("p_size").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    filled = text.fill_template(F.lit("u/{ids}"), F.split(geostore.id_list(ids), ","))
    return read(spark, sf, "part").select("p_partkey", text.query_string(params).alias("q"), filled.alias("url"), geostore.cache_key(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("key"))


@query("SELECT DISTINCT n_regionkey AS provider, CAST(n_nationkey AS INTEGER) AS z, 1 AS x, 2 AS y FROM nation WHERE n_nationkey % 5 < n_regionkey + 1")
def stale_tile_list(spark, sf):
    nations = read(spark, sf, "nation")
    manifest = nations.select(F.col("n_regionkey").alias("provider"), F.col("n_nationkey").alias("z"), F.lit(1).alias("x"), F.lit(2).alias("y"), (F.col("n_nationkey") % 5).alias("drawn_revision"))
    changes = nations.select(F.col("n_regionkey").alias("provider"), (F.col("n_regionkey") + 1).alias("revision")).distinct()
    return store.stale_tiles(changes, manifest)


@query("SELECT value::DOUBLE AS value, '{\"kind\":\"point\",\"value\":' || CASE WHEN value IS NULL THEN 'null' ELSE CAST(value::INTEGER AS VARCHAR) END || '}' AS json, count(*) AS n FROM r_cat GROUP BY 1, 2")
def point_answers(spark, sf):
    from gridlake.raster import category_raster

    cells = category_raster(spark, sf).cells.select(F.col("value").cast("double").alias("value"), zonal.point_json(F.col("value").cast("int")).alias("json"))
    return cells.groupBy("value", "json").agg(F.count("*").alias("n"))


def _orders_file(spark, sf) -> str:
    """The orders' raster as a TIFF of blocks of 32 with one coarser level, in the shared folder; written once for each table."""
    import hashlib
    import uuid

    folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/gridlake").removeprefix("file://")
    path = f"{folder}/orders-{hashlib.md5(sf.encode()).hexdigest()}.tif"
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        raster = orders_raster(spark, sf)
        height = raster.cells.agg(F.max("row")).first()[0] + 1
        part = f"{path}.{uuid.uuid4().hex}"
        tiff.write_cells(part, raster.cells, 100, height, 32, levels=2, gt=raster.gt, epsg=4326, nodata=-1.0)
        os.replace(part, path)
    return path


@query('SELECT "row", col, value::DOUBLE AS value FROM r_ord')
def tiff_scan(spark, sf):
    """Every cell of the file."""
    return Engine(spark).scene(_orders_file(spark, sf)).raster().cells.select("row", "col", F.col("value").cast("double").alias("value"))


@query('SELECT CAST(k AS INTEGER) AS level, CASE k WHEN 0 THEN 100 ELSE 50 END AS width, CAST(CASE k WHEN 0 THEN h ELSE (h + 1) // 2 END AS INTEGER) AS height, \'float32\' AS dtype, 10.0::DOUBLE AS west, 11.0::DOUBLE AS east FROM (SELECT max("row") + 1 AS h FROM r_ord), (SELECT unnest([0, 1]) AS k)')
def tiff_info(spark, sf):
    found = Engine(spark).info(_orders_file(spark, sf))
    return found.select("level", "width", "height", "dtype", F.round("extent.west", 6).alias("west"), F.round("extent.east", 6).alias("east"))


@query("""
SELECT zone_id, round(sum(w) FILTER (WHERE v IS NOT NULL), 4) AS count, round(sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL), 3) AS avg, min(v) AS min, max(v) AS max FROM joined GROUP BY zone_id""")
def tiff_zonal(spark, sf):
    """Zones in degrees over the file; only their blocks are read."""
    lon = lambda p: F.struct((10 + p["x"] * 0.01).alias("x"), (2 - p["y"] * 0.01).alias("y"))
    zones = _zone_polygons(spark, sf).withColumn("polygons", F.transform("polygons", lambda g: F.transform(g, lambda r: F.transform(r, lon))))
    found = Engine(spark).zonal(zones, Engine(spark).scene(_orders_file(spark, sf)), deviation=False).where("status = 'ok'")
    return found.select("zone_id", F.round("count", 4).alias("count"), F.round("avg", 3).alias("avg"), "min", "max")


@query("SELECT p.point_id, r.value::DOUBLE AS value FROM p_evt p JOIN r_ord r ON r.\"row\" = CAST(floor((p.lat - 2) / -0.01) AS INTEGER) AND r.col = CAST(floor((p.lon - 10) / 0.01) AS INTEGER)")
def tiff_points(spark, sf):
    found = Engine(spark).sample(event_points(spark, sf), Engine(spark).scene(_orders_file(spark, sf)))
    return found.where("status <> 'outside'").select("point_id", F.col("value").cast("double").alias("value"))
