import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.engine import Engine, Geometries
from gridlake.functions import crs, geometry, png, ramps, text, tilemath
from gridlake.operators import geostore, perf, style, tiles, zonal
from gridlake.sources import tiff
from gridlake.streaming import store


def box(w, s, e, n):
    return [[[{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]]


ZONES = f"zone_id int, polygons {geometry.POLYGONS}"


WEST, NORTH, STEP = 24.3, -3.1, 0.02


@pytest.fixture(scope="module")
def wedge(spark, tmp_path_factory):
    """40 x 60 cells, missing above the diagonal, whole numbers below; blocks of 16 and two coarser levels."""
    rows, cols = np.mgrid[0:40, 0:60]
    image = np.where(cols <= 2 * rows, 3 + (rows + cols) % 11, -1).astype("f4")
    path = str(tmp_path_factory.mktemp("tif") / "wedge.tif")
    tiff.write_tiff(path, image, 16, gt=(WEST, STEP, 0, NORTH, 0, -STEP), epsg=4326, nodata="-1", overviews=[image[::2, ::2], image[::4, ::4]])
    return image, Engine(spark).raster(path), Engine(spark).scene(path)


def tile_at(lon, lat, z):
    n = 2**z
    return z, int((lon + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def tiles_at(spark, places, z):
    return spark.createDataFrame(sorted({tile_at(lon, lat, z) for lon, lat in places}), "z int, x int, y int")


def test_points(spark, wedge):
    image, raster, scene = wedge
    points = spark.createDataFrame([(1, WEST + 0.5 * STEP, NORTH - 0.5 * STEP), (2, WEST + 59.5 * STEP, NORTH - 39.5 * STEP), (3, WEST + 20.5 * STEP, NORTH - 2.5 * STEP), (4, 0.0, 0.0)], "id int, lon double, lat double")
    for source in (raster, scene):
        got = {r.id: (r.value, r.status) for r in Engine(spark).sample(points, source).collect()}
        assert got == {1: (3.0, "ok"), 2: (float(image[39, 59]), "ok"), 3: (None, "nodata"), 4: (None, "outside")}


def test_zonal_over_the_whole_extent(spark, wedge):
    image, raster, scene = wedge
    zones = spark.createDataFrame([(1, box(20, -8, 30, 0)), (2, box(40, 40, 41, 41)), (3, box(WEST + 40 * STEP, NORTH - STEP, WEST + 50 * STEP, NORTH))], ZONES)
    data = image[image > 0].astype(float)
    for found in (Engine(spark).zonal(zones, raster, 60, 40), Engine(spark).zonal(zones, scene)):
        rows = {r.zone_id: r for r in found.withColumn("json", zonal.answer_json()).collect()}
        r = rows[1]
        assert (r.min, r.max, r["count"], r.nodata_count) == (3, 13, len(data), image.size - len(data)) and np.isclose(r.avg, data.mean()) and np.isclose(r.stdev, data.std())
        assert np.isclose(r.area_data + r.area_nodata, r.area_total) and [rows[k].status for k in (1, 2, 3)] == ["ok", "outside", "nodata"]
        answer = json.loads(r.json)
        assert answer["kind"] == "polygon" and answer["count"] == len(data) and answer["area"]["method"] == "spherical" and "classes" not in answer
        assert json.loads(rows[3].json)["min"] is None
    classes = Engine(spark).zonal(zones.where("zone_id = 1"), scene, classes=True).collect()
    assert len(classes) == 11 and np.isclose(sum(c.frac for c in classes), 1)
    tight = Engine(spark).zonal(zones, scene, budget=1000).collect()
    assert {r.zone_id: r.status for r in tight} == {1: "too large", 2: "outside", 3: "nodata"}


def test_only_the_blocks_of_a_window_are_read(spark, wedge, monkeypatch):
    _, _, scene = wedge
    zones = spark.createDataFrame([(1, box(WEST + 17 * STEP, NORTH - 20 * STEP, WEST + 30 * STEP, NORTH - 17 * STEP))], ZONES)
    asked = []
    plain = type(scene).blocks
    monkeypatch.setattr(type(scene), "blocks", lambda self, *a, **k: asked.append(plain(self, *a, **k)) or asked[-1])
    assert Engine(spark).zonal(zones, scene).first()["count"] > 0
    assert [(r.level, r.bx, r.by) for r in asked[0].collect()] == [(0, 1, 1)]
    tile = tiles_at(spark, [(WEST + 0.6, NORTH - 0.4)], 7)
    assert Engine(spark).render(tile, scene, {"max": 14}, 64).count() == 1
    assert {r.level for r in asked[1].collect()} == {1} and "NestedLoop" not in Engine(spark).render(tile, scene, {"max": 14}, 64, zones=zones)._jdf.queryExecution().toString()


STYLES = [({"min": "3", "max": "13"}, "nearest"), ({"mode": "contour", "min": 0, "max": 14, "contour_level": 5, "colormap": "spectral"}, "bilinear"), ({"mode": "hillshade", "z_factor": "0.0001"}, "bilinear"), ({"mode": "hillshade", "z_factor": "0.0001", "hillshade_colormap": "turbo", "min": 3, "max": 13}, "bilinear"), ({"mode": "rgb", "rgb_max_r": 13}, "nearest"), ({"mode": "classified", "stops": '[[4, "#ff0000"], [9, [0, 255, 0]]]'}, "nearest")]


@pytest.mark.parametrize("params,how", STYLES)
def test_vectorised_tiles_equal_the_long_form(spark, wedge, params, how):
    _, raster, _ = wedge
    places = tiles_at(spark, [(WEST + 0.3, NORTH - 0.5), (WEST + 1.0, NORTH - 0.7), (0.0, 0.0)], 9)
    wanted = style.Style.from_params(params)
    zones = spark.createDataFrame([(1, box(WEST + 0.1, NORTH - 0.75, WEST + 1.01, NORTH - 0.33)), (2, box(WEST + 0.9, NORTH - 0.8, WEST + 1.3, NORTH - 0.6))], ZONES)
    for clipped in (None, zones) if params.get("mode", "colormap") != "hillshade" else (None,):
        fast = {(r.x, r.y): png.decode(bytes(r.image)) for r in Engine(spark).render(places, raster, wanted, 64, how, clipped).collect()}
        slow = {(r.x, r.y): png.decode(bytes(r.image)) for r in tiles.render(places, raster, wanted, 64, how, clipped).collect()}
        assert len(fast) == 3 and any(v.any() for v in fast.values())
        for key, pixels in slow.items():
            assert np.array_equal(fast[key], pixels)
        assert not any(fast[key].any() for key in fast.keys() - slow.keys())


def test_scenes_and_rasters_give_the_same_tiles(spark, wedge):
    _, raster, scene = wedge
    places = tiles_at(spark, [(WEST + 0.3, NORTH - 0.5), (WEST + 1.0, NORTH - 0.7)], 10)
    a, b = ({(r.x, r.y): bytes(r.image) for r in Engine(spark).render(places, source, {"max": 14}, 64, as_png=False).collect()} for source in (raster, scene))
    assert a == b and all(len(v) == 64 * 64 * 4 for v in a.values())


def test_tile_info_and_levels(spark, wedge):
    _, _, scene = wedge
    rows = [tile_at(WEST + 0.5, NORTH - 0.5, z) for z in (0, 6, 8, 12)] + [(9, 0, 0), (300, 5, 9)]
    got = {(r.z, r.x): r for r in Engine(spark).tile_info(spark.createDataFrame(rows, "z int, x int, y int"), scene, size=64).collect()}
    for z, x, y in rows[:4]:
        factor = 360 / 2**z / 64 / STEP
        assert got[z, x].level == (0 if factor < 1 else min(2, int(math.log2(factor)))) and got[z, x].has_data and got[z, x].problem is None
    assert not got[9, 0].has_data and "z/x/y" in got[300, 5].problem
    info = Engine(spark).info(scene.path).orderBy("level").first()
    assert np.allclose([info.extent.west, info.extent.south, info.extent.east, info.extent.north], [WEST, NORTH - 40 * STEP, WEST + 60 * STEP, NORTH]) and np.isclose(info.center.lat, NORTH - 20 * STEP)
    factors = spark.createDataFrame([(f,) for f in (0.25, 1.5, 3.0, 16.5, 1e6)], "f double").select(tilemath.overview_level(F.col("f"), 4).alias("l"))
    assert [r.l for r in factors.collect()] == [0, 0, 1, 3, 3]


def test_projections_are_undone(spark):
    lon, lat = np.array([24.2, 27.9, 26.0]), np.array([-33.0, -3.5, -0.01])
    for code in (32735, 3857, 4326, 32635):
        back = crs.unproject(*crs.project(lon, lat, code, crs.Arrays), code, crs.Arrays)
        assert np.allclose(back, (lon, lat), atol=1e-8)


def test_projections(spark):
    points = spark.createDataFrame([(9.0, 0.0), (27.0, -26.0), (-75.5, 45.25)], "lon double, lat double")
    x, y = crs.utm(F.col("lon"), F.col("lat"), 32, False)
    first = points.select(x.alias("x"), y.alias("y")).first()
    assert np.isclose(first.x, 500000) and abs(first.y) < 1e-6
    mx, my = crs.mercator(F.col("lon"), F.col("lat"))
    back = crs.mercator_inverse(mx, my)
    assert all(np.isclose(r[0], r.lon) and np.isclose(r[1], r.lat) for r in points.select(back[0], back[1], "lon", "lat").collect())
    assert [r[0] for r in points.select(crs.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [32632, 32735, 32618]
    area = spark.range(1).select(tilemath.cell_area_spherical((0, 0.001, 0, 60.0005, 0, -0.001), F.lit(0))).first()[0]
    assert abs(area - 6196) < 2
    with pytest.raises(ValueError):
        crs.project(F.lit(0), F.lit(0), 2154)


def test_utm_scale_is_right_along_the_meridian(spark):
    """A degree of latitude near 45 is 111 132 m on the ellipsoid, times the scale of the central meridian."""
    rows = spark.createDataFrame([(44.5,), (45.5,)], "lat double")
    _, y = crs.utm(F.lit(9.0), F.col("lat"), 32, False)
    a, b = (r[0] for r in rows.select(y).collect())
    assert abs((b - a) / 0.9996 - 111131.8) < 1


def test_ramps():
    assert len(ramps.ramp("viridis")) == 256 and ramps.ramp("viridis")[0] == (68, 1, 84) and ramps.ramp("viridis")[255] == (253, 231, 37)
    assert ramps.ramp("gray") == [(17 * k,) * 3 for k in range(16)] and {len(ramps.ramp(n)) for n in (*ramps.CLASSES, "plasma", "turbo", "hot")} == {16}
    with pytest.raises(ValueError):
        ramps.ramp("rdylgn")


def test_style_parameters():
    s = style.Style.from_params({"mode": "contour", "min": "2.5", "contour_level": "4", "nodata": ""})
    assert (s.min, s.contour_level, s.nodata) == (2.5, 4, None)
    for bad in ({"mode": "x"}, {"contour_level": "2.5"}):
        with pytest.raises(ValueError):
            style.Style.from_params(bad)


def test_named_geometries(spark):
    schema = f"provider string, id string, polygons {geometry.POLYGONS}"
    table = spark.createDataFrame([], schema + ", revision int")
    g = Geometries(table).set(spark.createDataFrame([("p", "a", box(0, 0, 1, 1)), ("p", "b", box(1, 1, 2, 2)), ("q", "a", box(5, 5, 6, 6))], schema))
    requests = spark.createDataFrame([(1, "p", "a"), (1, "p", "b"), (2, "p", "a"), (2, "p", "zz")], "zone_id int, provider string, id string")
    found = g.resolve(requests).collect()
    assert [(r.zone_id, len(r.polygons)) for r in found] == [(1, 2)] and g.revision() == 1
    assert g.set(g.table.select("provider", "id", "polygons").where("id = 'b'")) is g
    assert {r.id for r in g.set(spark.createDataFrame([("q", "n", box(0, 0, 1, 1))], schema)).since(1).collect()} == {"n"}
    h = g.replace("p", spark.createDataFrame([("c", box(0, 0, 1, 1))], f"id string, polygons {geometry.POLYGONS}"))
    assert h.revision() == 2 and sorted((r.provider, r.id) for r in h.table.collect()) == [("p", "c"), ("q", "a")]
    assert h.delete(spark.createDataFrame([("q", "a")], "provider string, id string")).table.count() == 1


def test_ids_and_access(spark):
    rows = spark.createDataFrame([(" b, a ,b,,",), ("a..b",), ("x" * 129,), (",".join(map(str, range(513))),), ("",)], "t string")
    assert [r[0] for r in rows.select(geostore.parse_ids(F.col("t"))).collect()] == [["a", "b"], None, None, None, None]
    codes = spark.createDataFrame([(204,), (401,), (404,), (500,)], "c int").select(geostore.resolve_status(F.col("c")), geostore.cacheable(F.col("c"))).collect()
    assert [tuple(r) for r in codes] == [("ok", True), ("forbidden", True), ("not found", True), ("upstream", False)]
    assert spark.range(1).select(geostore.allowed(F.array(F.lit("1")), F.array(F.lit(1), F.lit(2)))).first()[0]


def test_text(spark):
    rows = spark.createDataFrame([("256M",), ("64k",), ("7",), ("x",), (None,)], "t string").select(text.parse_size(F.col("t")))
    assert [r[0] for r in rows.collect()] == [256 << 20, 64 << 10, 7, None, None]
    header = spark.createDataFrame([("geom;dur=20.5, meta;dur=.015, cache;desc=hit",)], "h string").select(text.server_timing(F.col("h")).alias("t")).first().t
    assert [(s.phase, s.ms) for s in header] == [("geom", 20.5), ("meta", 0.015)]
    lines = spark.createDataFrame([('12.5 GET "/a?b" 206 1024 "bytes=0-1" "x"',), ("rubbish",)], "value string")
    assert [tuple(r) for r in text.log_lines(lines).collect()] == [("12.5", "GET", "/a?b", 206, 1024)]
    line = spark.createDataFrame([("farms=https://x/{id}.json?a=b;ttl=60;batch=1",)], "l string").select(*(c.alias(k) for k, c in text.registry_line(F.col("l")).items())).first()
    assert (line.name, line.url, line.options) == ("farms", "https://x/{id}.json?a=b", {"ttl": "60", "batch": "1"})
    urls = spark.range(1).select(text.fill_template(F.lit("u/{ids}"), F.array(F.lit("a"), F.lit("b"))), text.fingerprint(F.lit("")), text.source_url(F.lit("a b.tif"), "http://s/")).first()
    assert tuple(urls) == ("u/a,b", "anon", "http://s/a+b.tif")


def test_percentiles_are_nearest_rank(spark):
    got = perf.percentiles(spark.range(1, 101).withColumn("k", F.lit(1)), ["k"], "id").first()
    assert (got.p50, got.p95, got.p999, got.min, got.max) == (50, 95, 100, 1, 100)
    equal = spark.range(1).select(perf.approx_equal(F.lit(float("nan")), F.lit(float("nan")), 0.1), perf.approx_equal(F.lit(None).cast("double"), F.lit(1.0), 0.1), perf.approx_equal(F.lit(100.0), F.lit(101.0), 0.02)).first()
    assert tuple(equal) == (True, False, True)


def test_overlapping_zones_are_clamped(spark):
    zones = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0), (2, 1.0, 3.0, 1.0, 3.0)], "zone_id int, x0 double, x1 double, y0 double, y1 double")
    groups = spark.createDataFrame([(1, 9), (2, 9)], "zone_id int, group_id int")
    assert zonal.union_coverage(zonal.box_coverage(zones), groups).agg(F.sum("w")).first()[0] == 7


def test_upsert_stream(spark, tmp_path):
    changes = str(tmp_path / "changes")
    schema = "provider string, id string, at long, polygons string"
    spark.createDataFrame([("p", "a", 1, "x"), ("p", "a", 2, "y"), ("p", "b", 1, "z")], schema).coalesce(1).write.parquet(changes)
    stream = lambda: spark.readStream.schema(schema).parquet(changes)
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    store.upsert_stream(stream(), target, ["provider", "id"], "at", checkpoint).awaitTermination()
    spark.createDataFrame([("p", "b", 5, "w")], schema).coalesce(1).write.mode("append").parquet(changes)
    store.upsert_stream(stream(), target, ["provider", "id"], "at", checkpoint).awaitTermination()
    got = sorted((r.id, r.polygons, r.revision) for r in store.load(spark, target, 1).collect())
    assert got == [("a", "y", 0), ("b", "w", 1)]


def test_streaming_zonal_sums_equal_the_batch(spark, tmp_path):
    source, out = str(tmp_path / "updates"), str(tmp_path / "out")
    rows = [(k % 3, k % 4, float(k), f"2024-01-01 0{k % 3}:10:00") for k in range(24)] + [(0, 0, 0.0, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "row int, col int, value double, t string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(source)
    coverage = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 1, 1.0), (2, 2, 2, 1.0)], "zone_id int, row int, col int, w double")
    updates = spark.readStream.schema("row int, col int, value double, ts timestamp").parquet(source)
    store.run_once(store.incremental_zonal(updates, coverage, "ts", "1 hour", "10 minutes"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "cp"), "complete")
    got = spark.read.parquet(f"{out}/0").groupBy("zone_id").agg(F.sum("sum").alias("s")).collect()
    want = spark.read.parquet(source).join(coverage, ["row", "col"]).groupBy("zone_id").agg(F.sum(F.col("w") * F.col("value")).alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and not math.isnan(got[0].s)


def test_answers_within_their_ttl(spark, tmp_path):
    source, out = str(tmp_path / "a"), str(tmp_path / "o")
    spark.createDataFrame([("k", 200, "2024-01-01 00:00:00"), ("k", 200, "2024-01-01 00:10:00"), ("m", 500, "2024-01-01 00:00:00")], "key string, code int, t string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(source)
    stream = spark.readStream.schema("key string, code int, ts timestamp").parquet(source)
    store.run_once(store.answers(stream, "key", "code", "ts"), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    assert [r.key for r in spark.read.parquet(out).collect()] == ["k"]
