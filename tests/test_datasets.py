import math

import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry
from gridlake.operators import datasets


def test_dem(spark):
    dem = datasets.synthetic_dem(spark, 64)
    row = dem.agg(F.min("value"), F.max("value"), F.count("*"), F.count("value")).first()
    assert 0 <= row[0] < row[1] <= 3000 and row[2] == 4096 and 0 < row[2] - row[3] < 200
    assert dem.exceptAll(datasets.synthetic_dem(spark, 64)).count() == 0


def square(x, y, s=0.001):
    return [[[{"x": x + a * s, "y": y + b * s} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]]]


def test_block_sets(spark):
    zones = spark.createDataFrame([(square(27.002, -26.0),), (square(27.0, -26.0),)], f"polygons {geometry.POLYGONS}")
    blocks = datasets.block_set(zones)
    assert [r.block for r in blocks.orderBy("cx").collect()] == [0, 1]
    d = datasets.describe_blocks(blocks).first()
    assert (d.blocks, d.vertices, d.holes, d.utm_epsg) == (2, 10, 0, 32735)
    assert math.isclose(d.area_total, 2 * (111319.49 * 0.001) ** 2 * math.cos(math.radians(26)), rel_tol=1e-3)


def test_stores(spark):
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"z"))], "key string, content binary")
    first = datasets.unpublished(files, spark.createDataFrame([], "key string, sha256 string, bytes long"))
    assert first.count() == 2 and datasets.unpublished(files, first).count() == 0
    runs = spark.createDataFrame([("c", True), ("", True), ("c", False), ("c", None)], "commit string, clean boolean")
    assert [r[0] is None for r in runs.select(datasets.provenance_problem(F.col("commit"), F.col("clean"))).collect()] == [True, False, False, False]
    joined = datasets.with_reason(spark.createDataFrame([("m",), ("n",)], "name string"), spark.createDataFrame([("m", 1)], "name string, scene int"), "name")
    assert {r.name: r.reason for r in joined.collect()} == {"m": None, "n": "no scene of this name"}


def test_searches(spark):
    scenes = spark.createDataFrame([(k, float((k * 7) % 10)) for k in range(40)], "day int, clouds double")
    assert datasets.least_cloudy(scenes, "day", "clouds").first().day == 30
    probes = spark.createDataFrame([("s", 100.0, 99.0, False), ("s", 200.0, 195.0, False), ("s", 400.0, 300.0, False), ("s", 300.0, 299.0, True)], "k string, offered double, achieved double, saturated boolean")
    assert tuple(datasets.knee(probes, ["k"]).first()) == ("s", 200.0, 300.0)
    rows = spark.range(100)
    assert datasets.steady_sample(rows, "id", 5).collect() == datasets.steady_sample(rows.repartition(7), "id", 5).collect()
    series = spark.createDataFrame([("a", t, v) for t, v in enumerate([5, 9, 7, 6])], "k string, t int, v int")
    assert tuple(datasets.resources(series, ["k"], "t", "v").first()) == ("a", 5, 7, 9, 6)


def test_images_differ(spark):
    pixels = [(x, y, 10, 20, 30, 255) for x in range(4) for y in range(4)]
    other = [(x, y, 10, 20, 90 if (x, y) == (0, 0) else 30, 0 if (x, y) == (1, 1) else 255) for x, y, *_ in pixels]
    schema = "px int, py int, r int, g int, b int, a int"
    d = datasets.image_difference(spark.createDataFrame(pixels, schema), spark.createDataFrame(other, schema)).first()
    assert d.alpha_percent == 6.25 and d.largest == 60 and d.coarse_percent == 6.25 and d["mean"] == pytest.approx(20 / 15)


def test_simplify(spark):
    ring = [{"x": k / 10, "y": 0.0} for k in range(11)] + [{"x": 1.0, "y": 1.0}, {"x": 0.5, "y": 1.00001}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([([[ring]],), (None,)], f"g {geometry.POLYGONS}").select(datasets.simplify(F.col("g"), 0.001).alias("g"))
    got = df.collect()
    assert len(got[0].g[0][0]) == 5 and got[0].g[0][0][0] == got[0].g[0][0][-1] and got[1].g is None
    assert datasets.slug(86, 1.5) == "86x1.5ha" and datasets.ground_sample_distance((0, 3.0, 4.0, 0, 0, 0)) == "5 m"
