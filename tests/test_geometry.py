import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import geometry, twkb
from gridlake.operators import coverage


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def grid(polygons, w, h):
    out = np.zeros((h, w))
    for row, col, n, share in zip(*coverage.shares(coverage.rings_of(polygons), w, h)):
        out[row, col : col + n] = share
    return out


def star(rng, cx, cy, r, n=7):
    return ring(*((cx + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * k / n), cy + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)))


def overlaps(a, b, n):
    """How much of each of n unit cells lies in [a, b]."""
    return np.clip(np.minimum(np.arange(1, n + 1), b) - np.maximum(np.arange(n), a), 0, None)


def test_boxes_cover_the_product_of_their_overlaps():
    for x0, y0, x1, y1 in ((1.2, 0.4, 3.7, 2.9), (-3.5, 1.25, 2.5, 40.0), (5.75, 5.75, 5.8, 5.9), (-9, -9, 99, 99), (3, 1, 6, 4)):
        assert np.allclose(grid([[box(x0, y0, x1, y1)]], 7, 6), np.outer(overlaps(y0, y1, 6), overlaps(x0, x1, 7)))


def test_a_slanted_edge_by_trapezoids():
    """The triangle under y = x / 3: each column's share is that of a trapezoid, row by row."""
    got = grid([[ring((0, 0), (9, 0), (9, 3))]], 9, 4)
    for col in range(9):
        assert np.isclose(got[:, col].sum(), (col + 0.5) / 3)
    assert np.allclose(got[0, 3:], 1) and np.allclose(got[1, :3], 0) and np.allclose(got[0, :3], [1 / 6, 1 / 2, 5 / 6]) and not got[3].any()


def test_a_wide_raster_takes_no_wide_rows():
    """Work follows the cells that edges cross."""
    import tracemalloc

    tracemalloc.start()
    row, col, n, share = coverage.shares(coverage.rings_of([[ring((500_000.5, 10), (500_004.5, 10), (500_002, 410))], [box(3.5, 600, 899_999.5, 601)]]), 1_000_000, 1000)
    assert np.isclose((n * share).sum(), 800 + 899_996) and len(row) < 3000 and tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(6))
def test_shares_add_up_to_the_area(seed):
    rng = random.Random(seed)
    outer, hole = star(rng, 20, 20, 15), star(rng, 20, 20, 3)
    if seed % 2:
        outer, hole = outer[::-1], hole[::-1]
    area = lambda r: abs(coverage._closed_area(np.array([p["x"] for p in r]), np.array([p["y"] for p in r])))
    assert np.isclose(grid([[outer, hole]], 40, 40).sum(), area(outer) - area(hole))


def test_overlaps_are_clamped_and_runs_hold_the_interior():
    assert grid([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]], 4, 4).max() == 1
    _, _, n, w = coverage.shares(coverage.rings_of([[box(1.5, 0, 90.5, 3)]]), 100, 3)
    assert len(n) == 9 and (n * w).sum() == 89 * 3


def test_fill_agrees_with_the_even_odd_test(spark):
    rng = random.Random(3)
    polygons = [[star(rng, 12, 12, 11), star(rng, 12, 12, 3)], [star(rng, 18, 8, 6)]]
    zones = spark.createDataFrame([(1, polygons)], f"zone_id int, polygons {geometry.POLYGONS}")
    cells = {(r["row"], r["col"]) for r in coverage.cells_of(coverage.coverage_runs(zones, 24, 24, exact=False)).collect()}
    grid_ = spark.range(24 * 24).select((F.col("id") % 24).alias("col"), F.floor(F.col("id") / 24).alias("row"))
    inside = grid_.crossJoin(zones).where(geometry.contains(F.col("polygons"), F.col("col") + 0.5, F.col("row") + 0.5))
    assert cells == {(r["row"], r["col"]) for r in inside.collect()}


def test_wkt(spark):
    texts = ["POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))", "srid=4326;multipolygon (((0 0, 1 0, 1 1, 0 0)), ((5 5 9, 6 5 9, 6 6 9, 5 5 9)))", "POLYGON EMPTY", "POLYGON((0 0,1 1))", "POLYGON((0 0,1 1,2 2)", "POINT(1 2)", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(geometry.from_wkt(F.col("t")).alias("g")).collect()
    assert [None if r.g is None else len(r.g) for r in got] == [1, 2, 0, None, None, None, None]
    again = spark.createDataFrame([(texts[0],)], "t string").select(geometry.from_wkt(F.col("t")).alias("g")).select(geometry.from_wkt(geometry.to_wkt(F.col("g"))).alias("h"), "g", geometry.area(F.col("g")).alias("a")).first()
    assert again.g == again.h and again.a == 15.5


def test_geojson(spark):
    square = "[[[0,0],[2,0],[2,2],[0,2],[0,0]]]"
    polygon = f'{{"type":"Polygon","coordinates":{square}}}'
    texts = [polygon, f'{{"type":"Feature","geometry":{polygon}}}', f'{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{polygon}}},{{"type":"Feature","geometry":null}},{{"type":"Feature","geometry":{{"type":"MultiPolygon","coordinates":[{square}]}}}}]}}', f'{{"type":"GeometryCollection","geometries":[{polygon}]}}', '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}', '{"type":"Point","coordinates":[0,0]}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(geometry.from_geojson(F.col("t")).alias("g")).collect()
    assert [None if r.g is None else len(r.g) for r in got] == [1, 1, 2, 1, None, None]


def test_twkb(spark):
    polygons = [[box(0, 0, 1, 1)], [star(random.Random(1), 25.5, -3.25, 0.5)]]
    data = twkb.encode(polygons, 6)
    back = twkb.decode(data)
    assert len(back) == 2 and all(abs(p["x"] - q["x"]) < 1e-6 and abs(p["y"] - q["y"]) < 1e-6 for a, b in zip(polygons, back) for p, q in zip(a[0], b[0]))
    assert twkb.decode(bytes([0x03, 0x00, 1, 4, 0, 0, 2, 0, 0, 2, 1, 0])) == [[box(0, 0, 1, 1)]]
    for bad in (data[:-1], data + b"\0", b"\x01\x00", b"\x06\x01", b""):
        with pytest.raises(ValueError):
            twkb.decode(bad)
    assert twkb.decode(twkb.encode([])) == [] and twkb.looks_like_twkb(data) and not twkb.looks_like_twkb(b"{")
    df = spark.createDataFrame([(polygons,), (None,)], f"g {geometry.POLYGONS}").select(twkb.twkb_decode(twkb.twkb_encode("g")).alias("g"))
    assert [r.g is None for r in df.collect()] == [False, True]
