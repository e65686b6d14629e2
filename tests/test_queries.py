"""Every registered query of the raster engine against its SQL, over the smallest data."""

import os

import pytest

from gridlake.plans.queries import ORACLE, QUERIES
from gridlake.plans.verify import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], DATA) == ""


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rendered_tiles_cover_the_raster(spark):
    """Each order's cell lies in one of the tiles."""
    from pyspark.sql import functions as F

    from gridlake.functions import tilemath
    from gridlake.raster import orders_raster

    data = "/root/testdata/sf0.01"
    made = {(r.z, r.x, r.y) for r in QUERIES["png_tiles"](spark, data).select("z", "x", "y").collect()}
    raster = orders_raster(spark, data)
    lon, lat = 10 + (F.col("col") + 0.5) * 0.01, 2 - (F.col("row") + 0.5) * 0.01
    place = tilemath.tile_of(lon, lat, F.lit(9))
    held = {(9, r.x, r.y) for r in raster.cells.select(place["x"].alias("x"), place["y"].alias("y")).distinct().collect()}
    assert held == made


def test_mercator_beyond_the_poles_equals_sql(spark, tmp_path):
    """Larger tables place their points near the south pole and beyond it, where there is no y."""
    ids = [0, 17, 600017, 917900, 919000, 919100, 919199, 919400, 930000, 2000000, 3000000, 4517700, 4519000, 4519300, 5999999]
    spark.createDataFrame([(i, None) for i in ids], "event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    assert compare(spark, connect(str(tmp_path)), QUERIES["mercator_forward"], ORACLE["mercator_forward"], str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["tiff_info", "tiff_scan", "tiff_points", "tiff_zonal"])
def test_the_orders_file_does_not_pass_the_driver_as_cells(spark, con, tmp_path, monkeypatch, name):
    """The table's cells are never collected, so the driver's memory doesn't grow with them."""
    import shutil

    def refuse(self):
        raise AssertionError("a whole table is collected")

    data = str(tmp_path / "tables")  # a folder for which there is no file yet
    shutil.copytree(DATA, data)
    with monkeypatch.context() as patched:
        patched.setattr(type(spark.range(0)), "toPandas", refuse)
        found = QUERIES[name](spark, data)
    assert compare(spark, con, lambda *_: found, ORACLE[name], DATA) == ""


def test_tasks_that_coalesce_ranges_grow_with_their_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gridlake.operators import blocks

    monkeypatch.setattr(blocks, "ROWS_PER_TASK", 300, raising=False)
    rows = [(k, (i * 7919 + k * 31) % 100_000 * 40, i % 97) for k in range(30) for i in range(100)]
    found = blocks.coalesce_ranges(spark.createDataFrame(rows, "k long, byte_offset long, byte_count long"), ["k"])
    want = []
    for k in range(30):
        for offset, n in sorted(r[1:] for r in rows if r[0] == k):
            if want and want[-1][0] == k and offset <= want[-1][2] + blocks.COALESCE_GAP:
                want[-1] = (k, want[-1][1], max(want[-1][2], offset + n), want[-1][3] + 1)
            else:
                want.append((k, offset, offset + n, 1))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
